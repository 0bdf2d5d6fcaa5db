"""Text, URL and id work over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import views as V
from tidemark.functions import text as tx
from tidemark.operators.ranking import most_common

_TERM = tx.TERM
_INCLUDE, _EXCLUDE, _LANGS = ["the", "der", "que"], ["zzz"], ["en", "de"]


def keyword_lang_filter(spark: SparkSession, d: str) -> DataFrame:
    p = V.posts(spark, d)
    kept = p.filter(tx.passes_keywords(F.col("content"), _INCLUDE, _EXCLUDE) & tx.passes_language(F.col("workspace"), _LANGS))
    return kept.select("post_id", "workspace")


def url_canonicalize(spark, d):
    return V.table(spark, d, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("canonical"), tx.crawl_url(F.col("url")).alias("crawl"), tx.host(F.col("url")).alias("host"))


def url_extract(spark, d):
    """A page's own address and the links in its HTML, the first ten different ones."""
    return V.table(spark, d, "pages").select("page_id", F.explode(tx.urls(F.concat_ws(" ", "url", "html"))).alias("url"))


def digest_ids(spark, d):
    key = F.concat_ws("|", "source_id", F.col("post_id").cast("string"))
    return V.posts(spark, d).select("post_id", tx.digest(key, "post").alias("digest"), F.sha2(key, 256).alias("sha256"), F.md5(key).alias("md5"))


def uuid_ids(spark, d):
    """Name-based ids; the oracle rebuilds them from the SHA-1."""
    return V.posts(spark, d).select("post_id", tx.uuid5_url(F.concat(F.lit("post:"), F.col("post_id").cast("string"))).alias("uuid"))


def external_ids(spark, d):
    """In-feed ids where a guid is missing for some and a URL for others."""
    n = F.col("page_id")
    guid = F.when(n % 3 == 0, F.concat(F.lit("g-"), n.cast("string"))).when(n % 3 == 1, "  ")
    url = F.when(n % 3 == 1, F.col("url"))
    return V.table(spark, d, "pages").select("page_id", tx.external_id(guid, url, F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(None).cast("string")).alias("external_id"))


def tokenise_top_terms(spark, d):
    """Eight most common terms of each workspace."""
    words = V.posts(spark, d).select("workspace", F.explode(tx.terms(F.col("content"))).alias("term"))
    return most_common(words, ["workspace"], "term", 8)


def plaintext_candidates(spark, d):
    """Pages whose text still has tags or entities, by kind."""
    return V.table(spark, d, "pages").select(
        "page_id", F.col("html").rlike("<[^>]+>").alias("has_tags"), (F.col("html").contains("&amp;") | F.col("html").contains("&#")).alias("has_entities")
    )


def detected_languages(spark, d):
    return V.posts(spark, d).groupBy("workspace", tx.detected_language(F.col("content")).alias("detected")).agg(F.count("*").alias("n"))


def json_paths(spark, d):
    """Properties of events, read by path and coerced; events without the path are null."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return V.table(spark, d, "events").groupBy((k % 10).alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))


def ordered_dedupe(spark, d):
    """The first post of each text (ties: smallest id), as a connector would take them in."""
    p = V.posts(spark, d)
    return p.groupBy(F.md5("content").alias("digest")).agg(F.min("post_id").alias("post_id"), F.count("*").alias("copies"))


def seen_ids_window(spark, d):
    """Each source's last 500 ids, oldest first, as one digest."""
    from pyspark.sql import Window

    w = Window.partitionBy("source_id").orderBy(F.desc("published_at"), F.desc("post_id"))
    last = V.posts(spark, d).filter("source_id is not null").withColumn("r", F.row_number().over(w)).filter("r <= 500")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("r"), F.col("post_id").cast("string").alias("p")))), lambda x: x["p"]), ",")
    return last.groupBy("source_id").agg(F.count("*").alias("n"), F.md5(ids).alias("digest"))


def archive_days(spark, d):
    """Every day of January 2024 with its posts; days without any have zero."""
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-31')) as day")
    counts = V.posts(spark, d).groupBy(F.to_date("published_at").alias("day")).agg(F.count("*").alias("posts"))
    return days.join(counts, "day", "left").select("day", F.coalesce("posts", F.lit(0)).cast("bigint").alias("posts"))


def backfill_window(spark, d):
    """Posts of a half-open window that no crawl has yet."""
    p = V.posts(spark, d).filter((F.col("published_at") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("published_at") < F.lit("2024-01-12").cast("timestamp_ntz")))
    return p.select("post_id", "source_id", "published_at").join(V.crawls(spark, d).select("post_id"), "post_id", "left_anti")


_CANON = r"""c as (select page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as base,
    list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' and not regexp_matches(lower(split_part(p, '=', 1)), '^(utm_|rss|ref|source|fbclid|gclid)')) as pairs,
    list_sort(list_filter(string_split(regexp_extract(lower(trim(url)), '\?([^#]*)', 1), '&'), lambda p: p <> '')) as sorted from pages)"""
_CANONICAL = "case when len(pairs) = 0 then base else base || '?' || array_to_string(pairs, '&') end"

QUERIES = {
    f.__name__: f
    for f in (
        keyword_lang_filter, url_canonicalize, url_extract, digest_ids, uuid_ids, external_ids, tokenise_top_terms, plaintext_candidates,
        detected_languages, json_paths, ordered_dedupe, seen_ids_window, archive_days, backfill_window,
    )
}
ORACLES = {
    "keyword_lang_filter": f"""with {V.POSTS} select post_id, workspace from posts where (contains(lower(coalesce(content, '')), 'the') or contains(lower(coalesce(content, '')), 'der')
        or contains(lower(coalesce(content, '')), 'que')) and not contains(lower(coalesce(content, '')), 'zzz') and (workspace is null or lower(workspace) in ('en', 'de'))""",
    "url_canonicalize": rf"""with {_CANON} select page_id, {_CANONICAL} as canonical,
        case when len(sorted) = 0 then regexp_extract(lower(trim(url)), '^([^?#]*)', 1) else regexp_extract(lower(trim(url)), '^([^?#]*)', 1) || '?' || array_to_string(sorted, '&') end as crawl,
        regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') as host from c""",
    "url_extract": rf"""with raw as (select page_id, unnest(regexp_extract_all(url || ' ' || html, '{tx.URL.replace("'", "''")}')) as u, generate_subscripts(regexp_extract_all(url || ' ' || html, '{tx.URL.replace("'", "''")}'), 1) as i from pages),
        f as (select page_id, regexp_replace(u, '[.,;:!?]+$', '') as url, min(i) as i from raw group by all),
        k as (select * from f where regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www[.]', '') not in ({", ".join(f"'{x}'" for x in tx.SOCIAL_HOSTS)})),
        r as (select page_id, url, row_number() over (partition by page_id order by i) as r from k)
        select page_id, url from r where r <= 10""",
    "digest_ids": f"""with {V.POSTS}, k as (select post_id, concat_ws('|', source_id, cast(post_id as varchar)) as k from posts)
        select post_id, 'post:' || left(sha1(k), 16) as digest, sha256(k) as sha256, md5(k) as md5 from k""",
    "uuid_ids": f"""with {V.POSTS}, s as (select post_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('post:' || cast(post_id as varchar))) as h from posts)
        select post_id, left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || (['8','9','a','b'])[(instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1]
            || substr(h, 18, 3) || '-' || substr(h, 21, 12) as uuid from s""",
    "external_ids": f"""with {_CANON} select page_id, case page_id % 3 when 0 then 'g-' || page_id when 1 then {_CANONICAL}
        else sha256(regexp_extract(html, '<title>([^<]*)</title>', 1) || '|') end as external_id from c join pages using (page_id)""",
    "tokenise_top_terms": f"""with {V.POSTS}, w as (select workspace, unnest(regexp_extract_all(lower(content), '{_TERM}')) as term from posts),
        n as (select workspace, term, count(*) as n from w group by all), r as (select *, cast(row_number() over (partition by workspace order by n desc, term) as int) as rank from n)
        select * from r where rank <= 8""",
    "plaintext_candidates": "select page_id, regexp_matches(html, '<[^>]+>') as has_tags, contains(html, '&amp;') or contains(html, '&#') as has_entities from pages",
    "detected_languages": f"""with {V.POSTS} select workspace, case when coalesce(trim(content), '') = '' then 'unknown' when regexp_matches(left(ltrim(content), 300), '[Ѐ-ӿ]') then 'ru' else 'en' end as detected, count(*) as n from posts group by all""",
    "json_paths": "select cast(try_cast(json_extract_string(props, '$.k') as int) % 10 as int) as k, count(*) as n, round(avg(value), 6) as avg_value from events group by 1",
    "ordered_dedupe": f"with {V.POSTS} select md5(content) as digest, min(post_id) as post_id, count(*) as copies from posts group by 1",
    "seen_ids_window": f"""with {V.POSTS}, r as (select *, row_number() over (partition by source_id order by published_at desc, post_id desc) as r from posts where source_id is not null)
        select source_id, count(*) as n, md5(string_agg(cast(post_id as varchar), ',' order by r desc)) as digest from r where r <= 500 group by source_id""",
    "archive_days": f"""with {V.POSTS}, c as (select cast(published_at as date) as day, count(*) as posts from posts group by 1)
        select cast(d as date) as day, cast(coalesce(posts, 0) as bigint) as posts from (select unnest(generate_series(date '2024-01-01', date '2024-01-31', interval 1 day)) as d) left join c on cast(d as date) = c.day""",
    "backfill_window": f"""with {V.POSTS}, {V.CRAWLS} select post_id, source_id, published_at from posts where published_at >= timestamp '2024-01-05' and published_at < timestamp '2024-01-12'
        and not exists (select 1 from crawls c where c.post_id = posts.post_id)""",
}
