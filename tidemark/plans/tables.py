"""Keyed tables, page parsing and streams over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import views as V
from tidemark.functions import html as H, text as tx, vectors
from tidemark.operators import upsert as U
from tidemark.sources import connectors
from tidemark.streaming import jobs as J, state
from tidemark.views import as_of


def _states(spark, d, parity: int) -> DataFrame:
    """Two versions of a table of customers: from even and from odd orders."""
    o = V.table(spark, d, "orders").filter(F.col("o_orderkey") % 2 == parity)
    return o.groupBy(F.col("o_custkey").alias("id")).agg(
        F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"), F.count("*").alias("n"), F.max("o_orderkey").alias("version"), F.max("o_totalprice").alias("best")
    )


def upsert_least_greatest(spark: SparkSession, d: str) -> DataFrame:
    rules = {"first_seen": "least", "last_seen": "greatest", "n": "sum", "version": "new", "best": "greatest"}
    return U.merge(_states(spark, d, 0), _states(spark, d, 1), ["id"], rules)


def upsert_replace(spark, d):
    return U.replace_all(_states(spark, d, 0), _states(spark, d, 1), ["id"], "version")


def upsert_do_nothing(spark, d):
    old = V.table(spark, d, "events").filter("event_id % 3 = 0").groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.min("value").alias("value"))
    new = V.table(spark, d, "events").select("user_id", "event_id", "value")
    return U.keep_first(old, new, ["user_id"], ["event_id"])


def conditional_claim(spark, d):
    """Which trends' alerts may be sent again: failed ones, and those pending for over an hour."""
    old = V.table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "pending").otherwise("sent").alias("status"),
        (F.col("event_id") % 4).cast("int").alias("attempts"), F.col("ts").cast("timestamp_ntz").alias("updated_at"),
    )
    new = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return U.claim(old, new, ["id"], F.lit("2024-01-15").cast("timestamp_ntz"), 1)


def slice_replace(spark, d):
    """Stored daily counts with the last week's days counted anew."""
    e = V.table(spark, d, "events").select(F.to_date("ts").alias("day"), "event_type")
    old = e.groupBy("day", "event_type").agg(F.count("*").alias("n")).withColumn("n", F.col("n") * 2)
    new = e.filter(F.col("day") >= F.to_date(F.lit("2024-01-20"))).groupBy("day", "event_type").agg(F.count("*").alias("n"))
    return U.replace_slice(old, new, ["day"])


def trend_backfill(spark, d):
    """Centroids of stored trends from all of their documents' vectors; trends without any are skipped. The parts of an
    order stand for a trend's documents; the centroid is given by its length and a digest of its rounded places."""
    docs = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trend"), F.col("l_partkey").alias("post_id")).distinct()
    joined = docs.join(V.points(spark, d).select("post_id", "vector"), "post_id", "left")
    sizes = joined.groupBy("trend").agg(F.count("*").alias("docs"), F.count("vector").alias("found"))
    centres = vectors.centroids(joined.filter("vector is not null"), ["trend"], "vector")
    places = F.array_join(F.transform("centroid", lambda x: F.round(x * 1000).cast("bigint").cast("string")), ",")
    return sizes.join(centres.select("trend", F.size("centroid").alias("places"), places.alias("centroid")), "trend", "left").withColumn("skipped", F.col("found") == 0)


def html_text(spark, d):
    """Title, text and links of pages; the text as a digest beside its length."""
    p = V.table(spark, d, "pages").select("page_id", H.text_column(F.col("html")).alias("t"))
    return p.select("page_id", "t.title", F.length("t.text").cast("bigint").alias("chars"), F.md5("t.text").alias("digest"), F.size("t.links").alias("links"))


def html_markdown(spark, d):
    return V.table(spark, d, "pages").select("page_id", H.markdown_column(F.col("html")).alias("markdown"))


def crawl_meta(spark, d):
    """Title and language of pages, and whether they have a card; the oracle reads them with patterns.

    Entities are read as HTML has it: ``&amp``, ``&lt``, ``&gt``, ``&quot`` and ``&#x27`` also where their semicolon is missing."""
    p = V.table(spark, d, "pages").select("page_id", H.meta_column(F.col("html")).alias("m"))
    return p.select("page_id", "m.lang", "m.title", F.col("m.og_title").isNotNull().alias("card"))


def connector_items(spark, d):
    """Pages as a connector's items: normalised, filtered by language, deduplicated, oldest first."""
    raw = V.table(spark, d, "pages").select("page_id", "url", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", r'lang="([a-z]+)"', 1).alias("lang"))
    items = connectors.normalise(
        raw.withColumn("published", F.concat(F.lit("2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"))),
        {"guid": F.lit(None).cast("string"), "url": F.col("url"), "title": F.col("title"), "content": F.col("title"), "published": F.col("published"), "lang": F.col("lang")},
    )
    kept = connectors.select_items(items, languages=["en", "de"])
    return kept.select("external_id", "title", "lang", "published_at")


def _event_stream(spark, d) -> DataFrame:
    s = J.read_table(spark, f"{d}/events.parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_dedupe(spark, d):
    """The first event of each user and type, for good, by marks in the state of the stream."""
    s = _event_stream(spark, d).select("user_id", "event_type", "event_id", "value")
    with state.rocksdb(spark):
        return J.drain(state.first_for_good(s, ["user_id", "event_type"], "event_id"), "dedupe")


def stream_dedupe_watermark(spark, d):
    """Users and types seen within ninety days of event time; older keys' state is given up."""
    s = _event_stream(spark, d).select("user_id", "event_type", "ts")
    return J.drain(J.first_of_each(s, ["user_id", "event_type"], "ts", "90 days"), "seen").select("user_id", "event_type")


def stream_windows(spark, d):
    """Six-hour counts by type; windows that the watermark has passed."""
    s = _event_stream(spark, d).select("event_type", "ts")
    out = J.drain(J.windowed_counts(s, ["event_type"], "ts", "6 hours", "1 hour"), "windows")
    return out.filter(F.col("window_start") < F.lit("2024-01-29").cast("timestamp")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_retry_dlq(spark, d):
    """Events that fail as often as their property says; after five attempts they are dead letters."""
    s = _event_stream(spark, d).select("event_id", (F.get_json_object("props", "$.k").cast("int") % 7).alias("failures"))
    out = J.with_retries(s, lambda rows: rows.withColumn("ok", F.col("attempts") > F.col("failures")), 5, "retry")
    return out.select("event_id", "attempts", "status")


def stream_routing(spark, d):
    s = _event_stream(spark, d).select("event_id", "event_type", "value")
    routes = {"vision": F.col("event_type") == "view", "crawl": F.col("value") > 20, "reindex": F.col("event_type").isin("view", "purchase")}
    return J.routed(s, routes, "routes").groupBy("route").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


def stream_rate_limit(spark, d):
    """Two events an hour and user are let through."""
    s = _event_stream(spark, d).select("user_id", "ts")
    out = J.drain(J.rate_limited(s, "user_id", "ts", 2, 3600), "rate")
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"))


_STATES = """st as (select o_orderkey % 2 as parity, o_custkey as id, min(o_orderdate) as first_seen, max(o_orderdate) as last_seen, count(*) as n, max(o_orderkey) as version, max(o_totalprice) as best from orders group by 1, 2)"""

QUERIES = {
    f.__name__: f
    for f in (
        upsert_least_greatest, upsert_replace, upsert_do_nothing, conditional_claim, slice_replace, trend_backfill, html_text, html_markdown, crawl_meta, connector_items,
        stream_dedupe, stream_dedupe_watermark, stream_windows, stream_retry_dlq, stream_routing, stream_rate_limit,
    )
}
ORACLES = {
    "upsert_least_greatest": f"""with {_STATES} select coalesce(a.id, b.id) as id, least(a.first_seen, b.first_seen) as first_seen, greatest(a.last_seen, b.last_seen) as last_seen,
        coalesce(a.n, 0) + coalesce(b.n, 0) as n, coalesce(b.version, a.version) as version, greatest(a.best, b.best) as best
        from (select * from st where parity = 0) a full join (select * from st where parity = 1) b on a.id = b.id""",
    "upsert_replace": f"""with {_STATES}, r as (select *, row_number() over (partition by id order by version desc) as r from st) select id, first_seen, last_seen, n, version, best from r where r = 1""",
    "upsert_do_nothing": """with o as (select user_id, min(event_id) as event_id, min(value) as value from events where event_id % 3 = 0 group by 1),
        n as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as r from events)
        select user_id, event_id, value from o union all select user_id, event_id, value from n where r = 1 and user_id not in (select user_id from o)""",
    "conditional_claim": """select o.id, 'pending' as status, cast(coalesce(attempts, 0) + 1 as int) as attempts from (select distinct o_orderkey as id from orders) o left join
        (select event_id as id, case event_type when 'error' then 'error' when 'click' then 'pending' else 'sent' end as status, event_id % 4 as attempts, ts from events) e using (id)
        where status is null or status = 'error' or (e.status = 'pending' and timestamp '2024-01-15' - ts > interval 1 hour)""",
    "slice_replace": """with e as (select cast(ts as date) as day, event_type, count(*) as n from events group by 1, 2)
        select day, event_type, case when day >= date '2024-01-20' then n else n * 2 end as n from e""",
    "trend_backfill": f"""with {V.POINTS}, t as (select distinct l_orderkey as trend, l_partkey as post_id from lineitem), j as (select * from t left join points using (post_id)),
        s as (select trend, count(*) as docs, count(vector) as found from j group by trend), e as (select trend, i, avg(vector[i]) as x from j, (select unnest(range(1, 65)) as i) where vector is not null group by all),
        c as (select trend, cast(count(*) as int) as places, string_agg(cast(cast(round(x * 1000) as bigint) as varchar), ',' order by i) as centroid from e group by trend)
        select trend, docs, found, places, centroid, found = 0 as skipped from s left join c using (trend)""",
    "crawl_meta": r"""select page_id, case when regexp_matches(left(html, 200), '[^\x00-\x7F]') then 'ru' else 'en' end as lang, contains(html, 'og:title') or contains(html, 'twitter:title') as card,
        trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'),
            '&#x27(;|([^0-9A-Fa-f;])|$)', '''\2', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) as title from pages""",
    "connector_items": r"""with p as (select page_id, url, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) as title, regexp_extract(html, 'lang="([a-z]+)"', 1) as lang,
        timestamp '2024-01-01' + to_days(cast(page_id % 28 as int)) as published_at, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as base,
        list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda q: q <> '' and not regexp_matches(lower(split_part(q, '=', 1)), '^(utm_|rss|ref|source|fbclid|gclid)')) as pairs from pages),
        e as (select case when len(pairs) = 0 then base else base || '?' || array_to_string(pairs, '&') end as external_id, title, lang, published_at, page_id from p where lang in ('en', 'de')),
        r as (select *, row_number() over (partition by external_id order by published_at, title) as r from e) select external_id, title, lang, published_at from r where r = 1""",
    "stream_dedupe": "select user_id, event_type, min(event_id) as event_id, arg_min(value, event_id) as value from events group by 1, 2",
    "stream_dedupe_watermark": "select distinct user_id, event_type from events",
    "stream_windows": """select event_type, date_trunc('day', ts)::timestamp + to_hours(cast(hour(ts) // 6 * 6 as bigint)) as window_start, count(*) as n from events
        where ts < timestamp '2024-01-29' group by 1, 2""",
    "stream_retry_dlq": """select event_id, cast(least(k % 7 + 1, 5) as int) as attempts, case when k % 7 < 5 then 'done' else 'dead' end as status
        from (select event_id, cast(json_extract_string(props, '$.k') as int) as k from events)""",
    "stream_rate_limit": """with recursive e as (select user_id, ts, row_number() over (partition by user_id order by ts) as r from events),
        f as (select user_id, r, ts as t1, cast(null as timestamp) as t2, 1 as accepted from e where r = 1
            union all select e.user_id, e.r, case when t2 > e.ts - interval 1 hour then t1 else e.ts end, case when t2 > e.ts - interval 1 hour then t2 else t1 end,
                case when t2 > e.ts - interval 1 hour then 0 else 1 end from f join e on e.user_id = f.user_id and e.r = f.r + 1)
        select user_id, count(*) as n, cast(sum(accepted) as bigint) as accepted from f group by user_id""",
    "stream_routing": """with r as (select 'vision' as route, value from events where event_type = 'view' union all select 'crawl', value from events where value > 20
        union all select 'reindex', value from events where event_type in ('view', 'purchase')) select route, count(*) as n, round(sum(value), 4) as value from r group by route""",
}
