"""Gates, routes, rollups and updates of the query catalogue that the other plans leave open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import views as V
from tidemark.functions import intents, scores as S, text as tx
from tidemark.operators import ranking


def vision_search(spark: SparkSession, d: str) -> DataFrame:
    """Turns whose JSON or text matches, with OCR text present, newest first: the twenty first."""
    c = V.table(spark, d, "conversations").withColumn("data", F.to_json(F.struct("role", "turn")))
    hits = c.filter((F.col("data").ilike("%assist%") | F.col("text").ilike("%sch%")) & (F.col("turn") % 3 == 0))
    return hits.orderBy(F.desc("conv_id"), F.desc("turn")).limit(20).select("conv_id", "turn", "data", tx.preview(F.col("text"), 120).alias("preview"))


def crawl_merge(spark, d):
    """Crawled pages of a host as one: words added up, the first title by page."""
    p = V.table(spark, d, "pages").select(tx.host(F.col("url")).alias("host"), "page_id", F.nullif(F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit("")).alias("title"), F.length("html").alias("chars"))
    return p.groupBy("host").agg(F.count("*").alias("pages"), F.sum("chars").cast("bigint").alias("chars"), F.min_by("title", F.when(F.col("title").isNotNull(), F.col("page_id"))).alias("title"))


def ocr_lines(spark, d):
    """Recognised lines of an image as one text, with the confidences' mean, least and greatest."""
    c = V.table(spark, d, "conversations").select("conv_id", "turn", "text", (F.length("text") % 100 / 100).alias("confidence"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return c.groupBy("conv_id").agg(
        F.count("*").alias("lines"), F.round(F.avg("confidence"), 6).alias("mean"), F.min("confidence").alias("least"), F.max("confidence").alias("most"), F.md5(lines).alias("digest")
    )


def label_union(spark, d):
    """All categories that each concept was filed under, as one sorted list."""
    return V.concepts(spark, d).groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.max("weight").alias("weight"))


def null_safe_match(spark, d):
    """Jobs for a workspace, or for none, beside the running ones of the same, nulls being equal."""
    e = V.table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 5 != 0, F.col("event_type")).alias("workspace"))
    running = e.groupBy("workspace").agg(F.count("*").alias("running")).withColumnRenamed("workspace", "w")
    return e.join(running, F.col("workspace").eqNullSafe(F.col("w"))).groupBy("workspace").agg(F.max("running").alias("running"), F.count("*").alias("jobs"))


def member_update(spark, d):
    """Posts marked by the lists of ids that trends hold."""
    lists = V.table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 97).alias("trend")).agg(F.collect_set(F.col("l_suppkey")).alias("doc_ids"))
    ids = lists.select(F.explode("doc_ids").alias("post_id")).distinct().withColumn("in_trend", F.lit(True))
    p = V.posts(spark, d).select("post_id", "status").join(ids, "post_id", "left")
    return p.select("post_id", F.when(F.col("in_trend"), "clustered").otherwise(F.col("status")).alias("status"))


def fading_update(spark, d):
    """Trends after a run: those that it didn't touch (here of even key) and that were last seen over a week ago fade."""
    now = F.lit("1998-08-01").cast("timestamp_ntz")
    t = V.trends(spark, d)
    stage = S.fading(F.col("stage"), F.col("cluster_key") % 2 == 1, V.hours_before(F.col("detected_at"), now))
    return t.groupBy("workspace", stage.alias("stage")).agg(F.count("*").alias("n"))


def retry_increment(spark, d):
    """Index states after a run: failures count one more attempt, and end as failed after five."""
    e = V.table(spark, d, "events").select("event_id", (F.col("event_id") % 6).cast("int").alias("retries"), (F.col("event_type") == "error").alias("failed"))
    n = F.when(F.col("failed"), F.col("retries") + 1).otherwise(F.col("retries"))
    return e.groupBy(F.when(F.col("failed") & (n >= 5), "failed").when(F.col("failed"), "pending").otherwise("done").alias("status"), n.alias("retries")).agg(F.count("*").alias("n"))


def safe_urls(spark, d):
    p = V.table(spark, d, "pages").withColumn("url", F.when(F.col("page_id") % 9 == 0, F.concat(F.lit("http://192.168.0.1/"), F.col("page_id").cast("string"))).otherwise(F.col("url")))
    return p.select("page_id", tx.safe_url(F.col("url")).alias("safe"), tx.host(F.col("url")).isin(*tx.SOCIAL_HOSTS).alias("social"))


def vision_routing(spark, d):
    """Whether a page's pictures are looked at: by kind, size and mode, first reason first."""
    size = F.length("html")
    reason = F.when(F.col("page_id") % 11 == 0, "mode off").when(~F.col("html").contains("<article>"), "no picture").when(size > 4000, "too large").when(size < 1500, "too small").otherwise("look")
    return V.table(spark, d, "pages").groupBy(reason.alias("decision")).agg(F.count("*").alias("pages"))


def relevance_gate(spark, d):
    """Posts let through, sent for a second look, or dropped, by category."""
    category = F.when(F.col("post_id") % 4 == 0, "other").otherwise("technology")
    p = V.posts(spark, d).withColumn("category", category).withColumn("score", F.col("relevance") - F.col("post_id") % 3 * 0.04)
    return p.groupBy("category").agg(
        F.count_if(S.relevant(F.col("score"), F.col("category"))).alias("kept"), F.count_if(S.needs_review(F.round("score", 6), F.col("category"), F.lit(False))).alias("reviewed"), F.count("*").alias("n")
    )


def topic_overlap(spark, d):
    """Posts that share a third of a topic's words, of all words of both; topics are the benchmark's items."""

    def words(df: DataFrame, key: str, text: str) -> DataFrame:
        return df.select(key, F.explode(F.array_distinct(tx.terms(F.col(text)))).alias("w"))

    topics = words(V.table(spark, d, "benchmark").select(F.col("item_id").alias("topic"), "text"), "topic", "text")
    sizes = topics.groupBy("topic").agg(F.count("*").alias("size"))
    shared = words(V.posts(spark, d), "post_id", "content").join(topics, "w").groupBy("topic", "post_id").agg(F.count("*").alias("shared")).join(sizes, "topic")
    return shared.withColumn("overlap", F.round(F.col("shared") / F.col("size"), 6)).filter(F.col("overlap") >= 0.34).select("topic", "post_id", "overlap")


def query_intents(spark, d):
    """What users' questions ask for: region, days back, kinds of signals, counter-signals and how sure that is."""
    u = V.table(spark, d, "conversations").filter("role = 'user'")
    asked = intents.parse(F.col("text"), F.lit(30))
    rows = u.select("conv_id", "turn", *[c.alias(n) for n, c in asked.items()])
    return rows.select("conv_id", "turn", "source_region", "days_back", S.days_to_range(F.col("days_back")).alias("time_range"), F.array_join("signal_types", ",").alias("signal_types"), "wants_counter", "confidence")


def document_concepts(spark, d):
    """Ten heaviest concepts of each document, each once, as it would be stored."""
    c = V.concepts(spark, d).groupBy("doc_id", "name").agg(F.max("weight").alias("weight"))
    best = ranking.top_k(c, ["doc_id"], [F.desc("weight"), F.asc("name")], 10, "rank")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"])
    return best.groupBy("doc_id").agg(F.array_join(listed, ",").alias("concepts"), F.count_if(F.col("weight") >= 3).alias("tags"))


def workspace_brief(spark, d):
    """Three best trends of each workspace, of two stages, with how many it has of each stage."""
    t = V.trends(spark, d)
    counts = t.groupBy("workspace").agg(F.count_if(F.col("stage") == "stable").alias("stable"), F.count_if(F.col("stage").isin("weak", "emerging")).alias("emerging"))
    best = ranking.top_k(t.filter(F.col("stage").isin("stable", "emerging")), ["workspace"], [F.desc("signal_score"), F.asc("cluster_key")], 3, "rank")
    return best.select("workspace", "rank", "cluster_key", "signal_score").join(counts, "workspace")


def group_albums(spark, d):
    """Messages of a chat grouped by thread, in frames of at most six within 48 turns."""
    from tidemark.sources.connectors import albums

    m = V.table(spark, d, "conversations").select(F.col("turn").alias("id"), F.col("conv_id").alias("group"), "text")
    return albums(m, span=48, most=6)


QUERIES = {
    f.__name__: f
    for f in (
        vision_search, crawl_merge, ocr_lines, label_union, null_safe_match, member_update, fading_update, retry_increment, safe_urls, vision_routing, relevance_gate,
        topic_overlap, query_intents, document_concepts, workspace_brief, group_albums,
    )
}
_TITLE = "nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '')"
_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '')"


def _any(words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains(t, '{w}')" for w in words) + ")"


OVERLAP = f"""{V.POSTS}, tw as (select item_id as topic, unnest(list_distinct(regexp_extract_all(lower(text), '{tx.TERM}'))) as w from benchmark),
    pw as (select post_id, unnest(list_distinct(regexp_extract_all(lower(content), '{tx.TERM}'))) as w from posts), ts as (select topic, count(*) as size from tw group by 1),
    os as (select topic, post_id, count(*) as shared from pw join tw using (w) group by all),
    shares as (select topic, post_id, round(shared / size, 6) as overlap from os join ts using (topic) where round(shared / size, 6) >= 0.34)"""
ORACLES = {
    "vision_search": r"""with c as (select *, '{"role":"' || role || '","turn":' || turn || '}' as data from conversations)
        select conv_id, turn, data, left(trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 120) as preview from c
        where (data ilike '%assist%' or text ilike '%sch%') and turn % 3 = 0 order by conv_id desc, turn desc limit 20""",
    "crawl_merge": f"""select {_HOST} as host, count(*) as pages, cast(sum(length(html)) as bigint) as chars, arg_min({_TITLE}, page_id) filter (where {_TITLE} is not null) as title from pages group by 1""",
    "ocr_lines": """select conv_id, count(*) as lines, round(avg(length(text) % 100 / 100), 6) as mean, min(length(text) % 100 / 100) as least, max(length(text) % 100 / 100) as most,
        md5(string_agg(text, chr(10) order by turn, text)) as digest from conversations group by conv_id""",
    "label_union": f"with {V.CONCEPTS} select name, array_to_string(list_sort(list(distinct category)), ',') as categories, max(weight) as weight from concepts group by name",
    "null_safe_match": """with e as (select event_id, case when user_id % 5 <> 0 then event_type end as workspace from events) select workspace, count(*) as running, count(*) as jobs from e group by 1""",
    "member_update": f"""with {V.POSTS} select post_id, case when post_id in (select l_suppkey from lineitem) then 'clustered' else status end as status from posts""",
    "fading_update": f"""with {V.TRENDS} select workspace, case when cluster_key % 2 = 0 and detected_at < timestamp '1998-08-01' - interval 7 day and stage <> 'fading' then 'fading' else stage end as stage, count(*) as n
        from trends group by all""",
    "retry_increment": """with e as (select event_type = 'error' as f, cast(event_id % 6 as int) + case when event_type = 'error' then 1 else 0 end as retries from events)
        select case when f and retries >= 5 then 'failed' when f then 'pending' else 'done' end as status, retries, count(*) as n from e group by all""",
    "safe_urls": rf"""with p as (select page_id, case when page_id % 9 = 0 then 'http://192.168.0.1/' || page_id else url end as url from pages),
        c as (select page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)
            || coalesce(nullif(rtrim(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), ''), '/') as base,
            list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda q: regexp_matches(q, '^[^=]+=.') and not starts_with(lower(q), 'utm_')
                and lower(split_part(q, '=', 1)) not in ({", ".join(f"'{x}'" for x in tx.TRACKING_KEYS)})) as pairs from p)
        select page_id, case when page_id % 9 <> 0 and not regexp_matches({_HOST}, '{"|".join(tx.BLOCKED_PARTS)}') then case when len(pairs) = 0 then base else base || '?' || array_to_string(pairs, '&') end end as safe,
            {_HOST} in ({", ".join(f"'{x}'" for x in tx.SOCIAL_HOSTS)}) as social from c""",
    "vision_routing": """select case when page_id % 11 = 0 then 'mode off' when not contains(html, '<article>') then 'no picture' when length(html) > 4000 then 'too large' when length(html) < 1500 then 'too small'
        else 'look' end as decision, count(*) as pages from pages group by 1""",
    "relevance_gate": f"""with {V.POSTS}, p as (select case when post_id % 4 = 0 then 'other' else 'technology' end as category, relevance - post_id % 3 * 0.04::double as score from posts)
        select category, count(*) filter (where score >= 0.6 or (category <> 'other' and score >= 0.6::double - 0.1::double)) as kept, count(*) filter (where abs(round(score, 6) - 0.6::double) <= 0.1::double) as reviewed,
        count(*) as n from p group by 1""",
    "topic_overlap": f"with {OVERLAP} select * from shares",
    "query_intents": f"""with q as (select conv_id, turn, lower(text) as t, try_cast(regexp_extract(lower(text), '{intents.DAYS}', 1) as int) as n from conversations where role = 'user'),
        r as (select *, {_any(intents.RUSSIA)} as ru, {_any(intents.WORLD)} as gl, {_any(intents.COUNTER)} as wants_counter,
            list_slice(list_filter([{", ".join(f"case when {_any(words)} then '{kind}' end" for kind, words in intents.SIGNAL_TYPES.items())}], lambda x: x is not null), 1, 3) as kinds,
            case when n is not null then greatest(1, least(365, n)) {" ".join(f"when {_any(words)} then {days}" for words, days in intents.SPANS)} else 30 end as days_back from q)
        select conv_id, turn, case when ru then 'ru' when gl then 'global' end as source_region, cast(days_back as int) as days_back,
            case when days_back <= 1 then 'day' when days_back <= 7 then 'week' when days_back <= 31 then 'month' else 'year' end as time_range, array_to_string(kinds, ',') as signal_types, wants_counter,
            round(cast(least(0.95, 0.35 + case when ru or gl then 0.15 else 0 end + case when len(kinds) > 0 then 0.2 else 0 end + case when wants_counter then 0.15 else 0 end
                + case when days_back <> 30 then 0.05 else 0 end) as double), 2) as confidence from r""",
    "document_concepts": f"""with {V.CONCEPTS}, c as (select doc_id, name, max(weight) as weight from concepts group by all), r as (select *, row_number() over (partition by doc_id order by weight desc, name) as r from c)
        select doc_id, string_agg(name, ',' order by r) as concepts, count(*) filter (where weight >= 3) as tags from r where r <= 10 group by doc_id""",
    "workspace_brief": f"""with {V.TRENDS}, k as (select workspace, count(*) filter (where stage = 'stable') as stable, count(*) filter (where stage in ('weak', 'emerging')) as emerging from trends group by 1),
        r as (select workspace, cluster_key, signal_score, cast(row_number() over (partition by workspace order by signal_score desc, cluster_key) as int) as rank from trends where stage in ('stable', 'emerging'))
        select workspace, rank, cluster_key, signal_score, stable, emerging from r join k using (workspace) where rank <= 3""",
    "group_albums": """with recursive m as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as r from conversations where conv_id is not null and turn is not null),
        f as (select conv_id, r, turn, turn as first, 1 as k, 0 as frame from m where r = 1
            union all select m.conv_id, m.r, m.turn, case when k = 6 or m.turn - first > 48 then m.turn else first end, case when k = 6 or m.turn - first > 48 then 1 else k + 1 end,
                case when k = 6 or m.turn - first > 48 then frame + 1 else frame end from f join m on m.conv_id = f.conv_id and m.r = f.r + 1)
        select conv_id as "group", frame, min(turn) as first_id, max(turn) as last_id, count(*) as items from f group by conv_id, frame""",
}
