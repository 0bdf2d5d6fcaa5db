"""Health of sources, states of the pipeline, and overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark import views as V
from tidemark.functions import scores as S, text as tx
from tidemark.operators.ranking import latest, top_k
from tidemark.views import as_of, hours_before


def _run_counts(spark, d) -> DataFrame:
    recent = F.col("started_at") >= as_of() - F.expr("interval 14 days")
    ok = F.col("status") == "success"
    return V.source_runs(spark, d).groupBy("source_id").agg(
        F.count_if(recent & ok).alias("success"), F.count_if(recent & ~ok).alias("errors"), F.max("started_at").alias("last_started")
    )


_RUN_COUNTS = """run_counts as (select source_id, count(*) filter (where started_at >= as_of - interval 14 day and status = 'success') as success,
    count(*) filter (where started_at >= as_of - interval 14 day and status <> 'success') as errors, max(started_at) as last_started
    from source_runs, (select timestamp '2024-01-31 12:30:00' as as_of) group by source_id)"""


def _latest_run(spark, d) -> DataFrame:
    return latest(V.source_runs(spark, d), ["source_id"], ["started_at", "run_id"])


_LATEST = """latest_run as (select * exclude (r) from (select *, row_number() over (partition by source_id order by started_at desc, run_id desc) as r
    from source_runs) where r = 1)"""


def _yields(spark, d) -> DataFrame:
    """Of posts of the last 30 days: relevance, tags, crawled links, newest post."""
    crawled = V.crawls(spark, d).select("post_id").distinct().withColumn("linked", F.lit(1.0))
    recent = V.posts(spark, d).filter(F.col("published_at") >= as_of() - F.expr("interval 30 days")).filter(F.col("source_id").isNotNull())
    return (
        recent.select("post_id", "source_id", "relevance", "n_tags", "published_at")
        .join(crawled, "post_id", "left")
        .groupBy("source_id")
        .agg(
            F.count("*").alias("posts"),
            F.avg(F.when(F.col("relevance") >= 0.6, 1.0).otherwise(0.0)).alias("relevant"),
            F.avg("n_tags").alias("tags"),
            F.avg(F.coalesce("linked", F.lit(0.0))).alias("linked"),
            F.max("published_at").alias("newest"),
        )
    )


_YIELDS = """yields as (select source_id, count(*) as posts, avg(case when relevance >= 0.6 then 1.0::double else 0.0::double end) as relevant,
    avg(n_tags) as tags, avg(case when c.post_id is null then 0.0::double else 1.0::double end) as linked, max(published_at) as newest
    from posts p left join (select distinct post_id from crawls) c using (post_id)
    where published_at >= timestamp '2024-01-31 12:30:00' - interval 30 day and source_id is not null group by source_id)"""


def source_health(spark: SparkSession, d: str) -> DataFrame:
    """Sources with run counts, latest run, yield and composite score; aggregates first, then joins."""
    last = _latest_run(spark, d).select(
        "source_id", F.col("status").alias("last_status"), F.col("error_text").alias("last_error"), F.col("fetched").alias("last_fetched"), F.col("emitted").alias("last_emitted")
    )
    rows = V.sources(spark, d).join(_run_counts(spark, d), "source_id", "left").join(last, "source_id", "left").join(_yields(spark, d), "source_id", "left")
    for c in ("success", "errors", "last_fetched", "last_emitted"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(0)).cast("bigint"))
    for c in ("relevant", "tags", "linked"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(0.0)))
    q = S.source_quality(
        F.col("authority"), F.col("success"), F.col("errors"), F.col("last_fetched"), F.col("last_emitted"), F.col("relevant"), F.col("tags"), F.col("linked"), hours_before(F.col("newest"))
    )
    share = S.ratio(F.col("errors"), F.col("success") + F.col("errors"))
    mode = S.content_mode(F.col("kind"), F.col("full_content"), F.col("last_status"), share, F.col("last_error"), F.col("last_fetched"), F.col("last_emitted"))
    return rows.select(
        "source_id", "kind", "success", "errors", "last_status", *[F.round(x, 5).alias(n) for n, x in q.items()], mode.alias("content_mode")
    ).orderBy(F.desc("source_score"), "source_id")


SOURCE_HEALTH = f"""with {V.SOURCES}, {V.POSTS}, {V.CRAWLS}, {V.SOURCE_RUNS}, {_RUN_COUNTS}, {_LATEST}, {_YIELDS},
    j as (select s.source_id, kind, authority, full_content, coalesce(success, 0) as success, coalesce(errors, 0) as errors, l.status as last_status,
        coalesce(l.error_text, '') as last_error, coalesce(l.fetched, 0) as f, coalesce(l.emitted, 0) as e, coalesce(relevant, 0) as relevant,
        coalesce(tags, 0) as tags, coalesce(linked, 0) as linked, (epoch_us(timestamp '2024-01-31 12:30:00') - epoch_us(newest)) / 3600000000.0 as h
        from sources s left join run_counts using (source_id) left join latest_run l using (source_id) left join yields using (source_id)),
    q as (select *, greatest(0, least(1, 0.7 * success / greatest(success + errors, 1) + 0.3 * e / greatest(f, 1))) as health,
        greatest(0, least(1, 0.6 * relevant + 0.2 * least(tags / 5, 1) + 0.2 * linked)) as yield_,
        case when h is null then 0.2 when h <= 24 then 1 when h <= 72 then 0.8 when h <= 168 then 0.55 when h <= 720 then 0.3 else 0.15 end as fresh,
        errors / greatest(success + errors, 1) as share from j)
    select source_id, kind, cast(success as bigint) as success, cast(errors as bigint) as errors, last_status, round(cast(health as double), 5) as runtime_health,
        round(cast(yield_ as double), 5) as yield_score, round(cast(fresh as double), 5) as freshness,
        round(cast(greatest(0, least(1, 0.35 * authority + 0.30 * health + 0.20 * yield_ + 0.15 * fresh)) as double), 5) as source_score,
        case when kind in ('telegram', 'email') then 'native'
             when kind = 'web' then case when not full_content or last_status = 'error' or share >= 0.4 then 'listing-only' else 'full-content' end
             when kind in ('rss', 'api') then case when regexp_matches(last_error, '403|429') or share >= 0.45 or (f > 0 and e = 0) then 'summary-only' else 'full-content' end
             else 'summary-only' end as content_mode from q"""


def run_counts_filtered(spark, d):
    return _run_counts(spark, d)


def latest_run_top1(spark, d):
    return _latest_run(spark, d)


def source_details(spark, d):
    """Every source's ten latest runs beside its counts."""
    runs = top_k(V.source_runs(spark, d), ["source_id"], [F.desc("started_at"), F.desc("run_id")], 10, "n")
    return V.sources(spark, d).select("source_id", "kind").join(_run_counts(spark, d), "source_id", "left").join(runs, "source_id", "left")


def pipeline_status_stats(spark, d):
    return V.posts(spark, d).groupBy("status").agg(F.count("*").alias("posts"), F.round(F.avg("relevance"), 6).alias("avg_relevance"))


def recent_posts_preview(spark, d):
    """The twenty newest posts with a plain preview."""
    p = V.posts(spark, d).orderBy(F.desc_nulls_last("published_at"), F.desc("post_id")).limit(20)
    return p.select("post_id", "source_id", "published_at", "status", tx.preview(F.col("content"), 280).alias("preview"))


def workspace_overview(spark, d):
    """Posts, sources, done posts and newest post of each workspace; then its best trends' count is global."""
    p = V.posts(spark, d).filter(F.col("workspace").isNotNull())
    return p.groupBy("workspace").agg(
        F.count("*").alias("posts"),
        F.count_distinct("source_id").alias("sources"),
        F.count_if(F.col("status") == "done").alias("done"),
        F.count_if(F.col("published_at") >= as_of() - F.expr("interval 7 days")).alias("recent"),
        F.round(F.avg("relevance"), 6).alias("avg_relevance"),
        F.max("published_at").alias("newest"),
    )


def global_overview(spark, d):
    p = V.posts(spark, d)
    return p.agg(F.count("*").alias("posts"), F.count_distinct("source_id").alias("sources"), F.count_if(F.col("status") == "error").alias("errors"), F.max("published_at").alias("newest"))


def weekly_status_share(spark, d):
    """Share of each status among a model's calls of a week: events by type, rounded to four digits."""
    week = F.date_trunc("week", F.col("ts").cast("timestamp")).cast("date").alias("week")
    counts = V.table(spark, d, "events").groupBy(week, F.col("event_type").alias("status")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("week")), 4))


def manual_job_metrics(spark, d):
    """Of each kind of job: runs, failures, longest success and the newest success."""
    ok = F.col("status") == "success"
    return V.source_runs(spark, d).groupBy("source_id").agg(
        F.count("*").alias("runs"),
        F.count_if(~ok).alias("failed"),
        F.coalesce(F.max(F.when(ok, F.col("fetched"))), F.lit(0)).cast("bigint").alias("most_fetched"),
        F.max(F.when(ok, F.col("started_at"))).alias("last_success"),
    )


def album_rollup(spark, d):
    """Conversations as albums: turns, words, and whether a system turn is among them; latest first."""
    c = V.table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(
        F.count("*").alias("items"), F.max(F.coalesce("turn", F.lit(0))).alias("last_turn"), F.count_if(F.col("role") == "system").alias("system_items"), F.sum(F.length("text")).cast("bigint").alias("chars")
    ).orderBy(F.desc("items"), "conv_id")


def post_with_enrichments(spark, d):
    """Each post with what is known of it, kinds as a sorted list."""
    kinds = V.crawls(spark, d).select("post_id", F.lit("crawl").alias("kind")).unionByName(
        V.table(spark, d, "labels").select(F.col("doc_id").alias("post_id"), F.lit("valence").alias("kind"))
    ).unionByName(V.table(spark, d, "embeddings").select(F.col("vec_id").alias("post_id"), F.lit("vector").alias("kind")))
    listed = kinds.groupBy("post_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return V.posts(spark, d).select("post_id", "status").join(listed, "post_id", "left").select("post_id", "status", F.coalesce("kinds", F.lit("")).alias("kinds"))


def media_unnest_counts(spark, d):
    """Links inside posts' texts: how many posts and workspaces name each host."""
    found = V.posts(spark, d).select("post_id", "workspace", F.explode(tx.urls(F.concat_ws(" ", "content"), None)).alias("url"))
    pages = V.crawls(spark, d).select("post_id", F.lit("page").alias("workspace"), "url")
    return found.unionByName(pages).select("post_id", "workspace", tx.host(F.col("url")).alias("host")).groupBy("host").agg(
        F.count_distinct("post_id").alias("posts"), F.count_distinct("workspace").alias("workspaces"), F.count("*").alias("links")
    )


def semi_enriched(spark, d):
    """Done posts that have an enrichment, for a reindex."""
    return V.posts(spark, d).filter("status = 'done'").select("post_id", "source_id").join(V.crawls(spark, d).select("post_id"), "post_id", "left_semi")


def stale_runs(spark, d):
    """Runs of an error followed by a success of the same source are superseded."""
    w = Window.partitionBy("source_id").orderBy("started_at", "run_id")
    after = F.lead("status").over(w)
    state = F.when((F.col("status") == "error") & (after == "success"), "superseded").otherwise(F.col("status"))
    return V.source_runs(spark, d).withColumn("state", state).groupBy("source_id", "state").agg(F.count("*").alias("n"))


def reindex_documents(spark, d):
    """Index text of each post: content, crawl title and concepts in one row, missing parts left out."""
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    crawl = V.table(spark, d, "pages").select(F.col("page_id").alias("post_id"), F.left(title, F.lit(200)).alias("title"))
    concept = V.concepts(spark, d).groupBy(F.col("doc_id").alias("post_id")).agg(F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, 10), ", ").alias("concepts"))
    rows = V.posts(spark, d).select("post_id", "content").join(crawl, "post_id", "left").join(concept, "post_id", "left")
    text = F.concat_ws("\n", F.nullif("title", F.lit("")), F.left("content", F.lit(2200)), "concepts")
    return rows.select("post_id", F.col("title").isNotNull().alias("has_crawl"), F.length(text).cast("bigint").alias("chars"), F.md5(text).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        source_health, run_counts_filtered, latest_run_top1, source_details, pipeline_status_stats, recent_posts_preview, workspace_overview, global_overview,
        weekly_status_share, manual_job_metrics, album_rollup, post_with_enrichments, media_unnest_counts, semi_enriched, stale_runs, reindex_documents,
    )
}
ORACLES = {
    "source_health": SOURCE_HEALTH,
    "run_counts_filtered": f"with {V.SOURCE_RUNS}, {_RUN_COUNTS} select * from run_counts",
    "latest_run_top1": f"with {V.SOURCE_RUNS}, {_LATEST} select * from latest_run",
    "source_details": f"""with {V.SOURCES}, {V.SOURCE_RUNS}, {_RUN_COUNTS}, ten as (select * from (select *, row_number() over
        (partition by source_id order by started_at desc, run_id desc) as n from source_runs) where n <= 10)
        select source_id, kind, success, errors, last_started, run_id, status, started_at, fetched, emitted, error_text, cast(n as int) as n
        from sources left join run_counts using (source_id) left join ten using (source_id)""",
    "pipeline_status_stats": f"with {V.POSTS} select status, count(*) as posts, round(avg(relevance), 6) as avg_relevance from posts group by status",
    "recent_posts_preview": rf"""with {V.POSTS}, r as (select * from posts order by published_at desc nulls last, post_id desc limit 20)
        select post_id, source_id, published_at, status, left(trim(regexp_replace(regexp_replace(coalesce(content, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 280) as preview from r""",
    "workspace_overview": f"""with {V.POSTS} select workspace, count(*) as posts, count(distinct source_id) as sources, count(*) filter (where status = 'done') as done,
        count(*) filter (where published_at >= timestamp '2024-01-31 12:30:00' - interval 7 day) as recent, round(avg(relevance), 6) as avg_relevance, max(published_at) as newest
        from posts where workspace is not null group by workspace""",
    "global_overview": f"""with {V.POSTS} select count(*) as posts, count(distinct source_id) as sources, count(*) filter (where status = 'error') as errors, max(published_at) as newest from posts""",
    "weekly_status_share": """with c as (select cast(date_trunc('week', ts) as date) as week, event_type as status, count(*) as n from events group by all)
        select week, status, n, round(n / sum(n) over (partition by week), 4) as share from c""",
    "manual_job_metrics": f"""with {V.SOURCE_RUNS} select source_id, count(*) as runs, count(*) filter (where status <> 'success') as failed,
        cast(coalesce(max(fetched) filter (where status = 'success'), 0) as bigint) as most_fetched, max(started_at) filter (where status = 'success') as last_success
        from source_runs group by source_id""",
    "album_rollup": """select conv_id, count(*) as items, max(coalesce(turn, 0)) as last_turn, count(*) filter (where role = 'system') as system_items,
        cast(sum(length(text)) as bigint) as chars from conversations group by conv_id""",
    "post_with_enrichments": f"""with {V.POSTS}, k as (select page_id as post_id, 'crawl' as kind from pages union all select doc_id, 'valence' from labels union all select vec_id, 'vector' from embeddings),
        l as (select post_id, array_to_string(list_sort(list(distinct kind)), ',') as kinds from k group by post_id)
        select post_id, status, coalesce(kinds, '') as kinds from posts left join l using (post_id)""",
    "media_unnest_counts": rf"""with {V.POSTS}, {V.CRAWLS}, raw as (select post_id, workspace, unnest(regexp_extract_all(content, '{tx.URL.replace("'", "''")}')) as u from posts),
        f as (select distinct post_id, workspace, regexp_replace(u, '[.,;:!?]+$', '') as url from raw),
        h as (select post_id, workspace, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) as host from f
              where regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www[.]', '') not in ({", ".join(f"'{x}'" for x in tx.SOCIAL_HOSTS)})
              union all select post_id, 'page', lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) from crawls),
        g as (select post_id, workspace, regexp_replace(host, '^www\.', '') as host from h)
        select host, count(distinct post_id) as posts, count(distinct workspace) as workspaces, count(*) as links from g group by host""",
    "semi_enriched": f"with {V.POSTS}, {V.CRAWLS} select post_id, source_id from posts where status = 'done' and post_id in (select post_id from crawls)",
    "stale_runs": f"""with {V.SOURCE_RUNS}, w as (select source_id, status, lead(status) over (partition by source_id order by started_at, run_id) as nx from source_runs)
        select source_id, case when status = 'error' and nx = 'success' then 'superseded' else status end as state, count(*) as n from w group by all""",
    "reindex_documents": f"""with {V.POSTS}, {V.CONCEPTS}, cr as (select page_id as post_id, left(regexp_extract(html, '<title>([^<]*)</title>', 1), 200) as title from pages),
        co as (select doc_id as post_id, array_to_string(list_slice(list_sort(list(distinct name)), 1, 10), ', ') as concepts from concepts group by doc_id),
        t as (select post_id, title, concat_ws(chr(10), nullif(title, ''), left(content, 2200), concepts) as text from posts left join cr using (post_id) left join co using (post_id))
        select post_id, title is not null as has_crawl, cast(length(text) as bigint) as chars, md5(text) as digest from t""",
}
