"""Series, momentum, signals, alerts and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import views as V
from tidemark.functions import scores as S, text as tx
from tidemark.operators import cluster_job as cluster_run, clusters as C, ranking, series as T, signals as G
from tidemark.plans.catalog import OVERLAP, topic_overlap
from tidemark.storage import materialize
from tidemark.views import as_of, hours_before


def _events(spark, d) -> DataFrame:
    return V.table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "value", "user_id")


def _series(spark, d, hours: int = 24) -> DataFrame:
    return T.buckets(_events(spark, d), ["event_type"], "ts", hours, {"avg_value": F.round(F.avg("value"), 6), "last_at": F.max("ts")})


def series_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _series(spark, d, 6)


def temporal_metrics(spark, d):
    return T.momentum(_series(spark, d), ["event_type"], as_of())


def change_points_diff(spark, d):
    out = T.jumps(_series(spark, d), ["event_type"])
    return out.select("event_type", "window_start", "doc_count", F.round("step", 6).alias("step"), F.round("limit", 6).alias("limit"), F.round("strength", 6).alias("strength"))


def change_points_pelt(spark, d):
    """Exact segmentation of each user's daily value; arrays as text."""
    per_user = T.buckets(_events(spark, d).withColumn("entity", F.col("user_id") % 50), ["entity"], "ts", 24, {})
    return T.change_points(per_user, "entity").select("entity", F.array_join("breakpoints", ",").alias("breakpoints"), "strength")


def merged_series(spark, d):
    """Clicks, views and the rest as two merged series."""
    s = _series(spark, d).withColumn("family", F.when(F.col("event_type").isin("click", "view"), "traffic").otherwise("other"))
    out = T.merge_series(s, ["family"])
    return out.withColumn("avg_value", F.round("avg_value", 4))


def counter_increase(spark, d):
    """Growth of a counter that restarts each day: the running number of a type's events in the day."""
    from pyspark.sql import Window

    w = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "value")
    samples = _events(spark, d).withColumn("n", F.row_number().over(w).cast("double"))
    return T.counter_increase(samples, ["event_type"], "ts", "n")


def signal_timeline(spark, d):
    """Daily series of purchases with its momentum beside each bucket."""
    s = _series(spark, d).filter("event_type = 'purchase'")
    return s.join(T.momentum(s, ["event_type"], as_of()), "event_type").select("window_start", "doc_count", "rate", "velocity", "acceleration")


def _stored(spark, d) -> DataFrame:
    """Posts of stored signals: their clusters and topics are ids that the view gives them."""
    p = V.posts(spark, d).filter("workspace is not null and source_id is not null and status = 'done'")
    vectors = V.points(spark, d).select("post_id", "vector")
    return p.join(vectors, "post_id").select(
        "workspace", (F.col("post_id") % 8).alias("topic"), (F.col("post_id") % 64).alias("cluster"), "post_id", "source_id", "published_at", "content", "relevance", "vector", tx.terms(F.col("content")).alias("concepts")
    )


_SCORES = ("burst", "coherence", "novelty", "diversity", "strength", "velocity", "acceleration", "change_strength", "multiplier", "score", "confidence")


def _scored(signals: DataFrame, *keys: str) -> DataFrame:
    return signals.select(*keys, "docs", "sources", "clusters", "evidence", "keywords", "changes", "recent_change", "blocked", *[F.round(c, 6).alias(c) for c in _SCORES], "stage")


def signal_scores(spark, d):
    """Stored signals scored anew: all terms of the score, the stage and the confidence."""
    return _scored(G.score_signals(_stored(spark, d), ["workspace", "topic"], as_of()), "workspace", "topic")


def signal_job(spark, d):
    """The whole job over embedded posts: semantic clusters, their grouping by centroid, series, scores and stages, without
    weak signals that fall short. Thresholds are low as the tables' vectors are nearly orthogonal."""
    posts = V.posts(spark, d).select("post_id", "source_id", "content", "relevance", tx.terms(F.col("content")).alias("concepts"))
    points = V.points(spark, d)
    found = materialize(C.cluster_posts(points, 0.3, 96).select("post_id", "cluster"), "semantic")
    members = materialize(points.join(found, "post_id"), "members")
    groups = materialize(G.group_clusters(members, 0.25, 720), "groups")
    rows = members.join(groups, ["workspace", "cluster"]).join(posts, "post_id")
    return _scored(G.without_weak(G.score_signals(rows, ["workspace", "signal"], as_of())), "workspace", "signal")


def cluster_job(spark, d):
    """Two runs of the clustering job over embedded posts: one over the first half of the month, then one over the last ten days, which
    continues, adds and ages clusters."""
    posts = V.posts(spark, d).select("post_id", F.slice(F.array_distinct(tx.terms(F.col("content"))), 1, 5).alias("title_terms"), F.array(F.concat(F.lit("c"), (F.col("post_id") % 9).cast("string"))).alias("concepts"))
    points = V.points(spark, d)
    early, late = F.lit("2024-01-16").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz")
    stored = materialize(cluster_run.run(points.filter(F.col("published_at") < early), posts, None, early, 0.3, 96), "stored-clusters")
    out = cluster_run.run(points.filter(F.col("published_at") >= late), posts, stored, F.lit("2024-01-28").cast("timestamp_ntz"), 0.3, 96)
    return out.select("workspace", "cluster", "state", F.size("doc_ids").alias("docs"), "first_seen", "last_seen", "runs")


def stage_counts(spark, d):
    return signal_scores(spark, d).groupBy("workspace", "stage").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"))


def lifecycle_states(spark, d):
    """Clusters of a source after a run that touched those with a new post in the last day."""
    c = V.posts(spark, d).filter("source_id is not null").groupBy("source_id", (F.col("post_id") % 7).alias("topic")).agg(F.max("published_at").alias("last"), F.max("post_id").alias("newest"))
    state = F.when(F.col("newest") % 5 == 0, "archived").when(F.col("newest") % 5 == 1, "cooling").otherwise("active")
    idle = hours_before(F.col("last"))
    return c.select("source_id", "topic", state.alias("before"), S.lifecycle(state, idle < 24, idle).alias("state"))


def april_fools_guard(spark, d):
    """Posts moved to 1 April, with a cue in those of one topic: share, multiplier and block by source."""
    p = V.posts(spark, d).filter("source_id is not null")
    moved = p.select(
        "source_id", F.when(F.col("post_id") % 3 == 0, F.lit("2024-04-01 12:00:00").cast("timestamp_ntz")).otherwise(F.col("published_at")).alias("at"),
        F.when(F.col("post_id") % 2 == 0, F.concat(F.lit("April Fool "), "content")).otherwise(F.col("content")).alias("content"),
    )
    flag = S.april_joke(F.col("at"), F.lit(""), F.col("content"))
    shares = moved.groupBy("source_id").agg(F.avg(F.when(flag, 1.0).otherwise(0.0)).alias("share"))
    multiplier, blocked = S.april_penalty(F.col("share"))
    return shares.select("source_id", F.round("share", 6).alias("share"), F.round(multiplier, 6).alias("multiplier"), blocked.alias("blocked"))


def _alerts(spark, d) -> DataFrame:
    t = V.trends(spark, d)
    return t.withColumn("reason", S.alert_reason(F.col("doc_count"), F.col("source_count"), F.col("signal_score"), F.col("recent_change"), F.col("strength"))).filter("reason is not null")


def alert_candidates_anti(spark, d):
    """Trends worth an alert that were not sent one: orders with an urgent priority stand for sent alerts."""
    sent = V.table(spark, d, "orders").filter(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("cluster_key"))
    return _alerts(spark, d).join(sent, "cluster_key", "left_anti").orderBy(F.desc("signal_score"), "cluster_key").limit(50).select("cluster_key", "workspace", "signal_score", "reason")


def weekly_alert_capacity(spark, d):
    """What each workspace may still send after what it sent in the last seven days."""
    now = F.lit("1998-12-01").cast("timestamp_ntz")
    sent = _alerts(spark, d).groupBy("workspace").agg(F.count_if((F.col("detected_at") >= now - F.expr("interval 7 days")) & (F.col("detected_at") < now)).alias("sent"))
    return sent.withColumn("capacity", F.greatest(F.lit(0), 20 - F.col("sent")).cast("bigint"))


def alert_budget(spark, d):
    """The two best alerts of each workspace and the message's first line."""
    best = ranking.top_k(_alerts(spark, d), ["workspace"], [F.desc("signal_score"), F.asc("cluster_key")], 2, "n")
    line = F.concat_ws(" ", F.when(F.col("reason") == "high_score", "Strong signal").otherwise("Turning point"), F.concat(F.lit("#"), F.col("cluster_key").cast("string")))
    return best.select("workspace", "cluster_key", "n", F.left(line, F.lit(40)).alias("line"))


def external_strength(spark, d):
    """Coverage of topics on outside pages, five results asked for: results, different hosts and mean score of each topic."""
    pages = V.table(spark, d, "pages").select("page_id", (F.col("page_id") % 25).alias("topic"), tx.netloc(F.col("url")).alias("host"), (F.col("page_id") % 7 / 2).alias("score"))
    best = ranking.top_k(pages, ["topic"], [F.desc("score"), F.asc("page_id")], 5)
    g = best.groupBy("topic").agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts"), F.avg("score").alias("mean"))
    return g.select("topic", "n", "hosts", F.round(S.external_strength(F.col("n"), 5, F.col("hosts"), F.col("mean")), 6).alias("strength"))


def gap_scores(spark, d):
    """Outside coverage that the own signals lack, by topic. Signals are posts, whose terms they hold; topics are the
    benchmark's items, matched as in ``topic_overlap``; a stable signal weighs 1.25, an emerging one 1.1, others 1."""
    weight = F.when(F.col("status") == "done", 1.25).when(F.col("status") == "pending", 1.1).otherwise(1.0)
    own = topic_overlap(spark, d).join(V.posts(spark, d).select("post_id", weight.alias("weight")), "post_id")
    own = own.groupBy("topic").agg(F.sum(F.col("weight") * F.col("overlap")).alias("frequency"))
    both = external_strength(spark, d).select("topic", "strength").join(own, "topic", "left").withColumn("frequency", F.coalesce("frequency", F.lit(0.0)))
    return both.select("topic", "strength", F.round("frequency", 4).alias("frequency"), F.round(S.gap(F.col("strength"), F.col("frequency")), 6).alias("gap"))


_SERIES = """series as (select event_type, {start} as window_start, count(*) as doc_count, round(avg(value), 6) as avg_value, max(ts) as last_at,
    {start} + to_hours({h}) as window_end, round(count(*) / {h}, 6) as rate from events group by 1, 2)"""
_DAY = _SERIES.format(start="date_trunc('day', ts)::timestamp", h=24)
_SIX = _SERIES.format(start="date_trunc('day', ts)::timestamp + to_hours(cast(hour(ts) // 6 * 6 as bigint))", h=6)
_MOMENTUM = """m as (select event_type, coalesce(sum(doc_count) filter (where window_end >= a - interval 24 hour), 0) as cur,
    coalesce(sum(doc_count) filter (where window_end >= a - interval 48 hour and window_end < a - interval 24 hour), 0) as prev,
    coalesce(sum(doc_count) filter (where window_end >= a - interval 14 day and window_end < a - interval 24 hour), 0) as base,
    count(*) filter (where window_end >= a - interval 14 day and window_end < a - interval 24 hour) as n
    from series, (select timestamp '2024-01-31 12:30:00' as a) group by event_type),
    mm as (select event_type, round(cur / 24, 6) as current_rate, round(prev / 24, 6) as previous_rate, round(base / greatest(n * 24, 24), 6) as baseline_rate from m),
    momentum as (select *, round(current_rate - baseline_rate, 6) as velocity, round(current_rate - previous_rate, 6) as acceleration from mm)"""
_SIGNALS = f"""{V.POSTS}, {V.POINTS}, now as (select timestamp '2024-01-31 12:30:00' as a),
    m as (select p.workspace, p.post_id % 8 as topic, p.post_id % 64 as cluster, p.post_id, source_id, p.published_at, content, relevance, vector
        from posts p join points v using (post_id) where p.workspace is not null and source_id is not null and status = 'done'),
    tc as (select workspace, topic, cluster, t, count(*) as n from (select *, unnest(regexp_extract_all(lower(content), '{tx.TERM}')) as t from m) group by all),
    tr as (select *, row_number() over (partition by workspace, topic, cluster order by n desc, t) as r from tc),
    kw as (select workspace, topic, least(count(distinct t), 8) as keywords from tr where r <= 8 group by all),
    pl as (select workspace, topic, i, avg(vector[i]) as x from m, (select unnest(range(1, 65)) as i) group by all),
    ce as (select workspace, topic, list(x order by i) as centroid from pl group by all),
    co as (select workspace, topic, avg(list_cosine_similarity(vector, centroid)) as coherence from m join ce using (workspace, topic) group by all),
    pc as (select workspace, topic, cluster, avg(relevance) as relevance, least(count(*), 2) as evidence from m group by all),
    cl as (select workspace, topic, count(*) as clusters, avg(relevance) as relevance, least(sum(evidence), 6) as evidence from pc group by all),
    po as (select workspace, topic, count(distinct post_id) as docs, count(distinct source_id) as sources, max(published_at) as last_seen,
        round(avg(case when month(published_at) = 4 and day(published_at) <= 2 and regexp_matches(lower(left(content, 800)), '{"|".join(S.APRIL_CUES)}') then 1.0::double else 0.0::double end), 4) as jokes,
        count(*) filter (where published_at >= a - interval 7 day) as recent from m, now group by all),
    se as (select workspace, topic, date_trunc('day', published_at)::timestamp as s, count(*)::double as x from m group by all),
    mo as (select workspace, topic, round(coalesce(sum(x) filter (where s + interval 24 hour >= a - interval 24 hour), 0) / 24, 6) as cur,
        round(coalesce(sum(x) filter (where s + interval 24 hour >= a - interval 48 hour and s + interval 24 hour < a - interval 24 hour), 0) / 24, 6) as prev,
        round(coalesce(sum(x) filter (where s + interval 24 hour >= a - interval 14 day and s + interval 24 hour < a - interval 24 hour), 0)
            / greatest(24 * count(*) filter (where s + interval 24 hour >= a - interval 14 day and s + interval 24 hour < a - interval 24 hour), 24), 6) as base from se, now group by all),
    st as (select *, abs(x - lag(x) over (partition by workspace, topic order by s)) as step from se),
    sc as (select *, coalesce(step >= greatest(1.5 * avg(step) over (partition by workspace, topic), 1), false) as change from st),
    ch as (select workspace, topic, count(*) as n, max(x) as top, arg_min(x, s) as first, arg_max(x, s) as last, arg_max(step, s) filter (where change) as step,
        max(s + interval 24 hour) filter (where change) as seen, count(*) filter (where change) as k from sc group by all),
    j as (select workspace, topic, docs, sources, clusters, cast(evidence as bigint) as evidence, coalesce(keywords, 0) as keywords, case when n >= 4 then k else 0 end as changes,
        n >= 4 and coalesce(seen >= a - interval 48 hour, false) as recent_change, jokes >= 0.34::double as blocked, least(1, recent / greatest(docs, 1) + least(clusters, 4) * 0.08::double) as burst, coherence,
        case when sources <= 1 then 0.0::double else least(1, sources / greatest(clusters, 2)) end as diversity, least(1, evidence / 2 * 0.5::double + relevance * 0.5::double) as strength,
        round(cur - base, 6) as velocity, round(cur - prev, 6) as acceleration, case when n >= 4 then coalesce(step, abs(last - first)) / greatest(top, 1) else 0.0::double end as change_strength,
        round(greatest(0, 1 - jokes * 0.45::double), 4) as multiplier, (epoch_us(a) - epoch_us(last_seen)) / 3600000000.0 as idle
        from po join cl using (workspace, topic) join co using (workspace, topic) join mo using (workspace, topic) join ch using (workspace, topic) left join kw using (workspace, topic), now),
    x as (select *, least(1, least(keywords, 5) / 5 * 0.5::double + diversity * 0.5::double) as novelty,
        case when idle <= 24 then 1 when idle <= 72 then 0.75::double when idle <= 168 then 0.45::double else 0.2::double end as fresh from j),
    z as (select *, round(cast(greatest(0, least(1, 0.18 * burst + 0.14 * velocity + 0.10 * acceleration + 0.20 * coherence + 0.12 * novelty + 0.12 * diversity + 0.08 * fresh + 0.06 * strength
        + 0.14 * change_strength)) * multiplier as double), 6) as score from x),
    g as (select *, case when clusters >= 2 and docs >= 4 and sources >= 1 and diversity >= 0.2 and score >= 0.58 and (recent_change or velocity > 0) then 'stable'
             when score >= 0.42 and evidence >= 2 and sources >= 1 and diversity >= 0.2 and (recent_change or velocity > 0 or acceleration > 0) then 'emerging'
             when idle > 240 or (velocity <= 0 and not recent_change) then 'fading' else 'weak' end as reached from z),
    signals as (select workspace, topic, docs, sources, clusters, evidence, keywords, changes, recent_change, blocked, round(burst, 6) as burst, round(coherence, 6) as coherence, round(novelty, 6) as novelty,
        round(diversity, 6) as diversity, round(strength, 6) as strength, velocity, acceleration, round(change_strength, 6) as change_strength, multiplier, score,
        round(cast(least(1, 0.45 * coherence + 0.30 * strength + 0.25 * diversity) as double), 6) as confidence, case when blocked and reached in ('stable', 'emerging') then 'weak' else reached end as stage from g)"""
_ALERTS = f"""{V.TRENDS}, alerts as (select * from (select *, case when doc_count >= 5 and source_count >= 3 and signal_score >= 0.8 then 'high_score'
    when doc_count >= 5 and source_count >= 3 and recent_change and signal_score >= 0.74 and strength >= 0.7 then 'change_point' end as reason from trends) where reason is not null)"""
_EXTERNAL = r"""pg as (select page_id % 25 as topic, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) as host, page_id % 7 / 2 as score,
        row_number() over (partition by page_id % 25 order by page_id % 7 desc, page_id) as r from pages),
    ext as (select topic, n, hosts, round(cast(least(1, 0.55 * n / 5 + 0.30 * hosts / 5 + 0.15 * least(mean / 3, 1)) as double), 6) as strength
    from (select topic, count(*) as n, count(distinct host) as hosts, avg(score) as mean from pg where r <= 5 group by 1))"""

QUERIES = {
    f.__name__: f
    for f in (
        series_buckets, temporal_metrics, change_points_diff, change_points_pelt, merged_series, counter_increase, signal_timeline, signal_scores, signal_job, cluster_job, stage_counts, lifecycle_states,
        april_fools_guard, alert_candidates_anti, weekly_alert_capacity, alert_budget, external_strength, gap_scores,
    )
}
ORACLES = {
    "series_buckets": f"with {_SIX} select * from series",
    "temporal_metrics": f"with {_DAY}, {_MOMENTUM} select * from momentum",
    "change_points_diff": f"""with {_DAY}, s as (select *, abs(doc_count - lag(doc_count) over (partition by event_type order by window_start)) as step, max(doc_count) over (partition by event_type) as top from series),
        l as (select *, greatest(1.5 * avg(step) over (partition by event_type), 1) as lim from s)
        select event_type, window_start, doc_count, step, round(cast(lim as double), 6) as "limit", round(step / greatest(top, 1), 6) as strength from l where step >= lim""",
    "merged_series": f"""with {_DAY} select case when event_type in ('click', 'view') then 'traffic' else 'other' end as family, window_start, window_end, cast(sum(doc_count) as bigint) as doc_count,
        round(avg(avg_value), 4) as avg_value, max(last_at) as last_at from series group by 1, 2, 3""",
    "counter_increase": """with s as (select event_type, ts, row_number() over (partition by event_type, cast(ts as date) order by ts, value) as n from events),
        l as (select event_type, n, lag(n) over (partition by event_type order by ts) as p from s)
        select event_type, cast(sum(case when p is null then 0 when n < p then n else n - p end) as double) as increase from l group by event_type""",
    "signal_timeline": f"with {_DAY}, {_MOMENTUM} select window_start, doc_count, rate, velocity, acceleration from series join momentum using (event_type) where event_type = 'purchase'",
    "signal_scores": f"with {_SIGNALS} select * from signals",
    "stage_counts": f"with {_SIGNALS} select workspace, stage, count(*) as n, max(score) as best from signals group by all",
    "lifecycle_states": f"""with {V.POSTS}, c as (select source_id, post_id % 7 as topic, max(post_id) as newest,
        (epoch_us(timestamp '2024-01-31 12:30:00') - epoch_us(max(published_at))) / 3600000000.0 as idle from posts where source_id is not null group by 1, 2),
        b as (select *, case newest % 5 when 0 then 'archived' when 1 then 'cooling' else 'active' end as before from c)
        select source_id, topic, before, case when idle >= 24 and idle > 336 and before <> 'archived' then 'archived'
            when idle >= 24 and idle > 48 and idle <= 336 and before not in ('cooling', 'archived') then 'cooling' else before end as state from b""",
    "april_fools_guard": f"""with {V.POSTS}, s as (select source_id, avg(case when post_id % 3 = 0 and regexp_matches(lower(left(case when post_id % 2 = 0 then 'April Fool ' else '' end || content, 799)), '{"|".join(S.APRIL_CUES)}')
        then 1.0::double else 0.0::double end) as share from posts where source_id is not null group by 1)
        select source_id, round(share, 6) as share, round(greatest(0, 1 - share * 0.45), 6) as multiplier, share >= 0.34 as blocked from s""",
    "alert_candidates_anti": f"""with {_ALERTS} select cluster_key, workspace, signal_score, reason from alerts where not exists (select 1 from orders o where o.o_orderkey = cluster_key and starts_with(o.o_orderpriority, '1'))
        order by signal_score desc, cluster_key limit 50""",
    "weekly_alert_capacity": f"""with {_ALERTS}, s as (select workspace, count(*) filter (where detected_at >= timestamp '1998-11-24' and detected_at < timestamp '1998-12-01') as sent from alerts group by 1)
        select workspace, sent, cast(greatest(0, 20 - sent) as bigint) as capacity from s""",
    "alert_budget": f"""with {_ALERTS}, r as (select *, cast(row_number() over (partition by workspace order by signal_score desc, cluster_key) as int) as n from alerts)
        select workspace, cluster_key, n, left(case when reason = 'high_score' then 'Strong signal' else 'Turning point' end || ' #' || cluster_key, 40) as line from r where n <= 2""",
    "external_strength": f"with {_EXTERNAL} select * from ext",
    "gap_scores": f"""with {OVERLAP}, {_EXTERNAL}, own as (select topic, sum(overlap * case status when 'done' then 1.25::double when 'pending' then 1.1::double else 1.0::double end) as f
            from shares join posts using (post_id) group by topic)
        select topic, strength, round(coalesce(f, 0), 4) as frequency, round(cast(greatest(0, strength - least(1, coalesce(f, 0) / 3.5)) as double), 6) as gap from ext left join own using (topic)""",
}
