"""Signals: groups of semantic clusters with their series, scores and stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import scores as S, vectors as v
from tidemark.operators import clusters as C, ranking, series as T

#: Hours in which a change point counts as recent, and shortest series that can have one.
RECENT_HOURS, SHORTEST = 48, 4


def last_change(series: DataFrame, keys: list[str], now: Column, value: str = "doc_count", factor: float = 1.5) -> DataFrame:
    """``(keys, changes, change_strength, recent_change)`` of each series by the difference rule: steps of at least
    ``factor`` times the mean step, and 1. The strength is the last such step, else that from the first bucket to the
    last, as a share of the largest bucket. A group has one row for each bucket of time."""
    w, whole = Window.partitionBy(*keys).orderBy("window_start"), Window.partitionBy(*keys)
    rows = series.select(*keys, "window_start", "window_end", F.col(value).cast("double").alias("x"))
    rows = rows.withColumn("step", F.abs(F.col("x") - F.lag("x").over(w)))
    rows = rows.withColumn("change", F.coalesce(F.col("step") >= F.greatest(factor * F.avg("step").over(whole), F.lit(1.0)), F.lit(False)))
    change = F.when(F.col("change"), F.struct("window_end", "step"))
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max("x").alias("top"), F.min_by("x", "window_start").alias("first"), F.max_by("x", "window_start").alias("last"),
        F.max(change).alias("c"), F.count_if("change").alias("k"),
    )
    long = F.col("n") >= SHORTEST
    step = F.coalesce(F.col("c.step"), F.abs(F.col("last") - F.col("first")))
    recent = F.col("c.window_end") >= now - F.make_dt_interval(F.lit(0), F.lit(RECENT_HOURS), F.lit(0), F.lit(0))
    return found.select(
        *keys, F.when(long, F.col("k")).otherwise(0).alias("changes"), F.when(long, step / F.greatest("top", F.lit(1.0))).otherwise(0.0).alias("change_strength"),
        F.when(long, F.coalesce(recent, F.lit(False))).otherwise(False).alias("recent_change"),
    )


def group_clusters(members: DataFrame, theta: float, gap_hours: float) -> DataFrame:
    """``(workspace, cluster, signal)``: components of clusters whose centroids are alike and that were last seen within
    the gap; ``members(workspace, cluster, published_at, vector)``."""
    keys = ["workspace", "cluster"]
    seen = members.groupBy(*keys).agg(F.max("published_at").alias("published_at"))
    points = v.centroids(members, keys, "vector").join(seen, keys).select("workspace", F.col("cluster").alias("post_id"), F.col("centroid").alias("vector"), "published_at")
    return C.cluster_posts(points, theta, gap_hours).select("workspace", F.col("post_id").alias("cluster"), F.col("cluster").alias("signal"))


def score_signals(members: DataFrame, keys: list[str], now: Column, hours: int = 24) -> DataFrame:
    """A row for each signal: what it holds, its series' momentum and changes, score, stage and confidence.

    ``members(keys, cluster, post_id, source_id, published_at, content, relevance, vector, concepts)`` has a row for
    each post of a signal's clusters."""
    concepts = ranking.most_common(members.select(*keys, "cluster", F.explode("concepts").alias("concept")), [*keys, "cluster"], "concept", 8)
    keywords = ranking.most_common(concepts, keys, "concept", 8).groupBy(*keys).agg(F.count("*").alias("keywords"))
    close = C.coherence(members, keys, "vector").select(*keys, "coherence")
    per_cluster = members.groupBy(*keys, "cluster").agg(F.avg("relevance").alias("relevance"), F.least(F.count("*"), F.lit(2)).alias("evidence"))
    clusters = per_cluster.groupBy(*keys).agg(F.count("*").alias("clusters"), F.avg("relevance").alias("relevance"), F.least(F.sum("evidence"), F.lit(6)).alias("evidence"))
    joke = S.april_joke(F.col("published_at"), F.lit(""), F.col("content"))
    posts = members.groupBy(*keys).agg(
        F.count_distinct("post_id").alias("docs"), F.count_distinct("source_id").alias("sources"), F.max("published_at").alias("last_seen"), F.avg(F.when(joke, 1.0).otherwise(0.0)).alias("jokes"),
        F.count_if(F.col("published_at") >= now - F.make_dt_interval(F.lit(7), F.lit(0), F.lit(0), F.lit(0))).alias("recent"),
    )
    series = T.buckets(members, keys, "published_at", hours, {})
    rows = posts.join(clusters, keys).join(close, keys).join(T.momentum(series, keys, now, hours), keys).join(last_change(series, keys, now), keys)
    rows = rows.join(keywords, keys, "left").withColumn("keywords", F.coalesce("keywords", F.lit(0)))
    idle = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))) / 3_600_000_000
    diversity = S.diversity(F.col("sources"), F.col("clusters"))
    multiplier, blocked = S.april_penalty(F.round("jokes", 4))
    rows = rows.withColumns(
        {
            "diversity": diversity, "strength": S.evidence_strength(F.col("evidence"), 2, F.col("relevance")), "burst": S.burst(F.col("recent"), F.col("docs"), F.col("clusters")),
            "novelty": F.least(F.lit(1.0), F.least(F.col("keywords"), F.lit(5)) / 5 * 0.5 + diversity * 0.5), "multiplier": F.round(multiplier, 4), "blocked": blocked,
        }
    )
    terms = [F.col(x) for x in ("burst", "velocity", "acceleration", "coherence", "novelty", "diversity")]
    score = S.signal_score(*terms, S.freshness(idle), F.col("strength"), F.col("change_strength"))
    rows = rows.withColumn("score", F.round(score * F.col("multiplier"), 6))
    stage = S.signal_stage(
        F.col("clusters"), F.col("docs"), F.col("sources"), F.col("score"), F.col("diversity"), F.col("recent_change"), F.col("velocity"), F.col("acceleration"), F.col("evidence"), idle > 240, F.col("blocked"),
    )
    return rows.withColumn("stage", stage).withColumn("confidence", S.confidence(F.col("coherence"), F.col("strength"), F.col("diversity")))


def without_weak(signals: DataFrame) -> DataFrame:
    """Signals without the weak ones that fall short of the score, confidence, diversity or sources to be kept."""
    short = (F.col("score") < 0.42) | (F.col("confidence") < 0.52) | (F.col("diversity") < 0.2) | (F.col("sources") < 1)
    return signals.filter(~((F.col("stage") == "weak") & short))
