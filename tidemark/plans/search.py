"""Dense, sparse and hybrid search, and what follows a search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import views as V
from tidemark.functions import scores as S, text as tx, vectors as v
from tidemark.operators import ranking
from tidemark.views import hours_before

_QUERY_WORDS = ["the", "der", "tion", "lichkeit", "que"]


def _query_vector(spark, d) -> DataFrame:
    """The stored vector of point 7, one row, in place of an embedded query."""
    return V.points(spark, d).filter("post_id = 7").select(F.col("vector").alias("q"))


def _dense(spark, d) -> DataFrame:
    p = V.points(spark, d).crossJoin(F.broadcast(_query_vector(spark, d)))  # one row
    return p.withColumn("similarity", v.cosine(F.col("vector"), F.col("q"))).drop("q", "vector")


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d).orderBy(F.desc("similarity"), "post_id").limit(20).select("post_id", F.round("similarity", 6).alias("similarity"))


def knn_filtered(spark, d):
    """Search within three groups and a span of time; filters come before any product."""
    lo = F.lit("2024-01-03").cast("timestamp_ntz")
    p = V.points(spark, d).filter(F.col("workspace").isin(1, 2, 3) & (F.col("published_at") >= lo)).crossJoin(F.broadcast(_query_vector(spark, d)))
    p = p.withColumn("similarity", v.cosine(F.col("vector"), F.col("q")))
    return p.orderBy(F.desc("similarity"), "post_id").limit(20).select("post_id", "workspace", F.round("similarity", 6).alias("similarity"))


def bm25_topk(spark, d):
    docs = V.posts(spark, d).select("post_id", tx.terms(F.col("content")).alias("tokens"))
    return ranking.bm25(docs, "post_id", "tokens", _QUERY_WORDS).orderBy(F.desc(F.round("score", 6)), "post_id").limit(20).select("post_id", F.round("score", 6).alias("score"))


def rank_boost(spark, d):
    """Nearest hits ranked again by source score and freshness; the boost needs a recent reference time."""
    p = _dense(spark, d).join(V.posts(spark, d).select("post_id", "source_id"), "post_id").join(F.broadcast(V.sources(spark, d).select("source_id", "authority")), "source_id", "left")
    boost = S.freshness_boost(hours_before(F.col("published_at"), F.lit("2024-01-10").cast("timestamp_ntz")))
    hits = p.withColumn("score", S.search_rank(F.round("similarity", 6), F.col("authority"), boost))
    return hits.orderBy(F.desc(F.round("score", 6)), "post_id").limit(20).select("post_id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


def rrf_hybrid(spark, d):
    """Dense and sparse lanes of 100, fused by reciprocal ranks."""
    dense = _dense(spark, d).orderBy(F.desc("similarity"), "post_id").limit(100)
    docs = V.posts(spark, d).select("post_id", tx.terms(F.col("content")).alias("tokens"))
    sparse = ranking.bm25(docs, "post_id", "tokens", _QUERY_WORDS).withColumn("similarity", F.round("score", 6)).orderBy(F.desc("similarity"), "post_id").limit(100)
    lanes = [_ranked(x) for x in (dense.select("post_id", F.round("similarity", 9).alias("similarity")), sparse.select("post_id", "similarity"))]
    return ranking.fuse_ranks(lanes, "post_id").orderBy(F.desc(F.round("score", 9)), "post_id").limit(20).select("post_id", F.round("score", 9).alias("score"), "lanes")


def _ranked(lane: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return lane.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), F.asc("post_id"))))  # a lane is a limited list


def trend_search(spark, d):
    """Trends of two stages, ranked by their own numbers."""
    t = V.trends(spark, d).filter(F.col("stage").isin("stable", "emerging"))
    score = S.trend_rank(F.col("signal_score"), F.col("signal_score"), F.col("strength"), F.col("source_count"))
    return t.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "cluster_key").limit(25).select("cluster_key", "stage", "score")


def first_per_cluster(spark, d):
    """The best hit of each cluster, six at most; hits without a cluster all count."""
    cluster = F.when(F.col("post_id") % 5 != 0, F.col("workspace"))
    p = _dense(spark, d).withColumn("cluster", cluster).withColumn("s", F.round("similarity", 6))
    out = ranking.first_of_each(p, F.col("cluster"), [F.desc("s"), F.asc("post_id")], 6)
    return out.select("post_id", "cluster", F.col("s").alias("similarity"))


def entity_evidence_top3(spark, d):
    """Of each named term the three most relevant posts that contain it."""
    names = spark.sql("select explode(array('the', 'und', 'que', 'les', 'tion')) as entity")  # the request's entities
    p = V.posts(spark, d).select("post_id", "relevance", F.lower("content").alias("low"))
    hits = p.crossJoin(F.broadcast(names)).filter(F.expr("contains(low, entity)"))
    return ranking.top_k(hits.drop("low"), ["entity"], [F.desc("relevance"), F.asc("post_id")], 3, "rank")


def balanced_lanes(spark, d):
    """Three lanes of one search: the main one, a contrary one and a regional one."""
    p = _dense(spark, d).withColumn("s", F.round("similarity", 6))
    lanes = [("main", F.col("workspace") % 3 != 0), ("counter", F.col("workspace") % 3 == 0), ("region", F.col("workspace") == 4)]
    parts = [p.filter(f).orderBy(F.desc("s"), "post_id").limit(5).select(F.lit(n).alias("lane"), "post_id", F.col("s").alias("similarity")) for n, f in lanes]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def blind_spots(spark, d):
    """What each workspace lacks, as a list of reasons."""
    p = V.posts(spark, d).filter("workspace is not null")
    g = p.groupBy("workspace").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("sources"), F.count_if(F.col("relevance") < 0.5).alias("negative"))
    reasons = F.array_compact(F.array(F.when(F.col("n") < 200, "few posts"), F.when(F.col("sources") < 21, "few sources"), F.when(F.col("negative") == 0, "no contrary voice")))
    return g.select("workspace", F.array_join(reasons, "; ").alias("blind_spots"))


_DENSE = f"""{V.POINTS}, q as (select vector as q from points where post_id = 7),
    dense as (select post_id, workspace, published_at, list_cosine_similarity(vector, q) as similarity from points, q)"""
_BM25 = f"""{V.POSTS}, tok as (select post_id, regexp_extract_all(lower(content), '{tx.TERM}') as t from posts), whole as (select count(*) as docs, avg(len(t)) as mean from tok),
    post as (select post_id, len(t) as n, unnest(list_filter(t, lambda w: w in ({", ".join(f"'{w}'" for w in _QUERY_WORDS)}))) as w from tok),
    tf as (select post_id, n, w, count(*) as tf from post group by all), df as (select w, count(*) as df from tf group by w),
    bm25 as (select post_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) as score from tf join df using (w), whole group by post_id)"""

QUERIES = {
    f.__name__: f
    for f in (knn_topk, knn_filtered, bm25_topk, rank_boost, rrf_hybrid, trend_search, first_per_cluster, entity_evidence_top3, balanced_lanes, blind_spots)
}
ORACLES = {
    "knn_topk": f"with {_DENSE} select post_id, round(similarity, 6) as similarity from dense order by dense.similarity desc, post_id limit 20",
    "knn_filtered": f"""with {_DENSE} select post_id, workspace, round(similarity, 6) as similarity from dense where workspace in (1, 2, 3) and published_at >= timestamp '2024-01-03'
        order by dense.similarity desc, post_id limit 20""",
    "bm25_topk": f"with {_BM25} select * from bm25 order by score desc, post_id limit 20",
    "rank_boost": f"""with {_DENSE}, {V.POSTS}, {V.SOURCES}, h as (select d.post_id, round(similarity, 6) as similarity, authority, (epoch_us(timestamp '2024-01-10') - epoch_us(d.published_at)) / 3600000000.0 as h
        from dense d join posts p on d.post_id = p.post_id left join sources s on p.source_id = s.source_id)
        select post_id, similarity, round(similarity * (1 + 0.20::double * coalesce(authority, 0) + 0.08::double * case when h <= 24 then 1 when h <= 72 then 0.75::double when h <= 168 then 0.45::double else 0.15::double end), 6) as score
        from h order by score desc, post_id limit 20""",
    "rrf_hybrid": f"""with {_DENSE}, {_BM25}, a as (select post_id, row_number() over (order by round(similarity, 9) desc, post_id) as r from dense qualify r <= 100),
        b as (select post_id, row_number() over (order by score desc, post_id) as r from bm25 qualify r <= 100), u as (select * from a union all select * from b)
        select post_id, round(sum(1 / (r + 60)), 9) as score, count(*) as lanes from u group by post_id order by score desc, post_id limit 20""",
    "trend_search": f"""with {V.TRENDS} select cluster_key, stage, round(signal_score * (1 + 0.15::double * signal_score + 0.10::double * strength + 0.05::double * least(source_count / 6, 1)), 6) as score
        from trends where stage in ('stable', 'emerging') order by score desc, cluster_key limit 25""",
    "first_per_cluster": f"""with {_DENSE}, c as (select post_id, case when post_id % 5 <> 0 then workspace end as cluster, round(similarity, 6) as similarity from dense),
        r as (select *, row_number() over (partition by cluster order by similarity desc, post_id) as r from c)
        select post_id, cluster, similarity from r where r = 1 or cluster is null order by similarity desc, post_id limit 6""",
    "entity_evidence_top3": f"""with {V.POSTS}, r as (select post_id, relevance, entity, cast(row_number() over (partition by entity order by relevance desc, post_id) as int) as rank
        from posts, (select unnest(['the', 'und', 'que', 'les', 'tion']) as entity) where contains(lower(content), entity)) select * from r where rank <= 3""",
    "balanced_lanes": f"""with {_DENSE}, s as (select post_id, workspace, round(similarity, 6) as similarity from dense),
        l as (select 'main' as lane, * from s where workspace % 3 <> 0 union all select 'counter', * from s where workspace % 3 = 0 union all select 'region', * from s where workspace = 4),
        r as (select *, row_number() over (partition by lane order by similarity desc, post_id) as r from l) select lane, post_id, similarity from r where r <= 5""",
    "blind_spots": f"""with {V.POSTS}, g as (select workspace, count(*) as n, count(distinct source_id) as sources, count(*) filter (where relevance < 0.5) as negative from posts where workspace is not null group by 1)
        select workspace, concat_ws('; ', case when n < 200 then 'few posts' end, case when sources < 21 then 'few sources' end, case when negative = 0 then 'no contrary voice' end) as blind_spots from g""",
}
