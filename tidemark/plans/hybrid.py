"""Hybrid search behind a request: filters first, a dense and a sparse lane, fusion, boosts, a breakdown and entity evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark import views as V
from tidemark.functions import requests as R, scores as S, text as tx, vectors
from tidemark.operators import ranking
from tidemark.plans.requests import _PAYLOAD, _payload
from tidemark.views import as_of, hours_before

LANE = 100


def _ranked(rows: DataFrame, score: str, name: str) -> DataFrame:
    """The best rows of a lane and their ranks; no more than ``LANE`` rows meet in one task."""
    best = rows.orderBy(F.desc(score), "post_id").limit(LANE)
    return best.select("post_id", F.col(score).alias(name), F.row_number().over(Window.orderBy(F.desc(score), "post_id")).alias(f"{name}_rank"))


def hybrid(spark: SparkSession, d: str, asked: R.Search, query: DataFrame, now: Column | None = None, valence: tuple[str, ...] = ()) -> DataFrame:
    """Hits of a request with the vector of ``query(q)``, one row: their lanes' scores and ranks, the fused score, source score and freshness,
    the final score, and which of the request's entities a hit names.

    Lane, source and freshness are read for the hits of the lanes only; the weights of words are those of the posts that pass the filters."""
    now = as_of() if now is None else now
    rows = R.matching(_payload(spark, d), source_region=asked.source_region, signal_type=asked.signal_type)
    if valence:
        rows = rows.filter(F.col("valence").isin(*valence))
    if asked.days_back:
        rows = rows.filter(F.col("published_at") >= now - F.make_dt_interval(F.lit(asked.days_back)))
    posts = R.matching(V.posts(spark, d), workspace=asked.lang).select("post_id", "source_id", "content")
    rows = rows.select("post_id", "vector", "published_at").join(posts, "post_id")
    near = rows.crossJoin(F.broadcast(query)).withColumn("similarity", F.round(vectors.cosine(F.col("vector"), F.col("q")), 6))  # one row
    dense = _ranked(near, "similarity", "dense")
    words = sorted(set(spark.range(1).select(tx.terms(F.lit(asked.query)).alias("w")).first().w))  # the request's own
    weighed = ranking.bm25(rows.select("post_id", tx.terms(F.col("content")).alias("tokens")), "post_id", "tokens", words)
    sparse = _ranked(weighed.withColumn("weight", F.round("score", 6)), "weight", "sparse")
    lanes = [lane.select("post_id", F.col(f"{name}_rank").alias("rank")) for lane, name in ((dense, "dense"), (sparse, "sparse"))]
    hits = ranking.fuse_ranks(lanes, "post_id").withColumn("fused", F.round("score", 9)).select("post_id", "fused").join(dense, "post_id", "left").join(sparse, "post_id", "left")
    hits = hits.join(rows.select("post_id", "source_id", "published_at", F.lower("content").alias("low")), "post_id")
    hits = hits.join(F.broadcast(V.sources(spark, d).select("source_id", "authority")), "source_id", "left")
    hits = hits.withColumn("freshness", S.freshness_boost(hours_before(F.col("published_at"), now)))
    hits = hits.withColumn("score", F.round(S.search_rank(F.col("fused"), F.col("authority"), F.col("freshness")), 9))
    named = [F.when(F.contains("low", F.lit(e.lower())), F.lit(e)) for e in asked.entities or []]
    hits = hits.withColumn("entities", F.array_join(F.array_compact(F.array(*named)), ",") if named else F.lit(""))
    best = hits.orderBy(F.desc("score"), "post_id").limit(asked.limit)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "post_id"))  # a request's limit of rows
    return best.select(rank.alias("rank"), "post_id", "dense", "dense_rank", "sparse", "sparse_rank", "fused", "authority", "freshness", "score", "entities")


def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """A request for three words in English posts of the last weeks, with two entities."""
    query = V.points(spark, d).filter("post_id = 7").select(F.col("vector").alias("q"))
    return hybrid(spark, d, R.Search("the tion and", limit=25, lang="en", days_back=28, entities=["that", "zebra"]), query, valence=("positive", "neutral"))


def search_hybrid_region(spark, d):
    """A request of one region, whatever the language."""
    query = V.points(spark, d).filter("post_id = 11").select(F.col("vector").alias("q"))
    return hybrid(spark, d, R.Search("que der", limit=10, source_region="eu"), query)


QUERIES = {f.__name__: f for f in (search_hybrid, search_hybrid_region)}


def _sql(point: int, where: str, words: tuple[str, ...], entities: str, limit: int) -> str:
    return f"""with {_PAYLOAD.replace("post_id = 7", f"post_id = {point}")}, {V.POSTS}, {V.SOURCES},
        f as (select pay.post_id, round(pay.similarity, 6) as similarity, pay.published_at, source_id, content from pay join posts on pay.post_id = posts.post_id where {where}),
        dense as (select post_id, similarity as dense, row_number() over (order by similarity desc, post_id) as dense_rank from f qualify dense_rank <= {LANE}),
        tok as (select post_id, regexp_extract_all(lower(content), '{tx.TERM}') as t from f), whole as (select count(*) as docs, avg(len(t)) as mean from tok),
        post as (select post_id, len(t) as n, unnest(list_filter(t, lambda w: w in ({", ".join(f"'{w}'" for w in words)}))) as w from tok),
        tf as (select post_id, n, w, count(*) as tf from post group by all), df as (select w, count(*) as df from tf group by w),
        bm as (select post_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) as sparse from tf join df using (w), whole group by post_id),
        sparse as (select post_id, sparse, row_number() over (order by sparse desc, post_id) as sparse_rank from bm qualify sparse_rank <= {LANE}),
        u as (select coalesce(d.post_id, s.post_id) as post_id, dense, dense_rank, sparse, sparse_rank,
                round(coalesce(1 / (60 + dense_rank), 0) + coalesce(1 / (60 + sparse_rank), 0), 9) as fused from dense d full join sparse s on d.post_id = s.post_id),
        h as (select u.*, authority, lower(content) as low, (epoch_us(timestamp '{V.AS_OF}') - epoch_us(published_at)) / 3600000000.0 as age from u join f on u.post_id = f.post_id left join sources s on f.source_id = s.source_id),
        b as (select *, case when age <= 24 then 1 when age <= 72 then 0.75::double when age <= 168 then 0.45::double else 0.15::double end as freshness from h),
        x as (select *, round(fused * (1 + 0.20::double * coalesce(authority, 0) + 0.08::double * freshness), 9) as score, {entities} as entities from b)
        select cast(row_number() over (order by score desc, post_id) as int) as rank, post_id, dense, cast(dense_rank as int) as dense_rank, sparse, cast(sparse_rank as int) as sparse_rank, fused, authority, freshness, score, entities
        from x order by score desc, post_id limit {limit}"""


ORACLES = {
    "search_hybrid": _sql(7, "workspace = 'en' and valence in ('positive', 'neutral') and pay.published_at >= timestamp '2024-01-31 12:30:00' - interval 28 day", ("the", "tion", "and"), "case when contains(low, 'that') then 'that' else '' end", 25),
    "search_hybrid_region": _sql(11, "source_region = 'eu'", ("que", "der"), "''", 10),
}
