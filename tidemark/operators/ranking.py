"""Top rows, first rows and most common values of groups, with a total order instead of input order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.storage import materialize


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group. Spark keeps only ``k`` rows of a group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each group with the greatest ``order``: an aggregate with partial results, no sort."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_m"))
    return best.select(*keys, "_m.*")


def most_common(df: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """``(keys, value, n, rank)``: values by falling count, ties by value."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return top_k(counts, keys, [F.desc("n"), F.asc(value)], n, "rank")


def first_of_each(df: DataFrame, group: Column, order: list[Column], limit: int) -> DataFrame:
    """The best row of each group, and of those the first ``limit``; rows of a null group all stay."""
    marked = df.withColumn("_g", group)
    w = Window.partitionBy("_g").orderBy(*order)
    kept = marked.withColumn("_r", F.when(F.col("_g").isNull(), 1).otherwise(F.row_number().over(w))).filter("_r = 1")
    return kept.drop("_g", "_r").orderBy(*order).limit(limit)


def fuse_ranks(lanes: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of lanes ``(key, rank)``: ``(key, score, lanes)``."""
    rows = [lane.select(key, (1 / (F.col("rank") + k)).alias("s")) for lane in lanes]
    return reduce(DataFrame.unionByName, rows).groupBy(key).agg(F.sum("s").alias("score"), F.count("*").alias("lanes"))


def nearest(points: DataFrame, query: list[float], k: int, key: str = "post_id", vector: str = "vector") -> DataFrame:
    """Exact search by cosine: a scan and the ``k`` best of each task."""
    from tidemark.functions import vectors as v

    q = F.array(*[F.lit(float(x)) for x in query])
    return points.withColumn("similarity", v.cosine(F.col(vector), q)).orderBy(F.desc("similarity"), F.asc(key)).limit(k)


def bm25(docs: DataFrame, key: str, tokens: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``(key, score)`` of documents that hold some word of ``query`` (Robertson's weights).

    Documents are tokenised once, into a table of their lengths and the query's words in them, which document
    frequencies, the mean length and the weights are read from; only postings of query words are shuffled."""
    words = sorted(set(query))
    lengths = materialize(docs.select(key, F.size(tokens).alias("n"), F.filter(tokens, lambda w: w.isin(*words)).alias("hits")), "lengths")
    whole = lengths.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
    postings = lengths.filter(F.size("hits") > 0).select(key, "n", F.explode("hits").alias("word")).groupBy(key, "n", "word").agg(F.count("*").alias("tf"))
    df = postings.groupBy("word").agg(F.count("*").alias("df"))  # a row for each query word
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return postings.join(F.broadcast(df), "word").crossJoin(F.broadcast(whole)).groupBy(key).agg(F.sum(part).alias("score"))
