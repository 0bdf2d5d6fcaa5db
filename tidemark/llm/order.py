"""The neighbour of each row in a global order, without sorting the table in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

_LOWEST = -(2**63)
#: Bytes of values in a range, about, and how many ranges are made for that.
RANGE, MOST = 64 << 20, 4096


def with_next(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Add ``out``: ``value`` of the next row by descending ``key``, ties by ascending ``value``; after
    the last row comes the first. A null key counts as the smallest.

    Rows are dealt to key ranges by quantiles of the key column alone, at least as many as there are shuffle
    partitions and enough for ``RANGE`` bytes of values each, up to ``MOST``; a window works inside each range, and only the first
    row of each range is joined to the range before it.
    """
    spark = df.sparkSession
    size = df.agg(F.sum(F.octet_length(value))).first()[0] or 0
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST, -(-size // RANGE)))
    cuts = df.approxQuantile(key, [i / n for i in range(1, n)], min(0.01, 0.25 / n)) if n > 1 else []
    cuts = sorted({int(c) for c in cuts})
    k = F.coalesce(F.col(key), F.lit(_LOWEST))
    bucket = (
        F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= k)) if cuts else F.lit(0)
    ).cast("int")
    keyed = df.withColumn("_k", k).withColumn("_b", bucket)
    dealt = keyed.repartition(n, "_b")
    w = Window.partitionBy("_b").orderBy(F.col("_k").desc(), F.col(value).asc_nulls_first())
    inner = dealt.withColumn(out, F.lead(F.struct(F.col(value).alias("v"))).over(w)).withColumn(
        "_last", F.col(out).isNull()
    )
    tops = keyed.groupBy("_b").agg(F.max("_k").alias("_k"))
    heads = (
        keyed.select("_b", "_k", F.col(value).alias("_v"))
        .join(F.broadcast(tops), ["_b", "_k"])  # one row for each range: at most n rows
        .groupBy("_b")
        .agg(F.min(F.struct(F.col("_v").isNotNull().alias("f"), F.col("_v")))["_v"].alias("_v"))
    )
    order = Window.orderBy(F.col("_b"))  # over at most n rows
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.withColumn("_to", F.lead("_b").over(order)).withColumn("_low", F.min("_b").over(whole))
    heads = heads.select(
        F.coalesce("_to", "_low").alias("_b"), F.lit(True).alias("_last"), F.struct(F.col("_v").alias("v")).alias("_h")
    )
    return (
        inner.join(heads, ["_b", "_last"], "left")
        .withColumn(out, F.coalesce(F.col(out), F.col("_h"))["v"])
        .drop("_b", "_k", "_last", "_h")
    )
