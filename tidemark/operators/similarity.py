"""Pairs of posts that are alike and close in time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructType

from tidemark.functions import vectors as v
from tidemark.storage import materialize

#: Rows of a block of vectors at most.
BLOCK = 1024
#: By how much a product of matrices, which sums in an order of its own, may differ from the sum in order.
SLACK = 1e-9


def in_order(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the rows ``i`` of ``a`` with ``j`` of ``b``, summed from the first place on as the expression for one pair does."""
    total = np.zeros(len(i))
    for c in range(a.shape[1]):
        total += a[i, c] * b[j, c]
    return total


def blocks(rows: DataFrame, keys: list[str], values: list[str], vector: str, order: list[str], size: int = BLOCK) -> DataFrame:
    """``rows`` with at most ``size`` in one: ``(keys, n, values as arrays, vectors one after the other as bytes, block)``; rows of a block have the same
    keys and vectors of the same length. A group of rows passes a task as a stream and is never held as a whole."""
    sized = rows.select(*keys, F.size(vector).alias("_size"), *values, vector)
    near = sized.repartition(*keys, "_size").sortWithinPartitions(*keys, "_size", *order)
    head = [sized.schema[k] for k in (*keys, "_size")]
    kind = StructType(list(head)).add("n", IntegerType())
    for x in values:
        kind = kind.add(x, ArrayType(sized.schema[x].dataType))
    schema = to_arrow_schema(kind.add(vector, BinaryType()))
    width = len(head)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        mark = None

        def out() -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(held).combine_chunks()
            held.clear()
            data = np.asarray(table.column(vector).combine_chunks().flatten(), dtype=np.float64).tobytes()
            cells = [pa.array([table.column(k)[0].as_py()], schema.field(k).type) for k in schema.names[:width]]
            lists = [pa.ListArray.from_arrays([0, table.num_rows], table.column(x).combine_chunks()).cast(schema.field(x).type) for x in values]
            yield pa.RecordBatch.from_arrays([*cells, pa.array([table.num_rows], pa.int32()), *lists, pa.array([data], pa.binary())], schema=schema)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            heads = list(zip(*(table.column(k).to_pylist() for k in schema.names[:width]), strict=True))
            start = 0
            for i in range(len(heads) + 1):
                full = sum(t.num_rows for t in held) + i - start >= size if i < len(heads) else False
                if i == len(heads) or heads[i] != mark or full:
                    if i > start:
                        held.append(table.slice(start, i - start))
                        start = i
                    if i < len(heads):
                        if held:
                            yield from out()
                        mark = heads[i]
        if held:
            yield from out()

    return materialize(near.mapInArrow(cut, kind).withColumn("block", F.monotonically_increasing_id()), "blocks")


def similarity_edges(points: DataFrame, theta: float, gap_hours: float, key: str = "post_id", group: str = "workspace", ts: str = "published_at", vector: str = "vector") -> DataFrame:
    """``(src, dst, group, similarity)`` with src < dst, cosine of at least ``theta`` and times at most ``gap_hours`` apart.

    A range join as an equi-join: time is cut into buckets as wide as the gap, the later side of a pair
    looks into its own bucket and the one before, and only rows of a group and bucket meet. They meet in
    blocks: a product of two matrices finds the pairs that may reach ``theta``, which then are
    summed in order, so that a pair's cosine depends on its two vectors alone."""
    width = int(gap_hours * 3_600_000_000)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = points.select(F.col(key).alias("k"), F.col(group).alias("g"), micros.alias("t"), v.unit(F.col(vector)).alias("u"))
    rows = rows.withColumn("b", F.floor(F.col("t") / max(width, 1)))
    whole = rows.filter("k is not null and g is not null and t is not null and u is not null")
    made = blocks(whole, ["g", "b"], ["k", "t"], "u", ["t", "k"])
    span = (F.array_min("t").alias("least"), F.array_max("t").alias("most"))
    x = made.select("g", "b", "_size", F.struct("block", "k", "t", "u", *span).alias("x"))
    y = made.select("g", F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("b"), "_size", F.col("b").alias("own"), F.struct("block", "k", "t", "u", *span).alias("y"))
    # in one bucket two blocks meet once; in neighbouring buckets the earlier side looks forward once
    once = (F.col("own") < F.col("b")) | (F.col("x.block") <= F.col("y.block"))
    reach = (F.col("x.least") - F.col("y.most") <= width) & (F.col("y.least") - F.col("x.most") <= width)
    pairs = x.join(y, ["g", "b", "_size"]).filter(once & reach)
    kind = StructType().add("src", rows.schema["k"].dataType).add("dst", rows.schema["k"].dataType).add(group, rows.schema["g"].dataType).add("similarity", DoubleType())
    schema = to_arrow_schema(kind)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = {name: batch.column(name)[r] for name in batch.schema.names}
                side = [(one[f"{s}k"].values, np.asarray(one[f"{s}t"].values), np.frombuffer(one[f"{s}u"].as_buffer())) for s in "xy"]
                (ka, ta, ua), (kb, tb, ub) = side
                a, b = ua.reshape(len(ta), -1), ub.reshape(len(tb), -1)
                may = ~(a @ b.T < theta - SLACK) & (np.abs(ta[:, None] - tb[None, :]) <= width)
                if one["xblock"].as_py() == one["yblock"].as_py():
                    may = np.triu(may, 1)
                i, j = np.nonzero(may)
                s = in_order(a, b, i, j)
                kept = ~(s < theta)
                i, j, s = i[kept], j[kept], s[kept]
                if len(i):
                    yield pa.RecordBatch.from_arrays([ka.take(pa.array(i)), kb.take(pa.array(j)), pa.repeat(one["g"], len(i)), pa.array(s)], schema=schema)

    sent = pairs.select("g", *[F.col(f"{s}.{f}").alias(f"{s}{f}") for s in "xy" for f in ("block", "k", "t", "u")])
    found = sent.mapInArrow(meet, kind).filter(F.col("src") != F.col("dst"))
    return found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), group, "similarity")
