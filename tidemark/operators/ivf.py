"""Approximate nearest neighbours: an inverted file of k-means cells, kept as a table that is partitioned by cell."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructType

from tidemark.functions import vectors as v
from tidemark.operators.ranking import top_k
from tidemark.operators.similarity import SLACK, blocks, in_order
from tidemark.storage import materialize, shared_dir

#: Rows of least hash that the cells are learned from; every row is indexed.
SAMPLE = 50_000
#: Vectors up to this length are multiplied as matrices.
PLAIN = 1e150


@dataclass
class InvertedFile:
    """Points by cell, and the centres of the cells (a row for each)."""

    path: str
    centres: DataFrame
    table: DataFrame

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """``(query_id, key, similarity, rank)``: the ``k`` nearest by cosine of each row of ``queries(query_id, q)`` among the points of
        the ``probes`` nearest cells, whose similarity is exact; ties go to the smaller key.

        Only partitions that some query probes are read. Queries and points meet in blocks: a product of matrices proposes, what may
        be among a block's best is computed in order as for one pair, and a query's best of each block are all that is shuffled."""
        key, vector = self.table.columns[0], self.table.columns[1]
        centres = F.broadcast(self.centres)  # a row for each cell
        near = queries.crossJoin(centres).withColumn("s", v.cosine(F.col("q"), F.col("centre")))
        asked = materialize(top_k(near, ["query_id"], [F.desc("s"), F.asc("cell")], probes).select("query_id", "q", "cell"), "asked")
        points = self.table.join(F.broadcast(asked.select("cell").distinct()), "cell", "left_semi")  # at most a row for each cell
        plain, odd = ([side.filter(F.coalesce(v.norm(F.col(c)) < PLAIN, F.lit(False)) == right) for side, c in ((points, vector), (asked, "q"))] for right in (True, False))
        left = blocks(plain[1], ["cell"], ["query_id"], "q", ["query_id"], 512).select("cell", "query_id", "q", F.col("n").alias("m"))
        right = blocks(plain[0], ["cell"], [key], vector, [key], 2048).select("cell", F.col(key).alias("k"), F.col(vector).alias("x"), "n")
        kind = StructType().add("query_id", asked.schema["query_id"].dataType).add(key, self.table.schema[key].dataType).add("similarity", DoubleType())
        schema = to_arrow_schema(kind)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    one = {name: batch.column(name)[r] for name in batch.schema.names}
                    a, b = (np.frombuffer(one[c].as_buffer()).reshape(one[n].as_py(), -1) for c, n in (("q", "m"), ("x", "n")))
                    i, j, s = _best(a, b, k)
                    yield pa.RecordBatch.from_arrays([one["query_id"].values.take(pa.array(i)), one["k"].values.take(pa.array(j)), pa.array(s)], schema=schema)

        found = left.join(right, "cell").drop("cell").mapInArrow(best, kind)
        # vectors with nulls, NaN or huge numbers have no place in a matrix
        for some in (self.table.join(odd[1], "cell"), odd[0].join(plain[1], "cell")):
            found = found.unionByName(some.select("query_id", key, v.cosine(F.col(vector), F.col("q")).alias("similarity")))
        rounded = found.withColumn("similarity", F.round("similarity", 9))
        ranked = top_k(rounded, ["query_id"], [F.desc("similarity"), F.asc(key)], k, "rank")
        return ranked.select("query_id", key, "similarity", "rank")


def _rounded(s: np.ndarray) -> np.ndarray:
    """Nine places, halves up by the shortest decimal form, as Spark rounds."""
    out = np.round(s, 9)
    near = np.nonzero(np.abs(np.abs(s * 1e9) % 1 - 0.5) < 1e-3)[0]
    out[near] = [float(Decimal(repr(float(x))).quantize(Decimal("1e-9"), ROUND_HALF_UP)) for x in s[near]]
    return out


def _best(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of ``a`` the ``k`` rows of ``b`` with the greatest rounded cosine, ties to the first, as ``(i, j, cosine)``."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    every = [np.arange(len(x)) for x in (a, b)]
    na, nb = (np.sqrt(in_order(x, x, e, e)) for x, e in zip((a, b), every, strict=True))
    length = na[:, None] * nb[None, :]
    near = np.divide(a @ b.T, length, out=np.zeros_like(length), where=length > 0)
    last = np.partition(near, len(b) - k, axis=1)[:, [len(b) - k]] if len(b) > k else -np.inf
    i, j = np.nonzero(near >= last - 4 * SLACK)
    lengths = length[i, j]
    s = np.divide(in_order(a, b, i, j), lengths, out=np.zeros(len(i)), where=lengths > 0)
    order = np.lexsort((j, -_rounded(s), i))
    i, j, s = i[order], j[order], s[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k], s[place < k]


def build(points: DataFrame, cells: int, key: str = "post_id", vector: str = "vector", rounds: int = 10, seed: int = 5) -> InvertedFile:
    """Learn ``cells`` centres and write all points by cell; points without a length are a cell of their own (-1).

    A cell that holds many points is several files, written by several tasks."""
    spark = points.sparkSession
    rows = points.select(key, vector).withColumn("_length", v.norm(F.col(vector)))
    usable = rows.filter("_length > 0").withColumn("features", array_to_vector(vector))
    sample = usable.orderBy(F.xxhash64(key), key).limit(SAMPLE)
    model: KMeansModel = KMeans(k=cells, distanceMeasure="cosine", maxIter=rounds, seed=seed, predictionCol="cell").fit(sample)
    placed = model.transform(usable).select(key, vector, "cell")
    placed = placed.unionByName(rows.filter("_length is null or _length = 0").select(key, vector, F.lit(-1).alias("cell")))
    path = f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}/cells-{uuid.uuid4().hex}"
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    width = len(centres[0][1])
    table = spark.createDataFrame([*centres, (-1, [0.0] * width)], "cell int, centre array<double>")
    return InvertedFile(path, table, spark.read.schema(placed.schema).parquet(path))
