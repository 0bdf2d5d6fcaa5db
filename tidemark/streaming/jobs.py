"""Streaming enrichment: at-least-once input, idempotent output, retries, dead letters and rate limits."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.storage import shared_dir


def read_table(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """A table's files as a stream, whether ``path`` is a file or a folder; schema from the table itself."""
    schema = spark.read.parquet(path).schema
    head, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{head}/{name[:-1]}[{name[-1]}]")


def _place(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidemark/stream-{label}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is, into a Parquet table with a checkpoint in the shared folder."""
    spark = stream.sparkSession
    place = _place(spark, label)
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start(f"{place}/out")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def keep(rows: DataFrame, label: str) -> DataFrame:
    """Rows as a table of their own, so that what they were read from may change."""
    place = _place(rows.sparkSession, label)
    rows.write.parquet(place)
    return rows.sparkSession.read.schema(rows.schema).parquet(place)


def each_batch(stream: DataFrame, label: str, write: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over what there is, one call a batch; a batch may come again after a failure."""
    place = _place(stream.sparkSession, label)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def first_of_each(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Drop repeats of a key that come within ``delay`` of event time; state beyond it is given up."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def with_retries(stream: DataFrame, attempt: Callable[[DataFrame], DataFrame], most: int, label: str) -> DataFrame:
    """Process rows, retry those that fail, and end with status ``done`` or ``dead`` and the attempts taken.

    ``attempt`` adds a boolean ``ok`` to rows with their ``attempts`` so far. Inside a batch each round takes only the
    rows that failed before; a batch's number names its output, so a repeated batch writes the same place."""
    spark = stream.sparkSession
    place = _place(spark, label)

    def write(batch: DataFrame, number: int) -> None:
        left = batch.withColumn("attempts", F.lit(0))
        for turn in range(1, most + 1):
            tried = attempt(left.withColumn("attempts", F.lit(turn)))
            path = f"{place}/tried/n={number}/turn={turn}"
            tried.write.mode("overwrite").parquet(path)
            tried = spark.read.schema(tried.schema).parquet(path)
            last = turn == most
            done = tried.withColumn("status", F.when(F.col("ok"), "done").otherwise("dead")) if last else tried.filter("ok").withColumn("status", F.lit("done"))
            done.drop("ok").write.mode("overwrite").parquet(f"{place}/out/n={number}/turn={turn}")
            left = tried.filter("not ok").drop("ok")

    each_batch(stream, label, write)
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{place}/out")


def routed(stream: DataFrame, routes: dict[str, object], label: str) -> DataFrame:
    """Copy each row to all routes whose condition holds, with the route's name; one scan of a batch."""
    names = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in routes.items()]))
    return drain(stream.withColumn("route", F.explode(names)), label)


def rate_limited(stream: DataFrame, key: str, ts: str, most: int, seconds: float) -> DataFrame:
    """``(key, ts, accepted)``: a row is accepted if fewer than ``most`` of its key were accepted in the ``seconds``
    before it. Sequential by nature: state is the times of accepted rows of a key, ``most`` at most."""
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(ts)
        flags = []
        for t in rows[ts].astype("int64") // 1000 if rows[ts].dtype == "datetime64[ns]" else rows[ts].astype("datetime64[us]").astype("int64"):
            times = [x for x in times if x > t - seconds * 1_000_000]
            flags.append(len(times) < most)
            if flags[-1]:
                times.append(int(t))
        state.update((times,))
        yield pd.DataFrame({key: rows[key], ts: rows[ts], "accepted": flags})

    return stream.select(key, ts).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, {ts} timestamp, accepted boolean", "times array<bigint>", "append", GroupStateTimeout.NoTimeout
    )


def windowed_counts(stream: DataFrame, keys: list[str], ts: str, width: str, delay: str) -> DataFrame:
    """Tumbling counts in append mode: a window comes out once the watermark has passed it."""
    return stream.withWatermark(ts, delay).groupBy(*keys, F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("window_start"), "n")
