"""Keyed state of streams in RocksDB: the first row of a key for good, and marks that expire."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB: on disk, with changes in the checkpoint."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def first_for_good(stream: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key (by ``order`` within a batch), for good: a mark for each key, and no row of an earlier batch is read again.

    A task keeps the first row of each of its keys; those whose key is marked go, and the others are marked, in the state of Spark's own
    deduplication. Marks and output are committed with the batch, so one that comes again after a failure gives the same rows."""

    def least(tables: list[pa.Table]) -> pa.Table:
        near = pa.concat_tables(tables).sort_by(order)
        rows = near.select(keys).append_column("_row", pa.array(range(near.num_rows), pa.int64())).group_by(keys).aggregate([("_row", "min")])
        return near.take(rows["_row_min"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        kept = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) > 2 * kept + 100_000:
                held = [least(held)]
                kept = held[0].num_rows
        if held:
            yield from least(held).combine_chunks().to_batches(10_000)

    return stream.repartition(*keys).mapInArrow(run, stream.schema).dropDuplicates(keys)


#: Groups of keys whose marks are kept together.
BUCKETS = 512


class _SendOnce(StatefulProcessor):
    def __init__(self, ts: str, order: str, seconds: float, emit: Callable[[tuple], bool], columns: list[str]) -> None:
        self.ts, self.order, self.span, self.emit, self.columns = ts, order, round(seconds * 1_000_000), emit, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.marks = handle.getValueState("marks", "key array<string>, until array<bigint>")

    def _read(self) -> dict[str, int]:
        found = self.marks.get()
        return dict(zip(*found, strict=True)) if found else {}

    def _write(self, marks: dict[str, int], timerValues) -> dict[str, int]:
        passed = timerValues.getCurrentWatermarkInMs()
        left = {k: u for k, u in marks.items() if u // 1000 >= passed}
        if left:
            self.marks.update((list(left), list(left.values())))
        else:
            self.marks.clear()
        return left

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values([self.ts, self.order])
        marks = self._read()
        times = frame[self.ts].astype("datetime64[us]").astype("int64").tolist()
        outcomes = []
        for k, at, row in zip(frame["mark_key"].tolist(), times, frame[self.columns].itertuples(index=False), strict=True):
            if k in marks and at < marks[k]:
                outcomes.append("held")
            elif self.emit(row):
                marks[k] = at + self.span
                outcomes.append("sent")
            else:  # no mark: the next one is tried
                outcomes.append("failed")
        if left := self._write(marks, timerValues):
            self.handle.registerTimer(max(left.values()) // 1000 + 1)
        yield frame[self.columns].assign(outcome=outcomes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._write(self._read(), timerValues)
        return iter(())

    def close(self) -> None:
        pass


def send_once(stream: DataFrame, keys: list[str], ts: str, order: str, seconds: float, emit: Callable[[tuple], bool], delay: str) -> DataFrame:
    """Add ``outcome``: ``sent``, ``failed`` or ``held`` back, because a row of the same key was sent in the ``seconds`` before.

    A mark is set only after ``emit`` has said that a row went out, so a failed one leaves the next free to try. Marks expire by event time
    and are given up once the watermark, ``delay`` behind the newest row, has passed them. ``emit`` may be called again for a row if its batch
    comes again; rows of a key in a batch are taken in the order of ``ts`` and ``order``. Keys are dealt over ``BUCKETS`` groups, and a batch reads
    and writes the marks of a group at once, as a call of Python for each key costs more than its rows."""
    kind = StructType([*stream.schema.fields, StructField("outcome", StringType())])
    text = [F.hex(k) if isinstance(stream.schema[k].dataType, BinaryType) else F.col(k).cast("string") for k in keys]
    named = stream.select("*", F.to_json(F.struct(*[c.alias(k) for c, k in zip(text, keys, strict=True)])).alias("mark_key"))
    marked = named.withColumn("mark_bucket", F.pmod(F.xxhash64("mark_key"), F.lit(BUCKETS))).withWatermark(ts, delay)
    return marked.groupBy("mark_bucket").transformWithStateInPandas(
        _SendOnce(ts, order, seconds, emit, stream.columns), outputStructType=kind, outputMode="Append", timeMode="EventTime"
    )
