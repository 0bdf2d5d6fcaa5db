"""Pending entries of a consumer group as a table of leases: delivery, acknowledgement, claims of idle ones, dead letters."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.storage import _delete, shared_dir

_LEASE = "entry bigint, owner string, delivered_at timestamp, deliveries int"


class Leases:
    """Entries that were delivered and aren't acknowledged, one row each: ``(entry, owner, delivered_at, deliveries)``.

    Each change is a merge that writes the next version of the table; a version is whole once its folder has been written, the one
    before stays until then, and a step that runs again after a failure writes the same version over. Acknowledged entries leave, so the table
    is as large as what is in flight. Entries that were delivered ``most`` times and are idle again go to the dead letters."""

    def __init__(self, spark: SparkSession, label: str, most: int = 5, idle_seconds: float = 600) -> None:
        self.spark, self.most, self.idle = spark, most, idle_seconds
        self.place = f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}/leases-{label}-{uuid.uuid4().hex}"
        self.version = 0
        self._write("pending", spark.createDataFrame([], _LEASE))
        self._write("dead", spark.createDataFrame([], _LEASE))

    def _write(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.place}/{table}/v={self.version}")

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.schema(_LEASE).parquet(f"{self.place}/{table}/v={self.version}")

    @property
    def pending(self) -> DataFrame:
        return self._read("pending")

    @property
    def dead(self) -> DataFrame:
        """Dead letters of all versions."""
        paths = [f"{self.place}/dead/v={i}" for i in range(self.version + 1)]
        return reduce(DataFrame.unionByName, [self.spark.read.schema(_LEASE).parquet(p) for p in paths])

    def _next(self, pending: DataFrame, dead: DataFrame | None = None) -> None:
        before = f"{self.place}/pending/v={self.version}"
        none = self.spark.createDataFrame([], _LEASE)
        self.version += 1
        try:
            self._write("dead", none if dead is None else dead)
            self._write("pending", pending)
        except BaseException:
            self.version -= 1  # the next try writes the same version
            raise
        _delete(self.spark, before)

    def deliver(self, entries: DataFrame, owner: str, now: Column) -> None:
        """Lease new ``entries(entry)`` to an owner; those that are pending already stay as they are."""
        fresh = entries.select(F.col("entry").cast("bigint")).distinct().join(self.pending.select("entry"), "entry", "left_anti")
        rows = fresh.select("entry", F.lit(owner).alias("owner"), now.cast("timestamp").alias("delivered_at"), F.lit(1).alias("deliveries"))
        self._next(self.pending.unionByName(rows))

    def acknowledge(self, entries: DataFrame) -> None:
        self._next(self.pending.join(entries.select("entry").distinct(), "entry", "left_anti"))

    def claim(self, owner: str, now: Column) -> DataFrame:
        """Take over what has been idle for long: those delivered ``most`` times become dead letters, the others get the new owner, a new
        time and one more delivery. Returns the claimed rows."""
        idle = F.unix_micros(now.cast("timestamp")) - F.unix_micros("delivered_at") >= round(self.idle * 1_000_000)
        spent = idle & (F.col("deliveries") >= self.most)
        old = self.pending
        kept = old.filter(~spent).select(
            "entry",
            F.when(idle, F.lit(owner)).otherwise(F.col("owner")).alias("owner"),
            F.when(idle, now.cast("timestamp")).otherwise(F.col("delivered_at")).alias("delivered_at"),
            F.when(idle, F.col("deliveries") + 1).otherwise(F.col("deliveries")).cast("int").alias("deliveries"),
        )
        self._next(kept, old.filter(spent))
        return self.pending.filter((F.col("owner") == owner) & (F.col("delivered_at") == now.cast("timestamp")))
