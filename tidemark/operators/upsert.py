"""Keyed tables of Parquet: what a database does in place is a new version of the table here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def replace_all(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Insert or replace: of each key the row with the greatest ``version``, new rows before old ones."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max(F.struct(version, "_new", *[c for c in rest if c != version])).alias("_m"))
    return best.select(*keys, *[F.col(f"_m.{c}") for c in rest])


def keep_first(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert if absent; of several new rows of a key the first."""
    rest = [c for c in new.columns if c not in keys and c not in order]
    first = new.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_m")).select(*keys, "_m.*")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti").select(old.columns))


def merge(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """Full outer join with a rule for each column: least, greatest, sum, new or old (the other if null)."""
    o = old.select(*keys, *[F.col(c).alias(f"o_{c}") for c in rules])
    n = new.select(*keys, *[F.col(c).alias(f"n_{c}") for c in rules])

    def merged(c: str, rule: str) -> Column:
        a, b = F.col(f"o_{c}"), F.col(f"n_{c}")
        kinds = {
            "least": F.least(a, b),
            "greatest": F.greatest(a, b),
            "sum": F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
            "new": F.coalesce(b, a),
            "old": F.coalesce(a, b),
        }
        return kinds[rule].alias(c)

    return o.join(n, keys, "full").select(*keys, *[merged(c, r) for c, r in rules.items()])


def claim(old: DataFrame, new: DataFrame, keys: list[str], now: Column, stale_hours: float) -> DataFrame:
    """Conditional upsert: rows that are new, failed, or pending for too long are claimed with one more attempt.

    ``old(keys, status, attempts, updated_at)``, ``new(keys)``; returns the claimed rows."""
    stale = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))) > stale_hours * 3_600_000_000
    may = F.col("status").isNull() | (F.col("status") == "error") | ((F.col("status") == "pending") & stale)
    joined = new.select(*keys).distinct().join(old, keys, "left").filter(may)
    return joined.select(*keys, F.lit("pending").alias("status"), (F.coalesce("attempts", F.lit(0)) + 1).alias("attempts"))


def replace_slice(old: DataFrame, new: DataFrame, slice_keys: list[str]) -> DataFrame:
    """Delete all rows of the slices that ``new`` has rows of, then insert ``new``."""
    return old.join(new.select(*slice_keys).distinct(), slice_keys, "left_anti").unionByName(new.select(old.columns))


def index_outcomes(old: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """Index states after a run: ``old(post_id, embedding_status, graph_status, retry_count, error_message)``,
    ``done(post_id, graph_done)``, ``failed(post_id, error)``, with a post in one of the two at most.

    A success clears retries and error, and keeps the graph's status unless that was written too; a failure counts one
    more retry and keeps the rest."""
    found = done.select("post_id", "graph_done", F.lit(None).cast("string").alias("error")).unionByName(
        failed.select("post_id", F.lit(None).cast("boolean").alias("graph_done"), F.left("error", F.lit(500)).alias("error"))
    )
    both = old.join(found.withColumn("_new", F.lit(True)), "post_id", "full")
    new, ok, known = F.col("_new").isNotNull(), F.col("error").isNull(), F.col("embedding_status").isNotNull()
    graph = F.when(new & ok, F.when(F.col("graph_done"), "done").otherwise(F.when(known, F.col("graph_status")).otherwise("skipped"))).otherwise(F.col("graph_status"))
    return both.select(
        "post_id", F.when(new, F.when(ok, "done").otherwise("error")).otherwise(F.col("embedding_status")).alias("embedding_status"), graph.alias("graph_status"),
        F.when(new, F.when(ok, 0).otherwise(F.coalesce("retry_count", F.lit(0)) + 1)).otherwise(F.col("retry_count")).alias("retry_count"),
        F.when(new, F.when(ok, "").otherwise(F.col("error"))).otherwise(F.col("error_message")).alias("error_message"),
    )


def patch(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Update the columns that ``changes`` has values for; rows of unknown keys are ignored."""
    fields = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in fields])
    return old.join(new, keys, "left").select(*[F.coalesce(f"_n_{c}", c).alias(c) if c in fields else F.col(c) for c in old.columns])


def checkpoints(old: DataFrame, new: DataFrame) -> DataFrame:
    """State of sources after a run: what the run doesn't say stays, but for the error, which is the run's own.

    Tables of ``(source_id, cursor, etag, last_modified, last_seen, last_success, last_error)``."""
    kept = ["cursor", "etag", "last_modified", "last_seen", "last_success"]
    n = new.select("source_id", *[F.col(c).alias(f"_n_{c}") for c in (*kept, "last_error")], F.lit(True).alias("_new"))
    both = old.join(n, "source_id", "full")
    error = F.when(F.col("_new"), F.col("_n_last_error")).otherwise(F.col("last_error"))
    return both.select("source_id", *[F.coalesce(f"_n_{c}", c).alias(c) for c in kept], error.alias("last_error"))


def toggled(rows: DataFrame, keys: list[str], flips: DataFrame, deletes: DataFrame, flag: str) -> DataFrame:
    """Turn a flag over for each key in ``flips``, and leave out those in ``deletes``."""
    on = rows.join(flips.select(*keys).distinct().withColumn("_flip", F.lit(True)), keys, "left").join(deletes.select(*keys), keys, "left_anti")
    return on.withColumn(flag, F.when(F.col("_flip"), ~F.col(flag)).otherwise(F.col(flag))).drop("_flip")


def compensated(written: DataFrame, failed: DataFrame, keys: list[str]) -> DataFrame:
    """What stays of a first write when the second failed for some rows."""
    return written.join(failed.select(*keys), keys, "left_anti")


def storable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows that a vector index takes: those with an id and a vector that isn't empty."""
    return vectors.filter(F.col(key).isNotNull() & (F.length(F.col(key).cast("string")) > 0) & (F.size(vector) > 0))
