"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a row group, which a task that writes holds in memory and one task reads whole.
GROUP = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one of a local session (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}"


class Scratch:
    """The tables that were made while it was open."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.kept: set[str] = set()

    def keep(self, df: DataFrame) -> DataFrame:
        """Leave a table of ``materialize`` to whoever reads the result."""
        self.kept.add(df._tidemark_path)
        return df


_open: list[Scratch] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Delete the tables that are made inside at its end, but for those that it is told to keep."""
    mine = Scratch()
    _open.append(mine)
    try:
        yield mine
    finally:
        _open.remove(mine)
        for path in mine.paths:
            if path not in mine.kept:
                _delete(spark, path)
            elif _open:
                _open[-1].paths.append(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    A lost executor then costs a re-read and not a re-run, and Spark knows the table's true size
    when it chooses between a broadcast and a shuffle.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", GROUP).parquet(path)
    spark._jvm.System.gc()  # Spark deletes the shuffle files of a finished write once its plan is collected
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    if _open:
        _open[-1].paths.append(path)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_named: dict[str, set[str]] = defaultdict(set)


def named_table(spark: SparkSession, label: str) -> tuple[str, str]:
    """A new name for a table of the catalog, and its place in the shared folder; ``clear`` drops it."""
    name = f"tidemark_{label}_{uuid.uuid4().hex}"
    _named[spark.sparkContext.applicationId].add(name)
    return name, f"{_own_dir(spark)}/{name}"


def drop(spark: SparkSession, name: str) -> None:
    """Drop a table of ``named_table`` with its files."""
    _named[spark.sparkContext.applicationId].discard(name)
    spark.sql(f"drop table if exists {name}")
    _delete(spark, f"{_own_dir(spark)}/{name}")


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application made, once their results have been read or written elsewhere."""
    for name in list(_named[spark.sparkContext.applicationId]):
        drop(spark, name)
    _delete(spark, _own_dir(spark))
