"""A Python data source over landed pages of responses: batch and stream readers with cursors, and a sink that keeps the newest rows.

A folder holds one file of JSON for each response: ``{"cursor": ..., "next": ..., "etag": ..., "items": [...]}``. Files are named by
their number. Registered as ``landed``: ``spark.read.format("landed").option("path", folder).load()``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

_SCHEMA = "page bigint, place int, etag string, item string"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _pages(path: str) -> list[int]:
    system, base = _system(path)
    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(int(PurePosixPath(f.path).stem) for f in found if f.is_file and PurePosixPath(f.path).stem.isdigit())


def _load(path: str, page: int) -> dict:
    system, base = _system(path)
    with system.open_input_stream(f"{base}/{page}.json") as f:
        return json.loads(f.read())


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


def _rows(path: str, page: int, unless: str | None) -> Iterator[tuple]:
    """Items of a page; none if its mark is the one that was seen before it."""
    response = _load(path, page)
    etag = response.get("etag")
    if etag is None or etag != unless:
        for place, item in enumerate(response.get("items", [])):
            yield page, place, etag, json.dumps(item, ensure_ascii=False, sort_keys=True)


class LandedReader(DataSourceReader):
    """Every page is a partition; of pages that follow each other with the same mark only the first has rows."""

    def __init__(self, path: str, first: int) -> None:
        self.path, self.first = path, first

    def partitions(self) -> list[Page]:
        return [Page(n) for n in _pages(self.path) if n >= self.first]

    def read(self, partition: Page) -> Iterator[tuple]:
        before = partition.number - 1
        try:
            mark = _load(self.path, before).get("etag") if before >= self.first else None
        except FileNotFoundError:
            mark = None
        return _rows(self.path, partition.number, mark)


class LandedStream(DataSourceStreamReader):
    """Offsets are numbers of pages: a batch takes the pages that have landed since the last one, so none is read twice and a repeated batch reads the same."""

    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": max(_pages(self.path), default=-1) + 1}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(n) for n in _pages(self.path) if start["page"] <= n < end["page"]]

    def read(self, partition: Page) -> Iterator[tuple]:
        return LandedReader(self.path, 0).read(partition)

    def commit(self, end: dict) -> None:
        pass


class Landed(DataSource):
    """Options: ``path``, the folder; ``from``, the first page of a batch read (a cursor that an earlier read ended with)."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options["path"], int(self.options.get("from", 0)))

    def streamReader(self, schema) -> LandedStream:
        return LandedStream(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Landed)


def land(rows: DataFrame, path: str, page: str, item: str, etag: str) -> None:
    """Write ``rows`` as pages of responses, one file each, by the executors: items in order of their text."""
    listed = rows.groupBy(page).agg(F.sort_array(F.collect_list(item)).alias("items"), F.max(etag).alias("etag"))

    def write(frame) -> None:
        system, base = _system(path)
        system.create_dir(base, recursive=True)
        for r in frame:
            with system.open_output_stream(f"{base}/{r[page]}.json") as f:
                f.write(json.dumps({"etag": r["etag"], "items": [json.loads(x) for x in r["items"]]}, ensure_ascii=False).encode())

    listed.foreachPartition(write)


def keep_newest(table: DataFrame, new: DataFrame, order: list[str], most: int) -> DataFrame:
    """A log with a length cap: the ``most`` newest rows of both, by ``order``; each task sends no more than so many."""
    return table.unionByName(new).orderBy(*[F.desc(c) for c in order]).limit(most)
