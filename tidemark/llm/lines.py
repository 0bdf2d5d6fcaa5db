"""Operator 6: line dedup by site-relative frequency, in SQL expressions only.

A line is boilerplate on a host if the share of the host's pages that contain it exceeds ``RATIO`` and at least
``LEAST_PAGES`` do. Pages with the same text are one page, in the count and in the total, so a text that was
copied often does not turn into boilerplate. Lines are counted by 64-bit digests: digests of a page's different
lines are grouped by host and line, with partial sums in each task, so neither a hot host nor a hot line
meets in one task. A host has fewer than (lines a page) / ``RATIO`` such lines, and these lists, not the lines,
are joined to the documents; Spark broadcasts them if they are small and splits a hot host if not.

Defined results: blank lines (of spaces only) are never dropped nor counted; a null text has no lines and stays null; a
null host and an empty one are the same host; a page of boilerplate only ends up empty; a line at just the ratio
stays; a text of any length is read whole; repeated rows are each rewritten; an empty table has no rows; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.storage import materialize

RATIO = 0.1
LEAST_PAGES = 5


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _filled(line: Column) -> Column:
    return F.length(F.trim(line)) > 0


def boilerplate(docs: DataFrame, host: str, text: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """``(host, lines)``: digests of each host's boilerplate lines; hosts without any are left out."""
    digests = F.array_distinct(F.transform(F.filter(_lines(text), _filled), lambda x: F.xxhash64(x)))
    pages = (
        docs.filter(F.col(text).isNotNull())
        .select(F.coalesce(F.col(host), F.lit("")).alias("host"), F.xxhash64(text).alias("page"), digests.alias("lines"))
        .groupBy("host", "page")
        .agg(F.first("lines").alias("lines"))
    )
    pages = materialize(pages, "pages")
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    counts = pages.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    counts = materialize(counts.filter(F.col("n") >= least), "counts")
    return (
        counts.join(totals, "host")
        .filter(F.col("n") > ratio * F.col("total"))
        .groupBy("host")
        .agg(F.collect_set("line").alias("lines"))
    )


def drop_boilerplate(docs: DataFrame, host: str, text: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """``docs`` with ``kept`` (the text without boilerplate lines), ``n_lines`` and ``n_removed``."""
    found = materialize(boilerplate(docs, host, text, ratio, least), "boilerplate")
    found = found.select(F.col("host").alias("_host"), F.col("lines").alias("_bad"))
    joined = docs.join(found, F.coalesce(F.col(host), F.lit("")) == F.col("_host"), "left")
    lines = _lines(text)
    bad = F.col("_bad")
    kept = F.when(bad.isNull(), lines).otherwise(F.filter(lines, lambda x: ~(_filled(x) & F.array_contains(bad, F.xxhash64(x)))))
    parts = joined.withColumn("_kept", kept)
    n = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines))
    return parts.select(
        *docs.columns,
        F.when(F.col(text).isNotNull(), F.array_join("_kept", "\n")).alias("kept"),
        n.cast("bigint").alias("n_lines"),
        F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("_kept")).cast("bigint").alias("n_removed"),
    )
