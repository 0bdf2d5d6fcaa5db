"""Concept co-occurrence graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.ranking import top_k
from tidemark.storage import materialize


def mentions(concepts: DataFrame) -> DataFrame:
    """Each concept once for each document, by its greatest weight (ties: first category)."""
    key = F.lower("name")
    return (
        concepts.withColumn("concept", key)
        .groupBy("doc_id", "concept")
        .agg(F.max("weight").alias("weight"), F.min_by("category", F.struct(-F.col("weight"), "category")).alias("category"))
    )


def nodes(found: DataFrame, most: int, least_mentions: int = 1) -> DataFrame:
    """The most mentioned concepts with their weights and dominant category."""
    stats = found.groupBy("concept").agg(
        F.count("*").alias("mentions"), F.sum("weight").alias("total_weight"), F.max("weight").alias("max_weight"), F.round(F.avg("weight"), 4).alias("avg_weight")
    )
    by_category = found.groupBy("concept", "category").agg(F.count("*").alias("n"))
    mode = by_category.groupBy("concept").agg(F.min_by("category", F.struct(-F.col("n"), "category")).alias("category"))
    kept = stats.filter(F.col("mentions") >= least_mentions).join(mode, "concept")
    return kept.orderBy(F.desc("mentions"), F.desc("total_weight"), "concept").limit(most)


def edges(found: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """``(a, b, mentions, weight)``: documents that mention both, and the sum of the lesser weights.

    Pairs are made inside a document, which mentions a bounded number of concepts, and summed in each task."""
    rows = found if kept is None else found.join(kept.select("concept"), "concept", "left_semi")
    a = rows.select("doc_id", F.col("concept").alias("a"), F.col("weight").alias("wa"))
    b = rows.select("doc_id", F.col("concept").alias("b"), F.col("weight").alias("wb"))
    return a.join(b, "doc_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("mentions"), F.sum(F.least("wa", "wb")).alias("weight"))


def examples(found: DataFrame, kept: DataFrame, most: int = 5) -> DataFrame:
    """``(concept, posts)``: the first documents that mention each kept concept, ``most`` of them."""
    rows = top_k(found.join(kept.select("concept"), "concept", "left_semi").select("concept", "doc_id"), ["concept"], [F.asc("doc_id")], most)
    return rows.groupBy("concept").agg(F.array_sort(F.collect_list("doc_id")).alias("posts"))


def edge_categories(found: DataFrame, kept: DataFrame, documents: DataFrame) -> DataFrame:
    """``(a, b, mentions, weight, category)`` of links between kept concepts; the category is that of most of the documents
    ``(doc_id, category)`` that mention both (ties: the first; none: uncategorized)."""
    rows = found.join(kept.select("concept"), "concept", "left_semi").select("doc_id", "concept", "weight").join(documents.select("doc_id", "category"), "doc_id", "left")
    a = rows.select("doc_id", F.coalesce("category", F.lit("uncategorized")).alias("category"), F.col("concept").alias("a"), F.col("weight").alias("wa"))
    b = rows.select("doc_id", F.col("concept").alias("b"), F.col("weight").alias("wb"))
    parts = a.join(b, "doc_id").filter("a < b").groupBy("a", "b", "category").agg(F.count("*").alias("n"), F.sum(F.least("wa", "wb")).alias("w"))
    return parts.groupBy("a", "b").agg(F.sum("n").alias("mentions"), F.sum("w").alias("weight"), F.min_by("category", F.struct(-F.col("n"), "category")).alias("category"))


def neighbourhood(links: DataFrame, start: str, depth: int) -> DataFrame:
    """``(concept, hops)`` of what can be reached from ``start`` over ``links(a, b)`` in at most ``depth`` steps."""
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    seen = links.sparkSession.sql("select cast(null as string) concept, 0 hops where false").unionByName(
        both.filter(F.col("a") == start).select(F.col("a").alias("concept"), F.lit(0).alias("hops")).distinct()
    )
    seen = materialize(seen, "hop0")
    for hop in range(1, depth + 1):
        edge = seen.filter(F.col("hops") == hop - 1).select(F.col("concept").alias("a"))
        new = both.join(edge, "a", "left_semi").select(F.col("b").alias("concept")).distinct().join(seen, "concept", "left_anti")
        seen = materialize(seen.unionByName(new.withColumn("hops", F.lit(hop))), f"hop{hop}")
    return seen


def strongest(links: DataFrame, k: int) -> DataFrame:
    """Of each concept the ``k`` links of greatest weight."""
    both = links.select(F.col("a").alias("concept"), F.col("b").alias("other"), "weight").unionByName(
        links.select(F.col("b").alias("concept"), F.col("a").alias("other"), "weight")
    )
    return top_k(both, ["concept"], [F.desc("weight"), F.asc("other")], k, "rank")
