"""Connected components of an edge table, without moving edges or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.storage import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """Label every node of ``edges(src, dst)`` with the smallest node it can reach.

    Alternating large-star and small-star contraction: each round is two aggregations by node whose
    partial sums keep a hub from meeting in one task, followed by a join that adaptive execution can
    split. Rounds are logarithmic in the longest chain and go on until none changes anything. Self loops and null ends are ignored, so a
    node without another neighbour is absent from the result. Returns ``(node, component)``.
    """
    und = edges.filter("src is not null and dst is not null and src <> dst")
    current = materialize(
        und.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), "edges"
    )
    before = None
    while True:
        larger = materialize(_star(current, large=True), "large")
        smaller = materialize(_star(larger, large=False), "small")
        state = smaller.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        discard(current)
        discard(larger)
        current = smaller
        if (state["n"], state["h"]) == before:
            break
        before = (state["n"], state["h"])
    roots = current.select("b").distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("component"))
    )


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction; ``edges(a, b)`` has a > b. Large: neighbours above a node move to its least
    neighbour; small: neighbours below a node, and the node itself, do."""
    down = edges.select(F.col("a").alias("node"), F.col("b").alias("nb"))
    both = down.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("nb"))) if large else down
    least = both.groupBy("node").agg(F.min("nb").alias("m"))
    m = F.least("m", "node")
    joined = both.join(least, "node")
    if large:
        out = joined.filter("nb > node").select(F.col("nb").alias("a"), m.alias("b"))
    else:
        out = joined.select(F.col("nb").alias("a"), m.alias("b")).unionByName(
            least.select(F.col("node").alias("a"), m.alias("b"))
        )
    return out.filter("a > b").distinct()
