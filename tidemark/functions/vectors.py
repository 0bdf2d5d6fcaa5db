"""Vectors and sets in arrays, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """Of arrays of doubles, the longer cut to the shorter; 0 if one is empty or zero."""
    n = F.least(F.size(a), F.size(b))
    left, right = F.slice(a, 1, n), F.slice(b, 1, n)
    length = norm(left) * norm(right)
    return F.when((n <= 0) | (length == 0), F.lit(0.0)).otherwise(_dot(left, right) / length)


def unit(a: Column) -> Column:
    """Scaled to length 1; zeros stay, and have cosine 0 with anything."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))[0]


def dot(a: Column, b: Column) -> Column:
    return _dot(a, b)


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Of two sets in arrays; ``empty`` if both are."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / both)


#: Places of a vector that are summed in one row.
PLACES = 16


def centroids(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean of each place of the vectors of a group. Sums are partial, so a large group is not gathered; a row carries ``PLACES`` places."""
    starts = F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / PLACES).cast("int"))
    parts = F.transform(starts, lambda k: F.slice(vector, k * PLACES + 1, PLACES))
    rows = df.filter(F.size(vector) > 0).select(*keys, F.posexplode(parts).alias("i", "x"))
    means = [F.avg(F.get("x", F.lit(j)).cast("double")).alias(f"x{j}") for j in range(PLACES)]
    places = rows.groupBy(*keys, "i").agg(F.max(F.size("x")).alias("n"), *means)
    part = F.slice(F.array(*[F.col(f"x{j}") for j in range(PLACES)]), F.lit(1), F.col("n"))
    listed = places.select(*keys, "i", part.alias("x")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"))
    return listed.select(*keys, F.flatten("c.x").alias("centroid"))
