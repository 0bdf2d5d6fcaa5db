"""The clustering job as a chain: cluster posts, merge, continue stored clusters, age the others, write the table's next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import scores as S
from tidemark.operators import clusters as C, ranking, upsert as U
from tidemark.storage import discard, materialize

#: Columns of a stored cluster besides its workspace and name.
RULES = {
    "state": "new", "doc_ids": "new", "title_terms": "new", "concepts": "new", "centroid": "new", "coherence": "new", "first_seen": "least", "last_seen": "greatest", "runs": "sum",
}


def describe(members: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """What is stored of each cluster of ``members(keys, post_id, vector, published_at, title_terms, concepts)``; its ``most`` most common terms and
    concepts, by partial counts."""
    rows = members.groupBy(*keys).agg(F.array_sort(F.collect_set("post_id")).alias("doc_ids"), F.min("published_at").alias("first_seen"), F.max("published_at").alias("last_seen"))
    rows = rows.join(C.coherence(members, keys, "vector").select(*keys, "coherence"), keys).join(C.v.centroids(members, keys, "vector"), keys)
    for column in ("title_terms", "concepts"):
        common = ranking.most_common(members.select(*keys, F.explode(column).alias("x")), keys, "x", most)
        listed = common.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "x"))).alias("l")).select(*keys, F.col("l.x").alias(column))
        rows = rows.join(listed, keys, "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
    return rows


def continued(fresh: DataFrame, stored: DataFrame, least: float = 0.35) -> DataFrame:
    """``(workspace, cluster, name)``: which stored cluster each fresh one continues. A stored one is continued by the fresh one that
    is most like it, and by no other."""
    new, old = (t.select("workspace", F.concat_ws("|", F.lit(kind), "workspace", F.col("cluster").cast("string")).alias("cluster"), F.col("cluster").alias("own"), "doc_ids", "title_terms", "concepts") for kind, t in (("n", fresh), ("o", stored)))
    pairs = C.match_identity(new, old, least)
    pairs = pairs.join(new.select(F.col("cluster").alias("new"), "workspace", F.col("own").alias("mine")), "new").join(old.select(F.col("cluster").alias("old"), F.col("workspace").alias("there"), F.col("own").alias("name")), "old")
    same = pairs.filter(F.col("workspace") == F.col("there"))
    best = same.withColumn("_r", F.row_number().over(Window.partitionBy("old").orderBy(F.desc("score"), "new"))).filter("_r = 1")
    return best.select("workspace", F.col("mine").alias("cluster"), "name")


def run(points: DataFrame, texts: DataFrame, stored: DataFrame | None, now: Column, theta: float, gap_hours: float, least: float = 0.78) -> DataFrame:
    """The stored clusters after a run over ``points(post_id, workspace, vector, published_at)`` with ``texts(post_id, title_terms, concepts)``.

    A fresh cluster takes the name of the stored one that it continues, else one from its workspace and least post; what the run touched is rewritten
    and is active again if it was cooling, what it didn't touch keeps its values and cools down by its age."""
    keys = ["workspace", "cluster"]
    parts = C.cluster_posts(points, theta, gap_hours)
    members = materialize(points.join(parts.select("post_id", "cluster"), "post_id").join(texts, "post_id"), "job-members")
    first = materialize(describe(members, keys), "job-fresh")
    merges = C.merge_clusters(first, least=least)
    whole = members.join(merges, keys).drop("cluster").withColumnRenamed("merged", "cluster")
    fresh = materialize(describe(whole, keys), "job-merged")
    for x in (members, first):
        discard(x)
    name = F.concat_ws("-", F.lit("c"), "workspace", F.get("doc_ids", F.lit(0)).cast("string"))
    columns = ["workspace", "cluster", *RULES]
    touched = fresh.withColumns({"state": F.lit("active"), "runs": F.lit(1).cast("bigint")})
    if stored is None:
        return touched.withColumn("cluster", name).select(columns)
    known = continued(fresh, stored)
    taken = stored.select("workspace", F.col("cluster").alias("_new"), F.lit(True).alias("_taken"))
    # a stored cluster of that name may go on in another one
    other = F.when(F.col("_taken"), F.concat("_new", F.date_format(now.cast("timestamp"), "-yyyyMMddHHmm"))).otherwise(F.col("_new"))
    touched = touched.join(known, keys, "left").withColumn("_new", name).join(taken, ["workspace", "_new"], "left").withColumn("cluster", F.coalesce("name", other)).select(columns)
    idle = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))) / 3_600_000_000
    after = U.merge(stored, touched, keys, RULES)
    mark = touched.select(*keys).withColumn("_touched", F.lit(True))
    aged = after.join(mark, keys, "left").withColumn("state", S.lifecycle(F.col("state"), F.coalesce("_touched", F.lit(False)), idle))
    return aged.select(columns)
