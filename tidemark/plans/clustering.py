"""Clusters over the embedded posts, and concept graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import views as V
from tidemark.functions import scores as S, text as tx, vectors as v
from tidemark.operators import clusters as C, graph as G, ranking
from tidemark.operators.components import connected_components
from tidemark.operators.similarity import similarity_edges
from tidemark.storage import materialize
from tidemark.views import hours_before

#: The tables' vectors are nearly orthogonal; production thresholds (.87 and more) would leave only lone posts.
THETA, GAP = 0.3, 96


def similarity_edges_(spark: SparkSession, d: str) -> DataFrame:
    e = similarity_edges(V.points(spark, d), THETA, GAP)
    return e.select("src", "dst", "workspace", F.round("similarity", 6).alias("similarity"))


def components(spark, d):
    return C.cluster_posts(V.points(spark, d), THETA, GAP)


def centroid_by_label(spark, d):
    c = v.centroids(V.points(spark, d), ["workspace"], "vector")
    return c.select("workspace", F.posexplode("centroid").alias("place", "x")).select("workspace", "place", F.round("x", 6).alias("x"))


def coherence_by_label(spark, d):
    return C.coherence(V.points(spark, d), ["workspace"], "vector").select("workspace", "n", F.round("coherence", 6).alias("coherence"))


def _members(spark, d) -> DataFrame:
    centre = v.centroids(V.points(spark, d), ["workspace"], "vector")
    p = V.points(spark, d).join(centre, "workspace").withColumn("similarity", F.round(v.cosine(F.col("vector"), F.col("centroid")), 6))
    posts = V.posts(spark, d).select("post_id", "source_id", "relevance", "n_tags")
    rows = p.select("post_id", "workspace", "published_at", "similarity").join(posts, "post_id").join(F.broadcast(V.sources(spark, d).select("source_id", "authority")), "source_id")
    fresh = S.freshness(hours_before(F.col("published_at"), F.lit("2024-01-12").cast("timestamp_ntz")))
    return rows.withColumn("fresh", fresh).withColumnRenamed("authority", "source_score")


def representative(spark, d):
    return C.representatives(_members(spark, d), ["workspace"])


def newest_evidence(spark, d):
    """The five newest posts of each group."""
    p = V.points(spark, d).drop("vector")
    return ranking.top_k(p, ["workspace"], [F.desc("published_at"), F.desc("post_id")], 5, "rank")


def _clusters(spark, d, step: int) -> DataFrame:
    """Clusters of posts by source and a slice of ids, with their title terms and concepts; texts have no titles, so the first
    180 characters stand for one."""
    p = V.posts(spark, d, 180).filter("source_id is not null").withColumn("cluster", F.concat_ws("-", "source_id", (F.floor(F.col("post_id") / step)).cast("string")))
    first = F.array_distinct(tx.terms(F.col("content")))
    g = p.groupBy("cluster").agg(F.array_sort(F.collect_set("post_id")).alias("doc_ids"), F.min("post_id").alias("post_id"), F.max("published_at").alias("last_seen"), F.min("published_at").alias("first_seen"), F.first("source_id").alias("source_id"))
    titles = p.select("post_id", first.alias("title_terms"))
    return g.join(titles, "post_id").withColumn("concepts", F.array(F.concat(F.lit("c"), (F.col("post_id") % 9).cast("string"))))


def identity_match(spark, d):
    """Which of the clusters of a finer cut continue those of a coarser one."""
    return C.match_identity(_clusters(spark, d, 50), _clusters(spark, d, 125))


def jaccard_pairs(spark, d):
    """Overlap of title terms between the clusters of a source: pairs that share a term."""
    c = _clusters(spark, d, 200).select("cluster", "source_id", "title_terms")
    found = C.overlaps(c, "cluster", "source_id", "title_terms")
    return found.select("a", "b", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard"))


def greedy_merge(spark, d):
    """Clusters of each source folded in order; thresholds are low as texts are invented."""
    c = _clusters(spark, d, 100)
    vectors = V.points(spark, d).select("post_id", "vector")
    rows = c.join(vectors, "post_id", "left").select(
        F.col("source_id").alias("workspace"), "cluster", "doc_ids", "title_terms", "concepts", F.coalesce("vector", F.array_repeat(F.lit(0.0), 64)).alias("centroid"),
        F.lit(1.0).alias("coherence"), "first_seen", "last_seen",
    )
    return C.merge_clusters(rows, least=0.3)


def greedy_signal_merge(spark, d):
    """Signals folded by score; their semantic clusters are those that their posts' vectors fall into."""
    c = materialize(_clusters(spark, d, 100), "signals")
    parts = components(spark, d).select("post_id", F.col("cluster").alias("part"))
    members = c.select("cluster", F.explode("doc_ids").alias("post_id")).join(parts, "post_id")
    semantic = members.groupBy("cluster").agg(F.collect_set("part").alias("semantic_cluster_ids"))
    rows = c.join(semantic, "cluster", "left").select(
        (F.col("post_id") % 7).alias("workspace"), F.col("cluster").alias("signal"), "doc_ids", F.coalesce("semantic_cluster_ids", F.array().cast("array<bigint>")).alias("semantic_cluster_ids"),
        F.col("concepts").alias("keywords"), "title_terms", (F.col("post_id") % 100 / 100).alias("score"), "first_seen", "last_seen",
    )
    return C.merge_signals(rows)


def quality_metrics(spark, d):
    c = materialize(components(spark, d), "clusters")
    rows = V.points(spark, d).join(c.select("post_id", "cluster"), "post_id").join(V.posts(spark, d).select("post_id", "source_id"), "post_id")
    g = C.coherence(rows, ["cluster"], "vector").join(rows.groupBy("cluster").agg(F.count_distinct("source_id").alias("sources")), "cluster")
    return C.quality(g.withColumn("evidence", F.least("n", F.lit(2))))


def golden_accuracy(spark, d):
    """Labelled pairs: posts of the same quality should, of other quality should not, share a cluster (their source)."""
    l = V.table(spark, d, "labels").select(F.col("doc_id").alias("a"), "quality", (F.col("doc_id") + 1).alias("b"))
    r = V.table(spark, d, "labels").select(F.col("doc_id").alias("b"), F.col("quality").alias("q2"))
    pairs = l.join(r, "b").select(F.when(F.col("quality") == F.col("q2"), "same").otherwise("other").alias("kind"), "a", "b")
    return C.pair_accuracy(pairs, V.posts(spark, d).select("post_id", F.col("source_id").alias("cluster")), "post_id")


def concept_top_k(spark, d):
    """Eight concepts of each category by documents."""
    return ranking.most_common(V.concepts(spark, d), ["category"], "name", 8)


def graph_nodes(spark, d):
    return G.nodes(G.mentions(V.concepts(spark, d)), 15, 2)


def graph_edges(spark, d):
    return G.edges(G.mentions(V.concepts(spark, d)))


def graph_view_nodes(spark, d):
    """The concepts that a graph shows, with the first five documents of each."""
    found = materialize(G.mentions(V.concepts(spark, d)), "mentions")
    kept = materialize(G.nodes(found, 15, 2), "nodes")
    shown = kept.join(G.examples(found, kept), "concept", "left")
    return shown.select("concept", "mentions", "category", F.round(F.col("total_weight") / F.greatest("mentions", F.lit(1)), 2).alias("avg_weight"), F.size("posts").alias("posts_count"), F.array_join(F.transform("posts", lambda x: x.cast("string")), ",").alias("posts"))


def graph_view_edges(spark, d):
    """The links between those concepts, with the category of most documents that make them: an order's priority."""
    found = materialize(G.mentions(V.concepts(spark, d)), "mentions")
    kept = materialize(G.nodes(found, 15, 2), "nodes")
    documents = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).alias("category"))
    return G.edge_categories(found, kept, documents)


def graph_khop(spark, d):
    """What the strongest three links of each concept reach from one concept in three steps."""
    links = G.strongest(G.edges(G.mentions(V.concepts(spark, d))), 3)
    return G.neighbourhood(links.select(F.col("concept").alias("a"), F.col("other").alias("b")), "brand#1", 3)


def graph_components(spark, d):
    """Components of the graph of strong links."""
    e = G.strongest(G.edges(G.mentions(V.concepts(spark, d))), 1)
    return connected_components(e.select(F.col("concept").alias("src"), F.col("other").alias("dst")))


_EDGES = f"""{V.POINTS}, edges as (select a.post_id as src, b.post_id as dst, a.workspace, list_cosine_similarity(a.vector, b.vector) as similarity from points a join points b
    on a.workspace = b.workspace and a.post_id < b.post_id and abs(epoch_us(a.published_at) - epoch_us(b.published_at)) <= {GAP} * 3600000000 where list_cosine_similarity(a.vector, b.vector) >= {THETA})"""
_COMPONENTS = f"""{_EDGES}, both_ as (select src as a, dst as b from edges union select dst, src from edges union select post_id, post_id from points),
    reach(a, b) as (select a, b from both_ union select r.a, e.b from reach r join both_ e on r.b = e.a), parts as (select a as post_id, min(b) as cluster from reach group by a)"""
_CENTROIDS = f"""{V.POINTS}, u as (select workspace, unnest(vector) as x, generate_subscripts(vector, 1) as i from points), m as (select workspace, i, avg(x) as x from u group by all),
    cent as (select workspace, list(x order by i) as centroid from m group by workspace)"""
_MENTIONS = f"""{V.CONCEPTS}, me as (select doc_id, lower(name) as concept, max(weight) as weight from concepts group by 1, 2),
    mentions as (select me.doc_id, me.concept, me.weight, min(c.category) as category from me join concepts c on c.doc_id = me.doc_id and lower(c.name) = me.concept and c.weight = me.weight group by 1, 2, 3)"""
_GEDGES = f"""{_MENTIONS}, gedges as (select a.concept as a, b.concept as b, count(*) as mentions, cast(sum(least(a.weight, b.weight)) as bigint) as weight
    from mentions a join mentions b on a.doc_id = b.doc_id and a.concept < b.concept group by 1, 2)"""
_STRONGEST = f"""{_GEDGES}, sides as (select a as concept, b as other, weight from gedges union all select b, a, weight from gedges),
    ranked as (select concept, other, row_number() over (partition by concept order by weight desc, other) as r from sides)"""
_CLUSTERS = """{name} as (select *, ['c' || (post_id % 9)] as concepts from (select source_id || '-' || cast(post_id // {step} as varchar) as cluster, source_id, list(post_id) as doc_ids, min(post_id) as post_id from posts
    where source_id is not null group by 1, 2) join (select post_id, list_distinct(regexp_extract_all(lower(left(content, 180)), '{term}')) as title_terms from posts) using (post_id))"""


def _cluster_sql(name: str, step: int) -> str:
    return _CLUSTERS.format(name=name, step=step, term=tx.TERM)


similarity_edges_.__name__ = "similarity_edges"
QUERIES = {
    f.__name__: f
    for f in (
        similarity_edges_, components, centroid_by_label, coherence_by_label, representative, newest_evidence, identity_match, jaccard_pairs, greedy_merge, greedy_signal_merge,
        quality_metrics, golden_accuracy, concept_top_k, graph_nodes, graph_edges, graph_view_nodes, graph_view_edges, graph_khop, graph_components,
    )
}
_KEPT = """s as (select concept, count(*) as mentions, cast(sum(weight) as bigint) as total_weight from mentions group by concept), bc as (select concept, category, count(*) as n from mentions group by all),
    md as (select concept, category, row_number() over (partition by concept order by n desc, category) as r from bc),
    kept as (select s.*, category from s join md using (concept) where r = 1 and mentions >= 2 order by mentions desc, total_weight desc, concept limit 15)"""
ORACLES = {
    "similarity_edges": f"with {_EDGES} select src, dst, workspace, round(similarity, 6) as similarity from edges",
    "components": f"with recursive {_COMPONENTS} select post_id, workspace, cluster from points join parts using (post_id)",
    "centroid_by_label": f"with {_CENTROIDS} select workspace, cast(i - 1 as int) as place, round(x, 6) as x from m",
    "coherence_by_label": f"with {_CENTROIDS} select workspace, count(*) as n, round(avg(list_cosine_similarity(vector, centroid)), 6) as coherence from points join cent using (workspace) group by workspace",
    "representative": f"""with {_CENTROIDS}, {V.POSTS}, {V.SOURCES}, j as (select p.post_id, p.workspace, o.source_id, relevance, n_tags, authority, round(list_cosine_similarity(vector, centroid), 6) as sim,
        (epoch_us(timestamp '2024-01-12') - epoch_us(p.published_at)) / 3600000000.0 as h, count(*) over (partition by p.workspace, o.source_id) as same
        from points p join cent using (workspace) join posts o on o.post_id = p.post_id join sources s on s.source_id = o.source_id),
        k as (select *, round(0.46::double * relevance + 0.22::double * authority + 0.14::double * case when h <= 24 then 1 when h <= 72 then 0.75::double when h <= 168 then 0.45::double else 0.2::double end + 0.12::double * sim
            + 0.06::double * least(n_tags, 5) / 5 - greatest(0, (same - 1) * 0.03::double), 6) as standing from j),
        r as (select *, row_number() over (partition by workspace order by standing desc, post_id) as r from k) select workspace, post_id, standing from r where r = 1""",
    "newest_evidence": f"""with {V.POINTS}, r as (select post_id, workspace, published_at, cast(row_number() over (partition by workspace order by published_at desc, post_id desc) as int) as rank from points) select * from r where rank <= 5""",
    "identity_match": f"""with {V.POSTS}, {_cluster_sql("n", 50)}, {_cluster_sql("o", 125)}, nd as (select cluster as new, unnest(doc_ids) as doc from n), od as (select cluster as old, unnest(doc_ids) as doc from o),
        sh as (select new, old, count(distinct doc) as shared from nd join od using (doc) group by all),
        sc as (select new, old, round(0.65::double * shared + 0.20::double * coalesce(len(list_intersect(n.title_terms, o.title_terms)) / nullif(len(list_distinct(n.title_terms || o.title_terms)), 0), 0)
            + 0.15::double * coalesce(len(list_intersect(n.concepts, o.concepts)) / nullif(len(list_distinct(n.concepts || o.concepts)), 0), 0), 6) as score
            from sh join n on n.cluster = new join o on o.cluster = old),
        r as (select *, row_number() over (partition by new order by score desc, old) as r from sc where score >= 0.35) select new, old, score from r where r = 1""",
    "jaccard_pairs": f"""with {V.POSTS}, {_cluster_sql("c", 200)} select x.cluster as a, y.cluster as b,
        round(len(list_intersect(x.title_terms, y.title_terms)) / len(list_distinct(x.title_terms || y.title_terms)), 6) as jaccard
        from c x join c y on x.source_id = y.source_id and x.cluster < y.cluster where len(list_intersect(x.title_terms, y.title_terms)) > 0""",
    "quality_metrics": f"""with recursive {_COMPONENTS}, {V.POSTS}, rows_ as (select parts.cluster, p.vector, o.source_id from points p join parts using (post_id) join posts o using (post_id)),
        u as (select cluster, unnest(vector) as x, generate_subscripts(vector, 1) as i from rows_), m as (select cluster, i, avg(x) as x from u group by all), cent as (select cluster, list(x order by i) as c from m group by cluster),
        g as (select cluster, count(*) as n, avg(list_cosine_similarity(vector, c)) as coherence, count(distinct source_id) as sources from rows_ join cent using (cluster) group by cluster)
        select count(*) as clusters, round(avg(coherence), 6) as purity, round(count(*) filter (where coherence < 0.87 - 0.08) / count(*), 6) as over_merged, round(count(*) filter (where n = 1) / count(*), 6) as single,
        round(count(*) filter (where n < 2) / count(*), 6) as low_evidence, round(count(*) filter (where sources <= 1) / count(*), 6) as one_source from g""",
    "golden_accuracy": f"""with {V.POSTS}, p as (select case when x.quality = y.quality then 'same' else 'other' end as kind, x.doc_id as a, y.doc_id as b from labels x join labels y on y.doc_id = x.doc_id + 1)
        select kind, count(*) as pairs, round(avg(case when u.source_id is not distinct from w.source_id then 1.0::double else 0.0::double end), 6) as together
        from p left join posts u on u.post_id = a left join posts w on w.post_id = b group by kind""",
    "concept_top_k": f"""with {V.CONCEPTS}, n as (select category, name, count(*) as n from concepts group by all), r as (select *, cast(row_number() over (partition by category order by n desc, name) as int) as rank from n)
        select * from r where rank <= 8""",
    "graph_nodes": f"""with {_MENTIONS}, s as (select concept, count(*) as mentions, cast(sum(weight) as bigint) as total_weight, max(weight) as max_weight, round(avg(weight), 4) as avg_weight from mentions group by concept),
        bc as (select concept, category, count(*) as n from mentions group by all), md as (select concept, category, row_number() over (partition by concept order by n desc, category) as r from bc)
        select s.*, category from s join md using (concept) where r = 1 and mentions >= 2 order by mentions desc, total_weight desc, concept limit 15""",
    "graph_edges": f"with {_GEDGES} select * from gedges",
    "graph_view_nodes": f"""with {_MENTIONS}, {_KEPT}, r as (select concept, doc_id, row_number() over (partition by concept order by doc_id) as r from mentions where concept in (select concept from kept)),
        e as (select concept, cast(count(*) as int) as posts_count, string_agg(cast(doc_id as varchar), ',' order by doc_id) as posts from r where r <= 5 group by concept)
        select concept, mentions, category, round(total_weight / mentions, 2) as avg_weight, posts_count, posts from kept left join e using (concept)""",
    "graph_view_edges": f"""with {_MENTIONS}, {_KEPT}, m as (select doc_id, concept, weight, coalesce(case when o_orderkey % 5 > 0 then o_orderpriority end, 'uncategorized') as c from mentions left join orders on o_orderkey = doc_id
            where concept in (select concept from kept)),
        p as (select x.concept as a, y.concept as b, x.c as category, count(*) as n, sum(least(x.weight, y.weight)) as w from m x join m y on x.doc_id = y.doc_id and x.concept < y.concept group by all)
        select a, b, cast(sum(n) as bigint) as mentions, cast(sum(w) as bigint) as weight, first(category order by n desc, category) as category from p group by a, b""",
    "graph_khop": f"""with recursive {_STRONGEST}, l as (select concept as a, other as b from ranked where r <= 3 union select other, concept from ranked where r <= 3),
        walk(concept, hops) as (select 'brand#1', 0 union select b, hops + 1 from walk join l on l.a = walk.concept where hops < 3) select concept, cast(min(hops) as int) as hops from walk group by concept""",
    "graph_components": f"""with recursive {_STRONGEST}, l as (select concept as a, other as b from ranked where r <= 1 union select other, concept from ranked where r <= 1),
        reach(a, b) as (select a, b from l union select r.a, l.b from reach r join l on r.b = l.a) select a as node, least(a, min(b)) as component from reach group by a""",
}
