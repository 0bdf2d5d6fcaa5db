"""The model's tables over the driver's: each once in Spark and once as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import text as tx

AS_OF = "2024-01-31 12:30:00"
START = "2024-01-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def hours_before(ts, now=None):
    """Hours from ``ts`` to the reference time."""
    now = as_of() if now is None else now
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str, first: int | None = None) -> DataFrame:
    """post_id, source_id, workspace, content, published_at, relevance, status, n_tags; of the content its ``first`` characters, if so many
    will do, so that whole texts aren't shuffled."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    docs = docs if first is None else docs.withColumn("text", F.left("text", F.lit(first)))
    published = F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("doc_id") % 1170 * 37).cast("int"), F.lit(0))
    return docs.join(labels.select("doc_id", "quality"), "doc_id", "left").select(
        F.col("doc_id").alias("post_id"),
        F.col("source").alias("source_id"),
        F.col("lang").alias("workspace"),
        F.col("text").alias("content"),
        published.alias("published_at"),
        F.when(F.col("quality") == 1, 0.8).when(F.col("quality") == 0, 0.3).otherwise(0.6).alias("relevance"),
        F.when(F.col("doc_id") % 10 == 0, "error").when(F.col("doc_id") % 10 == 1, "pending").when(F.col("doc_id") % 10 == 2, "dropped").otherwise("done").alias("status"),
        (F.col("doc_id") % 6).alias("n_tags"),
    )


POSTS = """posts as (select d.doc_id as post_id, source as source_id, lang as workspace, text as content,
    timestamp '2024-01-01' + to_minutes(cast(d.doc_id % 1170 * 37 as bigint)) as published_at,
    case when quality = 1 then 0.8::double when quality = 0 then 0.3::double else 0.6::double end as relevance,
    case d.doc_id % 10 when 0 then 'error' when 1 then 'pending' when 2 then 'dropped' else 'done' end as status,
    d.doc_id % 6 as n_tags from documents d left join labels l on d.doc_id = l.doc_id)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, kind, authority, full_content: one row for each source."""
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return (
        table(spark, sf_dir, "documents")
        .filter(F.col("source").isNotNull())
        .select("source")
        .distinct()
        .select(
            F.col("source").alias("source_id"),
            F.element_at(F.array(*[F.lit(k) for k in ("rss", "api", "web", "email", "telegram")]), n % 5 + 1).alias("kind"),
            ((n * 7 % 10) / 10).alias("authority"),
            (n % 4 != 2).alias("full_content"),
        )
    )


SOURCES = r"""sources as (select source as source_id, (['rss','api','web','email','telegram'])[n % 5 + 1] as kind,
    (n * 7 % 10) / 10.0::double as authority, n % 4 <> 2 as full_content
    from (select distinct source, cast(regexp_extract(source, '(\d+)$', 1) as int) as n from documents where source is not null))"""


def source_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, source_id, status, started_at, fetched, emitted, error_text."""
    k = F.get_json_object("props", "$.k").cast("int")
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source_id"),
        F.when(failed, "error").otherwise("success").alias("status"),
        F.col("ts").cast("timestamp_ntz").alias("started_at"),
        k.alias("fetched"),
        F.when(failed, 0).otherwise(F.floor(k / 2)).cast("int").alias("emitted"),
        F.when(failed, F.when(k % 3 == 0, "HTTP 403").otherwise("timeout")).alias("error_text"),
    )


SOURCE_RUNS = """source_runs as (select event_id as run_id, 'src' || (user_id % 20) as source_id,
    case when event_type = 'error' then 'error' else 'success' end as status, ts as started_at, k as fetched,
    case when event_type = 'error' then 0 else k // 2 end as emitted,
    case when event_type = 'error' then case when k % 3 = 0 then 'HTTP 403' else 'timeout' end end as error_text
    from (select *, cast(json_extract_string(props, '$.k') as int) as k from events))"""


def crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id and url of posts whose links were crawled."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("post_id"), "url")


CRAWLS = "crawls as (select page_id as post_id, url from pages)"


def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend clusters over orders: numbers that only exercise the predicates."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("cluster_key"),
        F.col("c_mktsegment").alias("workspace"),
        ((F.col("o_orderkey") * 37 % 1000) / 1000).alias("signal_score"),
        (F.col("o_orderkey") % 9 + 1).alias("doc_count"),
        (F.col("o_custkey") % 6 + 1).alias("source_count"),
        (F.col("o_orderkey") % 4 == 0).alias("recent_change"),
        ((F.col("o_orderkey") * 13 % 100) / 100).alias("strength"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("detected_at"),
        F.when(F.col("o_orderkey") % 5 == 0, "stable").when(F.col("o_orderkey") % 5 == 1, "emerging").when(F.col("o_orderkey") % 5 == 2, "fading").otherwise("weak").alias("stage"),
    )


TRENDS = """trends as (select o_orderkey as cluster_key, c_mktsegment as workspace, (o_orderkey * 37 % 1000) / 1000.0::double as signal_score,
    o_orderkey % 9 + 1 as doc_count, o_custkey % 6 + 1 as source_count, o_orderkey % 4 = 0 as recent_change,
    (o_orderkey * 13 % 100) / 100.0::double as strength, o_orderdate as detected_at,
    case o_orderkey % 5 when 0 then 'stable' when 1 then 'emerging' when 2 then 'fading' else 'weak' end as stage
    from orders join customer on o_custkey = c_custkey)"""


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, name, category, weight: concepts that documents mention."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("p_brand").alias("name"),
        F.col("p_type").alias("category"),
        (1 + F.col("l_quantity").cast("int") % 5).alias("weight"),
    )


CONCEPTS = """concepts as (select l_orderkey as doc_id, p_brand as name, p_type as category, 1 + cast(l_quantity as int) % 5 as weight
    from lineitem join part on l_partkey = p_partkey)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id, workspace, vector (doubles), published_at of embedded posts."""
    published = F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("vec_id") % 1170 * 37).cast("int"), F.lit(0))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("post_id"), F.col("label").alias("workspace"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), published.alias("published_at")
    )


POINTS = """points as (select vec_id as post_id, label as workspace, cast(embedding as double[]) as vector,
    timestamp '2024-01-01' + to_minutes(cast(vec_id % 1170 * 37 as bigint)) as published_at from embeddings)"""


def terms_of(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("terms", tx.terms(F.col(column)))
