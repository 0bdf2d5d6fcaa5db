"""Inputs that larger tables have and the small ones lack, and results that must not change with the way they are reached."""

import datetime as dt
import random
import time

import duckdb
from pyspark.sql import functions as F

from tests.oracle import rows_of
from tidemark import registry


def _same(spark, name, folder, *tables):
    """A query against its SQL over the tables of a folder."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got, want = registry.QUERIES[name](spark, str(folder)), con.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())


def test_titles_with_cut_entities(spark, tmp_path):
    titles = ["a &amp;&amp;&amp; b", "cut &amp", "cut&amp;&amp", "&ltb&gt x", "&quot;q&quot", "it&#x27;s", "it&#x27 s", "&amp;lt;", "&a", "&", "x &lt; y &gt"]
    rows = [(i, "http://x", f'<html lang="en"><head><title>{t}</title></head><body><p>p</p></body></html>') for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    _same(spark, "crawl_meta", tmp_path, "pages")
    got = {r.page_id: r.title for r in registry.QUERIES["crawl_meta"](spark, str(tmp_path)).collect()}
    assert got[1] == "cut &" and got[7] == "&lt;"


def test_equal_schedules_are_answered_once(spark):
    from tidemark.functions import cron

    rows = spark.range(200_000).select("id", F.concat((F.col("id") % 29 + 1).cast("string"), F.lit(" */6 * * *")).alias("cron"))
    got = cron.interval_minutes(rows, "id", "cron", F.lit("2024-01-31 12:30:00"))
    began = time.monotonic()
    assert got.groupBy("interval").count().collect() == [(360, 200_000)]
    assert time.monotonic() - began < 40  # 1,500 days were looked at for each row
    empty = spark.createDataFrame([(1, None), (2, None), (3, "0 0 29 feb *")], "id long, cron string")
    assert {tuple(r) for r in cron.interval_minutes(empty, "id", "cron", F.lit("2024-01-31 12:30:00"), days=1400).collect()} == {(1, 60), (2, 60), (3, 60)}


def test_edges_in_blocks_equal_all_pairs(spark, monkeypatch):
    from tidemark.operators import similarity

    monkeypatch.setattr(similarity.blocks, "__defaults__", (7,))
    rnd = random.Random(8)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, rnd.choice("ab") if i % 19 else None, [rnd.gauss(0, 1) for _ in range(3 + (i % 5 == 0))], t0 + dt.timedelta(minutes=rnd.randrange(0, 3000))) for i in range(150)]
    rows += [(200, "a", [0.0, 0.0, 0.0], t0), (201, "a", None, t0), (202, "a", [1.0, 0.0, 0.0], None), (203, "a", [], t0), *[(300 + i, "b", [1.0, 2.0, 3.0], t0) for i in range(20)]]
    df = spark.createDataFrame(rows, "post_id long, workspace string, vector array<double>, published_at timestamp_ntz")
    found = similarity.similarity_edges(df, 0.5, 5)
    got = {(r.src, r.dst): r.similarity for r in found.collect()}
    assert found.count() == len(got)

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    want = {}
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            if x[1] and x[1] == y[1] and x[2] and y[2] and any(x[2]) and any(y[2]) and x[3] and y[3] and len(x[2]) == len(y[2]) and abs(x[3] - y[3]) <= dt.timedelta(hours=5):
                if (c := cosine(x[2], y[2])) >= 0.5:
                    want[x[0], y[0]] = c
    assert set(got) == set(want) and len(want) > 300 and all(abs(got[p] - want[p]) < 1e-12 for p in want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan  # rows meet in blocks, not pair by pair


def test_index_with_copies_and_odd_vectors(spark):
    from tidemark.functions import vectors as v
    from tidemark.operators import ivf, ranking

    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(80)]
    rows += [(100 + i, rows[3][1]) for i in range(40)] + [(200, [0.0] * 4), (201, None), (202, [float("nan"), 1.0, 0.0, 0.0])]
    points = spark.createDataFrame(rows, "post_id long, vector array<double>")
    table = points.withColumn("cell", F.when(F.col("post_id") < 200, (F.col("post_id") % 2).cast("int")).otherwise(-1))
    centres = spark.createDataFrame([(0, [1.0] * 4), (1, [-1.0] * 4), (-1, [0.0] * 4)], "cell int, centre array<double>")
    queries = points.filter("post_id in (3, 5, 8, 200, 201)").select(F.col("post_id").alias("query_id"), F.col("vector").alias("q"))
    found = ivf.InvertedFile("", centres, table).search(queries, 9, 3)
    pairs = queries.crossJoin(points).withColumn("similarity", F.round(v.cosine(F.col("vector"), F.col("q")), 9))
    want = ranking.top_k(pairs.select("query_id", "post_id", "similarity"), ["query_id"], [F.desc("similarity"), F.asc("post_id")], 9, "rank")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.select(found.columns).collect()))
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
