"""Operators on small tables."""

import collections
import datetime as dt
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cluster_job, clusters as C, ranking, series as T, signals as G2, upsert as U
from tidemark.operators.components import connected_components
from tidemark.operators.similarity import similarity_edges
from tidemark.plans import clustering, observability, signals
from tidemark.sources import connectors
from tidemark.streaming import jobs


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, None)]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {(r.node, r.component) for r in got} == {(i, 0) for i in range(41)} | {(100 + i, 100) for i in range(30)}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_similarity_edges_equal_all_pairs(spark):
    random.seed(4)
    rows = [(i, i % 2, [random.gauss(0, 1) for _ in range(3)], dt.datetime(2024, 1, 1) + dt.timedelta(minutes=random.randrange(6000))) for i in range(80)]
    df = spark.createDataFrame(rows, "post_id long, workspace int, vector array<double>, published_at timestamp_ntz")
    got = {(r.src, r.dst) for r in similarity_edges(df, 0.5, 5).collect()}

    def cos(a, b):
        return np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)

    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] and abs((a[3] - b[3]).total_seconds()) <= 5 * 3600 and cos(a[2], b[2]) >= 0.5}
    assert got == want and want


def test_cluster_posts_keeps_lone_posts(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 0, [1.0, 0.0], t), (2, 0, [0.99, 0.01], t), (3, 0, [0.0, 1.0], t)]
    df = spark.createDataFrame(rows, "post_id long, workspace int, vector array<double>, published_at timestamp_ntz")
    assert sorted((r.post_id, r.cluster) for r in C.cluster_posts(df, 0.92, 24).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_representative_prefers_the_independent_source(spark):
    rows = [("g", 1, "same", 0.82, 0.70, 1.0, 1.0, 1), ("g", 2, "same", 0.81, 0.70, 1.0, 1.0, 1), ("g", 3, "other", 0.80, 0.72, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "g string, post_id long, source_id string, relevance double, source_score double, fresh double, similarity double, n_tags int")
    row = C.representatives(df, ["g"]).first()
    assert (row.post_id, row.standing) == (3, pytest.approx(0.7984))


def test_identity(spark):
    kind = "cluster string, doc_ids array<string>, title_terms array<string>, concepts array<string>"
    new = spark.createDataFrame([("n", ["p1", "p2"], ["a"], ["x"])], kind)
    old = spark.createDataFrame([("o", ["p2", "p9"], ["a"], ["x"]), ("z", ["p7"], ["a"], ["x"])], kind)
    assert [(r.new, r.old, r.score) for r in C.match_identity(new, old).collect()] == [("n", "o", 1.0)]


def test_identity_by_equal_terms_and_concepts(spark):
    kind = "cluster string, doc_ids array<string>, title_terms array<string>, concepts array<string>"
    new = spark.createDataFrame([("n", ["p1"], ["x", "y"], ["c"]), ("m", ["p2"], [], [])], kind)
    old = spark.createDataFrame([("o", ["q1"], ["y", "x", "x"], ["c"]), ("o2", ["q2"], ["y", "x"], ["d"]), ("o3", ["q3"], [], [])], kind)
    assert [(r.new, r.old, r.score) for r in C.match_identity(new, old).collect()] == [("n", "o", 0.35)]


def test_unrelated_new_signals_survive_a_merge(spark):
    rows = [("w", "s1", ["p1", "p2", "p3"], ["k"], ["t"], 0.9), ("w", "s2", ["p2", "p3", "p4"], ["k"], ["t"], 0.8), ("w", "s3", ["q"], ["z"], ["y"], 0.7)]
    df = spark.createDataFrame(rows, "workspace string, signal string, doc_ids array<string>, keywords array<string>, title_terms array<string>, score double")
    assert sorted((r.signal, r.merged) for r in C.merge_signals(df).collect()) == [("s1", "s1"), ("s2", "s1"), ("s3", "s3")]


def test_signal_merge_equals_the_formula(spark):
    kind = (
        "workspace string, signal string, doc_ids array<string>, semantic_cluster_ids array<long>, keywords array<string>, title_terms array<string>, score double, "
        "first_seen timestamp_ntz, last_seen timestamp_ntz"
    )
    t, far = dt.datetime(2024, 1, 1), dt.datetime(2024, 6, 1)
    pairs = {
        "too low": (("a", [1, 2], ["k"], ["x", "y"], t), ("b", [1, 2], ["k", "l", "m"], ["x", "y"], t), False),  # .22 + .08 + .16 + .10 = .56
        "five terms": (("a b c d e", [1], ["k"], ["x", "y"], t), ("a f g h i", [1], ["k"], ["x", "y"], t), True),  # .031 + .22 + .24 + .16 + .10 = .751
        "union": (("a", [1], ["k"], ["x"], t), ("a b c d e", [2], ["l"], ["y"], t), False),  # one of five documents, not of one
        "documents": (("a b", [1], ["k"], ["x"], t), ("a b c", [2], ["l"], ["y"], far), True),
        "title": (("a", [1], ["k"], ["x", "y"], t), ("b", [2], ["k"], ["x", "y", "z"], t), True),
        "title, other time": (("a", [1], ["k"], ["x", "y"], t), ("b", [2], ["k"], ["x", "y", "z"], far), False),
    }
    rows = [(w, s, docs.split(), sem, kw, title, score, at, at) for w, two in pairs.items() for s, score, (docs, sem, kw, title, at) in (("s1", 0.9, two[0]), ("s2", 0.8, two[1]))]
    got = {r.workspace: r.merged == "s1" for r in C.merge_signals(spark.createDataFrame(rows, kind)).collect() if r.signal == "s2"}
    assert got == {w: two[2] for w, two in pairs.items()}
    got = {r.workspace: r.merged == "s1" for r in C.merge_signals(spark.createDataFrame(rows, kind), least=0.55).collect() if r.signal == "s2"}
    assert got == {w: two[2] or w == "too low" for w, two in pairs.items()}  # the score alone, as its keywords share a third


def test_signal_merge_equals_brute_force(spark):
    rnd = random.Random(5)

    def some(values, n):
        return sorted(rnd.sample(values, rnd.randrange(1, n)))

    rows = []
    for i in range(60):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(days=rnd.randrange(60))
        rows.append((i % 2, i, some(range(40), 6), some(range(3), 3), some("klm", 3), some("wxyz", 4), rnd.random(), at, at + dt.timedelta(days=rnd.randrange(9))))
    kind = "workspace int, signal long, doc_ids array<long>, semantic_cluster_ids array<long>, keywords array<string>, title_terms array<string>, score double, first_seen timestamp_ntz, last_seen timestamp_ntz"
    want, branches = set(), set()

    def ratio(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b))

    for w in (0, 1):
        left = sorted((list(r) for r in rows if r[0] == w), key=lambda r: -r[6])
        while left:
            top, rest = left.pop(0), []
            want.add((w, top[1], top[1]))
            for r in left:
                doc, sem, kw, title = (ratio(top[k], r[k]) for k in (2, 3, 4, 5))
                near = abs(max(top[7], r[7]) - min(top[8], r[8])) <= dt.timedelta(days=30)
                hit = (doc >= 0.25, 0.28 * doc + 0.22 * sem + 0.24 * kw + 0.16 * title + 0.10 * near >= 0.72, kw >= 0.6 and title >= 0.45 and near)
                branches |= {k for k in range(3) if hit[k]}
                if any(hit):
                    want.add((w, r[1], top[1]))
                    top[2], top[3] = {*top[2], *r[2]}, {*top[3], *r[3]}
                else:
                    rest.append(r)
            left = rest
    assert {tuple(r) for r in C.merge_signals(spark.createDataFrame(rows, kind)).collect()} == want and branches == {0, 1, 2}


_CLUSTER = "workspace string, cluster string, doc_ids array<string>, title_terms array<string>, concepts array<string>, centroid array<double>, coherence double, first_seen timestamp_ntz, last_seen timestamp_ntz"


def test_cluster_merge(spark):
    t, late = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 20)
    rows = [
        ("w", "a", ["a1", "a2"], ["x", "y"], ["c"], [1.0, 0.0], 0.9, t, t), ("w", "b", ["b1", "b2"], ["x", "y"], ["c"], [0.9, 0.1], 0.8, t, t), ("w", "c", ["c1"], ["q"], ["r"], [0.0, 1.0], 0.7, t, t),
        ("w", "d", ["d1"], ["x", "y"], ["c"], [1.0, 0.0], 0.9, t, late), ("v", "a", ["a1"], ["x"], ["c"], [1.0, 0.0], 0.9, t, t),
    ]
    got = sorted((r.workspace, r.cluster, r.merged) for r in C.merge_clusters(spark.createDataFrame(rows, _CLUSTER)).collect())
    assert got == [("v", "a", "a"), ("w", "a", "a"), ("w", "b", "a"), ("w", "c", "c"), ("w", "d", "d")]


def test_cluster_merge_equals_brute_force(spark):
    rnd = random.Random(12)
    rows = []
    for i in range(80):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.choice([0, 700]) + rnd.randrange(240))
        docs = [f"d{rnd.randrange(60)}" for _ in range(rnd.randrange(1, 5))]
        rows.append((f"w{i % 2}", f"c{i:02}", sorted(set(docs)), rnd.sample("pqrstuv", 3), rnd.sample("klmn", 2), [rnd.random(), rnd.random(), rnd.random() - 0.5], rnd.random(), at, at))

    def ratio(x, y):
        return len(set(x) & set(y)) / len(set(x) | set(y))

    want, text_branch = set(), 0
    for w in ("w0", "w1"):
        left = sorted((list(r) for r in rows if r[0] == w), key=lambda r: (r[8], r[6]), reverse=True)
        while left:
            top, rest = left[0], []
            want.add((w, top[1], top[1]))
            weight = len(top[2])
            for r in left[1:]:
                gap = (top[8] - r[8]).total_seconds() / 3600
                cos = sum(x * y for x, y in zip(top[5], r[5])) / math.sqrt(sum(x * x for x in top[5]) * sum(x * x for x in r[5]))
                t, c = ratio(top[3], r[3]), ratio(top[4], r[4])
                like = 0.45 * cos + 0.25 * c + 0.15 * t + 0.10 * max(0, 1 - gap / 168) + 0.05 * ratio(top[2], r[2])
                if gap <= 168 and (like >= 0.78 or (t >= 0.4 and c >= 0.5)):
                    text_branch += like < 0.78
                    want.add((w, r[1], top[1]))
                    n = len(r[2])
                    top[5] = [(x * weight + y * n) / (weight + n) for x, y in zip(top[5], r[5])]
                    weight += n
                    top[2] = sorted({*top[2], *r[2]})
                    for k in (3, 4):
                        top[k] = [x for x, _ in collections.Counter(top[k] + r[k]).most_common(8)]
                else:
                    rest.append(r)
            left = rest
    assert {tuple(r) for r in C.merge_clusters(spark.createDataFrame(rows, _CLUSTER)).collect()} == want and text_branch and len(want) > len({x[2] for x in want})


def test_signals_equal_brute_force(spark):
    rnd, now = random.Random(6), dt.datetime(2024, 4, 9, 12, 30)
    rows = []
    for i in range(400):
        signal = rnd.randrange(14)
        at = now - dt.timedelta(hours=rnd.choice([rnd.randrange(40), rnd.randrange(500), 200 + signal]))
        text = "a prank today" if signal % 3 == 0 and rnd.random() < 0.8 else "plain words"
        rows.append((f"w{signal % 2}", signal, signal * 10 + rnd.randrange(4), i, f"s{rnd.randrange(1 + signal % 5)}", at, text, rnd.choice([0.9, 0.7, 0.8]), [1 + rnd.random() / 4, rnd.random() / 4], rnd.sample("abcdefghijkl", 3)))
    names = "workspace string, signal int, cluster int, post_id int, source_id string, published_at timestamp_ntz, content string, relevance double, vector array<double>, concepts array<string>"
    df = spark.createDataFrame(rows, names)
    got = {r.signal: r for r in G2.score_signals(df, ["workspace", "signal"], F.lit(str(now)).cast("timestamp_ntz")).collect()}
    assert len(got) == 14
    stages = set()
    for signal in range(14):
        mine = [r for r in rows if r[1] == signal]
        clusters = collections.defaultdict(list)
        for r in mine:
            clusters[r[2]].append(r)
        n, sources = len(mine), len({r[4] for r in mine})
        centre = [sum(r[8][k] for r in mine) / n for k in (0, 1)]
        close = sum((r[8][0] * centre[0] + r[8][1] * centre[1]) / math.hypot(*r[8]) / math.hypot(*centre) for r in mine) / n
        div = 0 if sources <= 1 else min(1, sources / max(len(clusters), 2))
        evidence = min(6, sum(min(2, len(c)) for c in clusters.values()))
        rel = sum(sum(r[7] for r in c) / len(c) for c in clusters.values()) / len(clusters)
        strength = min(1, evidence / 2 * 0.5 + rel * 0.5)
        last = max(r[5] for r in mine)
        burst = min(1, sum(r[5] >= now - dt.timedelta(days=7) for r in mine) / n + min(len(clusters), 4) * 0.08)
        words = collections.Counter()
        for c in clusters.values():
            top = collections.Counter(x for r in c for x in r[9])
            words.update(x for x, _ in sorted(top.items(), key=lambda x: (-x[1], x[0]))[:8])
        novelty = min(1, min(len(words), 5) / 5 * 0.5 + div * 0.5)
        days = collections.Counter(r[5].date() for r in mine)
        series = [(dt.datetime.combine(d, dt.time()) + dt.timedelta(days=1), days[d]) for d in sorted(days)]

        def total(low, high):
            return [x for end, x in series if now - dt.timedelta(hours=low) <= end and (high is None or end < now - dt.timedelta(hours=high))]

        base = total(336, 24)
        current, before = round(sum(total(24, None)) / 24, 6), round(sum(total(48, 24)) / 24, 6)
        velocity = current - round(sum(base) / max(len(base) * 24, 24), 6)
        steps = [abs(b[1] - a[1]) for a, b in zip(series, series[1:])]
        change, recent = 0.0, False
        if len(series) >= 4:
            hit = [i for i, x in enumerate(steps, 1) if x >= max(1.5 * sum(steps) / len(steps), 1)]
            change = (steps[hit[-1] - 1] if hit else abs(series[-1][1] - series[0][1])) / max(x for _, x in series)
            recent = bool(hit) and series[hit[-1]][0] >= now - dt.timedelta(hours=48)
        idle = (now - last).total_seconds() / 3600
        fresh = 1 if idle <= 24 else 0.75 if idle <= 72 else 0.45 if idle <= 168 else 0.2
        jokes = round(sum((r[5].month, r[5].day) in ((4, 1), (4, 2)) and "prank" in r[6] for r in mine) / n, 4)
        raw = 0.18 * burst + 0.14 * velocity + 0.1 * (current - before) + 0.2 * close + 0.12 * novelty + 0.12 * div + 0.08 * fresh + 0.06 * strength + 0.14 * change
        score = round(max(0, min(1, raw)) * round(1 - 0.45 * jokes, 4), 6)
        stage = "weak"
        if len(clusters) >= 2 and n >= 4 and score >= 0.58 and div >= 0.2 and (recent or velocity > 0):
            stage = "stable"
        elif score >= 0.42 and evidence >= 2 and div >= 0.2 and (recent or velocity > 0 or current - before > 0):
            stage = "emerging"
        elif idle > 240 or (velocity <= 0 and not recent):
            stage = "fading"
        if jokes >= 0.34 and stage in ("stable", "emerging"):
            stage = "weak"
        r = got[signal]
        assert (r.docs, r.sources, r.clusters, r.evidence, r.recent_change, r.stage) == (n, sources, len(clusters), evidence, recent, stage)
        for value, want in ((r.coherence, close), (r.novelty, novelty), (r.velocity, velocity), (r.change_strength, change), (r.score, score), (r.confidence, min(1, 0.45 * close + 0.3 * strength + 0.25 * div))):
            assert value == pytest.approx(want, abs=2e-6)
        stages.add(stage)
    assert len(stages) > 1


def test_weak_signals_that_fall_short_go(spark):
    df = spark.createDataFrame([(1, "weak", 0.5, 0.6, 0.3, 1), (2, "weak", 0.4, 0.6, 0.3, 1), (3, "fading", 0.1, 0.1, 0.0, 1), (4, "weak", 0.5, 0.6, 0.1, 1)], "id int, stage string, score double, confidence double, diversity double, sources int")
    assert sorted(r.id for r in G2.without_weak(df).collect()) == [1, 3]


def test_groups_of_clusters(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("w", 1, t, [1.0, 0.0]), ("w", 1, t, [1.0, 0.2]), ("w", 2, t, [1.0, 0.1]), ("w", 3, t, [0.0, 1.0]), ("w", 4, t + dt.timedelta(days=40), [1.0, 0.1]), ("v", 5, t, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "workspace string, cluster long, published_at timestamp_ntz, vector array<double>")
    assert sorted((r.workspace, r.cluster, r.signal) for r in G2.group_clusters(df, 0.9, 720).collect()) == [("v", 5, 5), ("w", 1, 1), ("w", 2, 1), ("w", 3, 3), ("w", 4, 4)]


def test_queries_read_whole_texts(spark, tmp_path):
    words = " ".join(f"w{i:02}" for i in range(30))
    texts = [" ".join(f"http://h{i}.org/" for i in range(120)), "x" * 60 + " April Fool", words, words]
    rows = [(i * 3, t, "en", "src1", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert observability.media_unnest_counts(spark, str(tmp_path)).count() == 120
    assert signals.april_fools_guard(spark, str(tmp_path)).first()["share"] == 0.75  # ids 0 and 6 have a cue before the text, 3 inside it
    terms = {tuple(r.title_terms) for r in clustering._clusters(spark, str(tmp_path), 1).collect()}
    assert tuple(words.split()) in terms


def test_golden_pairs(spark):
    pairs = spark.createDataFrame([("same", 1, 2), ("other", 1, 3), ("same", 8, 9)], "kind string, a long, b long")
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "post_id long, cluster long")
    assert {(r.kind, r.together) for r in C.pair_accuracy(pairs, clusters, "post_id").collect()} == {("same", 1.0), ("other", 0.0)}


def test_momentum(spark):
    now = dt.datetime(2024, 1, 31, 12, 30)
    end = dt.datetime(2024, 1, 31, 12, 0)
    rows = [("e", end - dt.timedelta(days=k), n) for k, n in ((2, 1), (1, 1), (0, 6))]
    df = spark.createDataFrame(rows, "entity string, window_end timestamp_ntz, doc_count long")
    row = T.momentum(df, ["entity"], F.lit(now).cast("timestamp_ntz")).first()
    assert (row.current_rate, row.baseline_rate, row.velocity, row.acceleration) == (0.25, 0.041667, 0.208333, 0.208333)


def test_pelt_finds_steps():
    assert T.pelt(np.array([1.0] * 10 + [9.0] * 10 + [1.0] * 10), 2, 3.0) == [10, 20]
    assert T.pelt(np.array([2.0] * 8), 2, 3.0) == []
    random.seed(2)
    for _ in range(30):
        x = np.array([random.randrange(6) for _ in range(12)], float)

        def cost(cuts):
            edges = [0, *cuts, 12]
            return sum(((x[a:b] - x[a:b].mean()) ** 2).sum() + 2.5 for a, b in zip(edges, edges[1:]))

        every = [c for k in range(6) for c in itertools.combinations(range(2, 11), k) if all(b - a >= 2 for a, b in zip((0, *c), (*c, 12)))]
        assert cost(T.pelt(x, 2, 2.5)) == pytest.approx(min(map(cost, every)))


def test_counter_that_restarts(spark):
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate([1, 4, 2, 5])], "l string, t int, v double")
    assert T.counter_increase(df, ["l"], "t", "v").first()["increase"] == 3 + 2 + 3


def test_fusion_and_ranks(spark):
    lanes = [spark.createDataFrame(rows, "id long, rank long") for rows in ([(1, 1), (2, 2)], [(2, 1), (3, 2)])]
    best = ranking.fuse_ranks(lanes, "id").orderBy(F.desc("score")).first()
    assert best["id"] == 2 and best["lanes"] == 2
    df = spark.createDataFrame([(1, None), (2, None), (3, "c"), (4, "c")], "id long, c string")
    assert [r.id for r in ranking.first_of_each(df, F.col("c"), [F.asc("id")], 6).collect()] == [1, 2, 3]


def test_upserts(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "id long, v long, x string")
    new = spark.createDataFrame([(2, 6, "c"), (3, 1, "d"), (3, 2, "e")], "id long, v long, x string")
    assert sorted(map(tuple, U.replace_all(old, new, ["id"], "v").collect())) == [(1, 5, "a"), (2, 6, "c"), (3, 2, "e")]
    assert sorted(map(tuple, U.keep_first(old, new, ["id"], ["v"]).collect())) == [(1, 5, "a"), (2, 5, "b"), (3, 1, "d")]
    assert sorted(map(tuple, U.replace_slice(old, new, ["id"]).collect())) == [(1, 5, "a"), (2, 6, "c"), (3, 1, "d"), (3, 2, "e")]


def test_connectors(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><guid>g1</guid><link>https://E.com/a?utm_x=1</link><title>One</title><description>&lt;p&gt;Hello &lt;a href='x'&gt;world&lt;/a&gt;&lt;/p&gt; Continue</description><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate></item></channel></rss>")
    row = connectors.rss(spark, str(tmp_path / "feed.xml")).first()
    assert (row.external_id, row.url, row.content, str(row.published_at)) == ("g1", "https://e.com/a", "Hello world Continue", "2024-01-02 03:04:05")
    (tmp_path / "api.json").write_text('{"data": {"items": [{"id": 7, "name": "T", "when": "2024-01-02"}, {"id": 8, "name": "U"}]}}')
    items = connectors.api_json(spark, str(tmp_path / "api.json"), "data.items", {"guid": "id", "title": "name", "published": "when"})
    assert sorted((r.external_id, r.title) for r in items.collect()) == [("7", "T"), ("8", "U")]
    (tmp_path / "m.eml").write_bytes(b"Subject: Hi\r\nMessage-ID: <a@b>\r\nDate: Tue, 02 Jan 2024 03:04:05 +0000\r\nContent-Type: text/plain\r\n\r\nBody\r\n")
    mail = connectors.mailbox(spark, str(tmp_path / "m.eml")).first()
    assert (mail.external_id, mail.title, mail.content, str(mail.published_at)) == ("<a@b>", "Hi", "Body", "2024-01-02 03:04:05")
    once = connectors.select_items(items.unionByName(items), seen=items.filter("external_id = '8'"))
    assert [r.external_id for r in once.collect()] == ["7"]


def test_web_listing(spark):
    page = '<nav><a href="/menu">m</a></nav><a href="/One?utm_x=1#a">1</a><a href="https://b.net/2">2</a><a href="/One">1</a><a href="mail">x</a>' + "".join(f'<a href="/p{i}">p</a>' for i in range(20))
    df = spark.createDataFrame([("https://A.net/list", page)], "url string, html string")
    got = {r.link for r in connectors.web_listing(df).collect()}
    assert got == {"https://a.net/One", "https://b.net/2", *(f"https://a.net/p{i}" for i in range(20))}


def test_rate_limit_equals_a_log(spark):
    sf = "/root/testdata/sf0.001"
    s = jobs.read_table(spark, f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((r.user_id, r.ts, r.accepted) for r in jobs.drain(jobs.rate_limited(s, "user_id", "ts", 2, 86400), "rl").collect())
    want, logs = [], {}
    for r in sorted(spark.read.parquet(f"{sf}/events.parquet").collect(), key=lambda r: (r.user_id, r.ts)):
        log = [t for t in logs.get(r.user_id, []) if t > r.ts - dt.timedelta(days=1)]
        ok = len(log) < 2
        logs[r.user_id] = log + [r.ts] * ok
        want.append((r.user_id, r.ts, ok))
    assert got == sorted(want) and not all(x[2] for x in got)


def _folds(rows, fold):
    """Each workspace folded as a whole."""
    out = set()
    for w in {r["workspace"] for r in rows}:
        out |= {tuple(x) for x in fold(pd.DataFrame([r for r in rows if r["workspace"] == w])).itertuples(index=False)}
    return out


def test_cluster_merges_by_components_equal_folds_of_whole_workspaces(spark):
    rnd = random.Random(21)
    rows = []
    for w in range(1000):  # a workspace is an input of its own
        for i in range(rnd.randrange(2, 7)):
            at = dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randrange(400))
            rows.append({
                "workspace": w, "cluster": i, "doc_ids": sorted({rnd.randrange(12) for _ in range(rnd.randrange(1, 4))}), "title_terms": rnd.sample("pqrst", rnd.randrange(0, 4)),
                "concepts": rnd.sample("klmn", rnd.randrange(0, 3)), "centroid": [rnd.random(), rnd.random()], "coherence": rnd.random(), "last_seen": at,
            })
    kind = "workspace long, cluster long, doc_ids array<long>, title_terms array<string>, concepts array<string>, centroid array<double>, coherence double, last_seen timestamp_ntz"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], kind)
    for least in (0.78, 0.7):
        want = _folds(rows, lambda pdf: C._merged(pdf, least, 0.4, 0.5, 168))
        got = C.merge_clusters(df, least=least)
        assert {tuple(r) for r in got.collect()} == want and len(want) == len(rows) and len({(w, m) for w, _, m in want}) < len(rows)


def test_signal_merges_by_components_equal_folds_of_whole_workspaces(spark):
    rnd = random.Random(22)
    rows = []
    for w in range(1000):
        for i in range(rnd.randrange(2, 7)):
            at = dt.datetime(2024, 1, 1) + dt.timedelta(days=rnd.randrange(60))
            rows.append({
                "workspace": w, "signal": i, "doc_ids": sorted({rnd.randrange(30) for _ in range(rnd.randrange(0, 4))}), "semantic_cluster_ids": sorted({rnd.randrange(4) for _ in range(rnd.randrange(0, 3))}),
                "keywords": rnd.sample("klmnopq", rnd.randrange(0, 4)), "title_terms": rnd.sample("stuvwxyz", rnd.randrange(0, 4)), "score": rnd.random(), "first_seen": at, "last_seen": at,
            })
    kind = (
        "workspace long, signal long, doc_ids array<long>, semantic_cluster_ids array<long>, keywords array<string>, title_terms array<string>, score double, "
        "first_seen timestamp_ntz, last_seen timestamp_ntz"
    )
    df = spark.createDataFrame([tuple(r.values()) for r in rows], kind)
    whole = {tuple(r) for r in C.merge_signals(df, parts=False).collect()}
    assert {tuple(r) for r in C.merge_signals(df).collect()} == whole and len({(w, m) for w, _, m in whole}) < len(rows)


def test_merges_spread_over_components(spark):
    rows = [(1, i, [i], [f"t{i // 5}"], [f"c{i // 5}"], [1.0, 0.0], 0.5, dt.datetime(2024, 1, 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "workspace long, cluster long, doc_ids array<long>, title_terms array<string>, concepts array<string>, centroid array<double>, coherence double, last_seen timestamp_ntz")
    none = F.lit(False)
    assert C._sharing(df, "cluster", ["doc_ids", "title_terms", "concepts"], none, "part").select("part").distinct().count() == 40
    assert C.merge_clusters(df).select("merged").distinct().count() == 40


def test_window_changes(spark):
    rows = [(k, i, float(x)) for k, values in {"step": [1] * 10 + [9] * 10, "flat": [4] * 20, "short": [1, 9, 1], "spike": [0] * 8 + [50] + [0] * 8}.items() for i, x in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, window_start int, doc_count double")
    got = {(r.k, r.window_start): r.discrepancy for r in T.window_changes(df, ["k"], half=3, apart=2).collect()}
    assert got[("step", 10)] == 1.5 * 64 and {k for k, _ in got} <= {"step", "spike"}
    brute = {}
    for k in ("step", "flat", "short", "spike"):
        x = [v for key, _, v in rows if key == k]

        def error(a, b, x=x):
            part = x[a:b]
            return sum((v - sum(part) / len(part)) ** 2 for v in part)

        gains = {i: error(i - 3, i + 3) - error(i - 3, i) - error(i, i + 3) for i in range(3, len(x) - 2)}
        brute |= {(k, i): g for i, g in gains.items() if g > max(len(x) ** 0.5, 2) and all(g > gains[j] for j in range(i - 2, i + 3) if j != i and j in gains)}
    assert set(got) == set(brute) and all(got[k] == pytest.approx(v) for k, v in brute.items())


def test_album_frames_lose_nothing(spark):
    rnd = random.Random(3)
    rows = []
    for g in range(40):
        at = 0
        for _ in range(rnd.randrange(1, 60)):
            at += rnd.choice([1, 1, 1, 2, 9, 70])
            rows.append((at, g, "x"))
    rows += [(5, None, "alone"), (None, 3, "no id")]
    df = spark.createDataFrame(rows, "id long, group long, text string").repartition(4)
    got = sorted(tuple(r) for r in connectors.albums(df).collect())
    want = []
    for g in range(40):
        frames = []
        for x in sorted(i for i, h, _ in rows if h == g and i is not None):
            if not frames or len(frames[-1]) == 10 or x - frames[-1][0] > 48:
                frames.append([])
            frames[-1].append(x)
        want += [(g, k, f[0], f[-1], len(f)) for k, f in enumerate(frames)]
    assert got == sorted(want) and sum(r[4] for r in got) == len(rows) - 2


def test_cluster_job_continues_adds_and_ages(spark):
    t0 = dt.datetime(2024, 1, 1)

    def table(posts):
        rows = [(i, "w", v, t0 + dt.timedelta(hours=h), [term, "t"], [term]) for i, v, h, term in posts]
        df = spark.createDataFrame(rows, "post_id long, workspace string, vector array<double>, published_at timestamp_ntz, title_terms array<string>, concepts array<string>")
        return df.select("post_id", "workspace", "vector", "published_at"), df.select("post_id", "title_terms", "concepts")

    x, y, z, near = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [0.99, 0.14, 0.0]
    points, texts = table([(1, x, 0, "a"), (2, x, 5, "a"), (3, y, 1, "b"), (4, y, 2, "b"), (5, z, 3, "c")])
    stored = cluster_job.run(points, texts, None, F.lit(t0 + dt.timedelta(hours=9)), 0.9, 48)
    got = {r.cluster: (list(r.doc_ids), r.state, r.runs) for r in stored.collect()}
    assert got == {"c-w-1": ([1, 2], "active", 1), "c-w-3": ([3, 4], "active", 1), "c-w-5": ([5], "active", 1)}
    from tidemark.storage import materialize

    stored = materialize(stored, "test-stored")
    points, texts = table([(2, x, 5, "a"), (6, near, 40, "a"), (7, [0.0, 0.5, 0.5], 60, "d"), (4, y, 2, "b"), (8, y, 20, "b")])
    after = cluster_job.run(points, texts, stored, F.lit(t0 + dt.timedelta(hours=70)), 0.9, 48)
    rows = {r.cluster: r for r in after.collect()}
    assert {k: (list(r.doc_ids), r.state, r.runs) for k, r in rows.items()} == {
        "c-w-1": ([2, 6], "active", 2), "c-w-3": ([4, 8], "active", 2), "c-w-5": ([5], "cooling", 1), "c-w-7": ([7], "active", 1),
    }
    assert rows["c-w-1"].first_seen == t0 and rows["c-w-1"].last_seen == t0 + dt.timedelta(hours=40) and rows["c-w-1"].title_terms == ["a", "t"]
