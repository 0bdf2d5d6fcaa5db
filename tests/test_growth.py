"""Jobs whose cost may grow no faster than their input, on many keys, large groups and odd rows."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from tidemark.functions import batches, html as H, selectors, vectors
from tidemark.operators import clusters
from tidemark.plans import clustering
from tidemark.sources import connectors
from tidemark.streaming import jobs, state


def _stream(spark, path, batches, kind):
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)


def test_sends_of_many_keys_share_calls(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "BUCKETS", 3)  # a call for each of 300 keys before
    rnd, t0 = random.Random(5), dt.datetime(2024, 1, 1)
    keys = [(u, k) for u in (*range(99), None) for k in ("a", 'b"', None)]
    rows = [(*rnd.choice(keys), i, t0 + dt.timedelta(minutes=rnd.randrange(400)) + dt.timedelta(days=2 * (i // 700))) for i in range(2100)]
    kind = "u long, k string, id long, ts timestamp"
    s = _stream(spark, str(tmp_path / "in"), [rows[:700], rows[700:1400], rows[1400:]], kind)
    with state.rocksdb(spark):
        sent = state.send_once(s, ["u", "k"], "ts", "id", 3600, lambda r: r.id % 5 != 0, "1 day")
        plan = sent._jdf.queryExecution().analyzed().toString()
        got = {r.id: r.outcome for r in jobs.drain(sent, "many").collect()}
    want, until = {}, {}
    for u, k, i, at in sorted(rows, key=lambda r: (r[2] // 700, r[3], r[2])):
        if (u, k) in until and at < until[u, k]:
            want[i] = "held"
        else:
            want[i] = "failed" if i % 5 == 0 else "sent"
            if i % 5:
                until[u, k] = at + dt.timedelta(hours=1)
    assert got == want and set(want.values()) == {"held", "failed", "sent"}
    assert "mark_bucket" in plan


def test_first_rows_of_many_keys_need_no_call_each(spark, tmp_path):
    first = [(i % 900 if i % 900 else None, str(i % 2), 5000 - i, i) for i in range(3000)] + [(1000, "z", None, 1), (1001, "z", None, 2), (1001, "z", 7, 3)]
    again = [(i, "0", 0, 9) for i in range(905)] + [(1000, "z", 1, 4), (None, "0", 1, 5)]
    s = _stream(spark, str(tmp_path / "in"), [first, again], "u long, k string, at long, v long")
    with state.rocksdb(spark):
        found = state.first_for_good(s, ["u", "k"], "at")
        plan = found._jdf.queryExecution().analyzed().toString()
        got = sorted(map(repr, jobs.drain(found, "firsts").collect()))
    best = {}
    for batch in (first, again):
        own = {}
        for row in batch:
            if row[:2] not in own or (row[2] is not None and (own[row[:2]][2] is None or row[2] < own[row[:2]][2])):
                own[row[:2]] = row
        best = own | best
    assert got == sorted(f"Row(u={u}, k={k!r}, at={at}, v={v})" for u, k, at, v in best.values())
    assert "TransformWithState" not in plan  # a call of Python for each key before


def test_centroids_in_parts(spark):
    rnd = random.Random(7)
    rows = [(i % 5 if i % 7 else None, [rnd.choice((None, 1.5, -2.0, rnd.random())) for _ in range(rnd.choice((0, 1, 15, 16, 17, 40)))]) for i in range(60)]
    rows += [(8, None), (9, []), (10, [None]), (11, [None] * 16 + [3.0])]
    found = vectors.centroids(spark.createDataFrame(rows, "k long, v array<double>"), ["k"], "v")
    got = {r.k: r.centroid for r in found.collect()}
    want = {}
    for key in {k for k, v in rows if v}:
        of = [v for k, v in rows if k == key and v]
        columns = [[v[j] for v in of if len(v) > j and v[j] is not None] for j in range(max(map(len, of)))]
        want[key] = [sum(c) / len(c) if c else None for c in columns]
    assert set(got) == set(want)
    for k in want:
        assert len(got[k]) == len(want[k])
        assert all(a is b if b is None else abs(a - b) < 1e-12 for a, b in zip(got[k], want[k], strict=True))
    assert "posexplode(transform(" in found._jdf.queryExecution().optimizedPlan().toString()  # a row for each place before


def test_overlaps_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 7)
    monkeypatch.setattr(clusters, "WIDTH", 4)
    rnd = random.Random(11)
    rows = [(f"k{i}", rnd.choice(("x", "y", None)), [t for t in "abcdefghijklmn" if rnd.random() < 0.15]) for i in range(90)] + [("k9z", "x", None), ("only", "z", ["a"])]
    rows += [(f"c{i}", "copies", ["a", "b"]) for i in range(30)]
    found = clusters.overlaps(spark.createDataFrame(rows, "k string, g string, t array<string>"), "k", "g", "t")
    got = sorted(map(tuple, found.collect()))
    want = [
        (a[0], b[0], n, len(a[2]), len(b[2]))
        for a in rows for b in rows if a[0] < b[0] and a[1] and a[1] == b[1] and (n := len(set(a[2] or ()) & set(b[2] or ())))
    ]
    assert got == sorted(want) and len(want) > 600


def _merges(rows, least):
    """Every signal of a workspace held against all that were kept before it."""
    out = []
    for w in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == w), key=lambda r: (-r[6], r[1])):
            docs, sem, words, title = (set(r[k] or ()) for k in (2, 3, 4, 5))
            for k in kept:
                doc = len(docs & k[1]) / max(len(docs | k[1]), 1)
                s, kw, t = (len(a & b) / len(a | b) if a | b else 1.0 for a, b in ((sem, k[2]), (words, k[3]), (title, k[4])))
                time = 0.0
                if None not in (*r[7:], *k[5]):
                    gap = abs((max(r[7], k[5][0]) - min(r[8], k[5][1])).total_seconds()) / 3600
                    time = 1.0 if gap <= 720 else max(0.0, 1 - gap / 720)
                if doc >= 0.25 or 0.28 * doc + 0.22 * s + 0.24 * kw + 0.16 * t + 0.10 * time >= least or (kw >= 0.6 and t >= 0.45 and time >= 0.4):
                    k[1].update(docs)
                    k[2].update(sem)
                    break
            else:
                kept.append(k := (r[1], docs, sem, words, title, r[7:]))
            out.append((w, r[1], k[0]))
    return out


def test_signals_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(clusters, "PROFILES", 9)
    monkeypatch.setattr(clusters, "SLICE", 4)
    rnd = random.Random(17)

    def some(values, most):
        return rnd.choice((None, [])) if rnd.random() < 0.05 else rnd.sample(values, rnd.randrange(1, most))

    rows = []
    for i in range(420):
        at = rnd.choice((None, *[dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randrange(2500)) for _ in range(9)]))
        common = i % 4 == 3  # a workspace with one keyword, and a term that all titles have
        words, title = (["k"], ["the", *rnd.sample("abcdefghijklmnop", 4)]) if common else (some([*"klmn", None], 4), some("abcdefgh", 5))
        rows.append((i % 4 if i % 4 else None, i, some([*range(300), None], 5), some(range(4), 3), words, title, rnd.random(), at, at and at + dt.timedelta(hours=rnd.randrange(300))))
    rows += [(9, i, [i], [1], ["k"], ["copy"], 0.5, None, None) for i in range(30)] + [(9, 40, [3], [1], ["k"], ["copy"], 0.9, None, None)]
    kind = "workspace long, signal long, doc_ids array<long>, semantic_cluster_ids array<long>, keywords array<string>, title_terms array<string>, score double, first_seen timestamp_ntz, last_seen timestamp_ntz"
    df = spark.createDataFrame(rows, kind)
    for least in (0.72, 0.58):
        found = clusters.merge_signals(df, least=least)
        want = _merges(rows, least)
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want)) and sum(s != m for _, s, m in want) > 50
        assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()  # all of a workspace in one call before


def test_a_common_term_needs_no_comparison(monkeypatch):
    rnd, calls, temporal = random.Random(19), [], clusters._temporal
    monkeypatch.setattr(clusters, "_temporal", lambda *x: calls.append(x) or temporal(*x))
    fold = clusters._Fold(0.72, 0.25, 720)
    terms = [f"t{i}" for i in range(3000)]
    rows = [(0, i, [i, 9000 + i % 40] if i % 50 == 0 else [i], [], ["k"], ["the", *rnd.sample(terms, 9)], 1 - i / 1000, None, None) for i in range(900)]
    rows += [(0, 1000 + i, [2000 + i], [], ["k"], rows[i][5][: 6 + i % 5], 0.0, None, None) for i in range(90)]
    got = [(0, r[1], fold.into({"signal": r[1], "docs": set(r[2]), "semantic": set(r[3]), "words": set(r[4]), "title": set(r[5]), "first": None, "last": None})) for r in rows]
    assert got == _merges(rows, 0.72) and any(s != m for _, s, m in got)
    assert len(calls) < 2000  # about 400,000 pairs


def test_titles_of_clusters_shuffle_no_whole_texts(spark, tmp_path):
    texts = [(i, f"Title{i} of the {'word' * (i % 60)} b{i} " + "and more text " * 40, "en", f"s{i % 3}" if i % 7 else None, 600) for i in range(400)] + [(400, None, "en", "s0", 0)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = clustering._clusters(spark, str(tmp_path), 100)
    got = {r.cluster: (r.doc_ids, r.title_terms) for r in found.collect()}
    want = {}
    for i, text, _, source, _ in texts:
        if source:
            own = want.setdefault(f"{source}-{i // 100}", ([], list(dict.fromkeys(re.findall(r"[a-z0-9][a-z0-9\-_]{2,}", text[:180].lower()))) if text else None))
            own[0].append(i)
    assert got == want
    assert "substring(text" in found._jdf.queryExecution().optimizedPlan().toString().split("LeftOuter")[-1]  # above the join with labels before


def test_frames_of_many_groups_in_one_batch(spark):
    rnd = random.Random(13)
    rows = [(f"g{rnd.randrange(400)}", rnd.randrange(300)) for _ in range(3000)] + [("copies", 5)] * 13 + [("long", i) for i in range(25_000)] + [("gaps", i * 49) for i in range(9)] + [(None, 1), ("g1", None)]
    found = connectors.albums(spark.createDataFrame(rows, "`group` string, id long").withColumn("text", F.lit("")), span=48, most=6)
    got = sorted(map(tuple, found.collect()))
    want = []
    for g in {g for g, _ in rows if g}:
        frames = []
        for x in sorted(i for h, i in rows if h == g and i is not None):
            if not frames or len(frames[-1]) == 6 or x - frames[-1][0] > 48:
                frames.append([])
            frames[-1].append(x)
        want += [(g, k, f[0], f[-1], len(f)) for k, f in enumerate(frames)]
    assert got == sorted(want)
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()  # a call of Python for each island before


def test_pages_become_objects_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(batches, "ROWS", 3)
    pages = [f"<title>t{i}</title><h1>H{i}</h1><p>p{i} <a href='https://x.org/{i}'>l</a></p><ul><li><a href='/{i}'>m</a></li></ul>" for i in range(20)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(pages)), "id long, html string").coalesce(1)
    columns = {"markdown": H.markdown_column, "text": H.text_column, "meta": H.meta_column, "links": H.links_column}
    found = df.select("id", *[make(F.col("html")).alias(name) for name, make in columns.items()], selectors.listed_column(F.col("html"), "li", "a").alias("items"), selectors.texts_column(F.col("html"), "h1").alias("heads"))
    got = {r.id: r for r in found.collect()}
    for i, page in enumerate(pages):
        assert got[i].markdown == H.markdown_of(page) and got[i].links == H.links_of(page) and got[i].text.asDict() == H.text_of(page)
        assert got[i].meta.asDict() == H.meta_of(page) and [x.asDict() for x in got[i]["items"]] == selectors.listed(page, "li", "a") and got[i].heads == ([f"H{i}"] if page else [])


def test_pieces_are_encoded_once_and_given_up(monkeypatch):
    import public_tokenizers

    from tidemark.llm import byte_bpe

    bpe = byte_bpe.coder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    asked: list[str] = []

    class Counted:
        def encode_batch_fast(self, pieces, **options):
            asked.extend(pieces)
            return own.encode_batch_fast(pieces, **options)

    own = bpe.one_piece
    monkeypatch.setattr(bpe, "one_piece", Counted())
    monkeypatch.setattr(bpe, "known", {})
    monkeypatch.setattr(byte_bpe, "PIECES", 40)
    rnd = random.Random(3)
    parts = ["it's", " '", "''s", " ", "  ", "\n", "\x1c", "\x85", "12", "½", "Жизнь", "á", "😀", "՘", "\U0001df20", "\U000107bb", "͸", "x" * 90, "abc", "?!"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(200)] + ["", "a " * 5000]
    whole = [x.ids for x in bpe.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    for size in (1, 7, 202):
        got = [x.tolist() for i in range(0, len(texts), size) for x in bpe.encode(texts[i : i + size])]
        assert got == whole and len(bpe.known) <= 40 and max(map(len, bpe.known), default=0) <= byte_bpe.LONGEST
    asked.clear()
    bpe.encode(["word " * 3000])
    assert asked.count(" word") <= 1  # each of 3,000 before
