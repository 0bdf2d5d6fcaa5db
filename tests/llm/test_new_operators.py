"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties, repeated rows and hot groups."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_operators import SCHEMA, texts
from tidemark.llm import collocations, infill, jaccard_groups

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute_components(rows):
    """(doc_id, n, component, links) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent, degree = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                degree[i] += 1
                degree[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted((repr(d), len(s), repr(least.get(root(i))), degree[i]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_texts():
    """Copies, near copies about the threshold, a hot group and a passage that many share."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    passage = " ".join(rnd.choice(words) for _ in range(30))
    out = [*texts(), "Aa bB", "aa bb", "aa", "aa bb cc", "AA BB CC", None, ""]
    for n in (9, 10, 11, 12, 21, 40, 100, 300):
        base = [rnd.choice(words) for _ in range(n)]
        out.append(" ".join(base))
        for edits in range(1, 1 + max(2, n // 12)):
            copy = base[:]
            copy[-edits:] = [f"e{rnd.random()}" for _ in range(edits)]
            out.append(" ".join(copy))
    base = [rnd.choice(words) for _ in range(80)]
    for i in range(150):
        copy = base[:]
        copy[i % 80] = f"h{i}"
        out.append(" ".join(copy))
    out += [passage + " " + " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 20))) for _ in range(60)]
    return out


def test_op11_equals_brute_force(spark, monkeypatch):
    rows = [(None if i % 17 == 3 else i * 7 - 50, t) for i, t in enumerate(near_texts())]
    rows += rows[20:24]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id), r.n_links) for r in jaccard_groups.similar_documents(df).collect())
    assert got == brute_components(rows)


def test_op11_groups_are_small_and_partition_the_sets(spark):
    rows = [(i, t) for i, t in enumerate(near_texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    counts = spark.sparkContext.broadcast(jaccard_groups.token_ranks(df))
    kinds = "doc_id bigint, th bigint, n bigint, s1 bigint, s2 bigint, m1 bigint, m2 bigint, end_rank bigint, end_token bigint, first array<bigint>, rest array<int>"
    sets = df.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(jaccard_groups._sets(counts, 90), kinds)
    groups = jaccard_groups.token_groups(sets).collect()
    members = [m for g in groups for m in g.members]
    assert len({m.node for m in members}) == len(members) == len({frozenset(shingles(t)) for _, t in rows} - {frozenset()})
    assert all(len(g.members) <= jaccard_groups.GROUP and g.gid == g.members[0].node for g in groups)
    assert max(len(g.members) for g in groups) > 1 and sum(m.copies for m in members) == sum(bool(shingles(t)) for _, t in rows)


def test_op11_bound_and_product():
    rnd = np.random.default_rng(3)
    for _ in range(30):
        pool = rnd.integers(0, 2**63, 60).astype(np.uint64)
        blocks = []
        for n in (5, 7):
            sets = [np.unique(np.append(pool[:40], rnd.choice(pool, rnd.integers(1, 12)))) for _ in range(n)]
            union, where = np.unique(np.concatenate(sets), return_inverse=True)
            bits = np.zeros((n, len(union)), bool)
            bits[np.repeat(np.arange(n), [len(s) for s in sets]), where] = True
            row = {"node": list(range(n)), "copies": [1] * n, "tokens": union.tobytes(), "bits": np.packbits(bits, axis=1).tobytes()}
            blocks.append((jaccard_groups.Block(row), sets))
        (a, left), (b, right) = blocks
        want = [[100 * len(np.intersect1d(x, y)) >= 90 * len(np.union1d(x, y)) for y in right] for x in left]
        linked = jaccard_groups.links(a, b)
        assert linked.tolist() == want
        edges = jaccard_groups.forest(linked, np.arange(5), np.arange(5, 12))
        parent = list(range(12))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in edges:
            assert linked[x, y - 5] and root(x) != root(y)  # a forest
            parent[root(x)] = root(y)
        assert all(root(i) == root(5 + j) for i in range(5) for j in range(7) if linked[i, j])


def brute_phrases(rows, least, within, top):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 6):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n, found = totals[lang], []
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        outer = collections.Counter()
        for p, a in frequent.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    outer[p[i : i + k]] = max(outer[p[i : i + k]], a)
        for p, a in frequent.items():
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if not (p in outer and 100 * outer[p] >= within * a):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


@pytest.fixture(scope="module")
def spoken():
    rnd = random.Random(2)
    words = ["the", "of", "and", "New", "york", "city", "in", "a", "b", "ß", "naïve", "long" * 40, "中文", "x\x00y", " ", "e-mail"]
    rows = [(rnd.choice(["en", "de", None, "und"]), " ".join(rnd.choice(words) + rnd.choice(["", "", "", "", ".", ",", "\n", "!"]) for _ in range(rnd.randrange(0, 120)))) for _ in range(120)]
    rows += [("en", "a very common line of words indeed"), ("fr", "a very common line, of words\tindeed")] * 60
    return [*rows, ("en", None), (None, ""), ("en", " .,; "), ("en", "the of " * 20_000)]


@pytest.mark.parametrize(("least", "within", "top"), [(5, 100, 50), (12, 80, 2000), (300, 100, 2000)])
def test_op12_equals_brute_force(spark, spoken, monkeypatch, least, within, top):
    monkeypatch.setattr(collocations, "SMALL", 64)
    df = spark.createDataFrame(spoken, "lang string, text string").repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(df, least, within, top).collect())
    assert got == brute_phrases(spoken, least, within, top)


def test_op12_a_shared_hash_starts_anew(spark, monkeypatch):
    df = spark.createDataFrame([("en", "one two three. one two three")] * 9, "lang string, text string")
    tried = []
    original = collocations._seeded
    monkeypatch.setattr(collocations, "_seeded", lambda d, seed, *more: tried.append(seed) or (None if seed < 2 else original(d, seed, *more)))
    assert [tuple(r)[2:4] for r in collocations.collocations(df, 9).collect()] == [("one two three", 18)] and tried == [0, 1, 2]


def test_op12_finds_words_that_share_a_hash(spark, monkeypatch):
    real = collocations.Words

    class Alike(real):
        def __init__(self, texts, langs, seed):
            super().__init__(texts, langs, seed)
            self.hashes[:] = 7  # but not the second ones

    monkeypatch.setattr(collocations, "Words", Alike)
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "en"], "text": ["one", "two one"]})
    words = next(collocations._counted(0, 9, 1 << 16)(iter([batch]))).to_pylist()
    assert sorted((x["h"], x["word"], x["n"]) for x in words) == [(7, "one", 2), (7, "two", 1)]
    monkeypatch.undo()
    clash = spark.createDataFrame([("en", 7, "one", 2, None), ("en", 7, "two", 1, None)], "lang string, h long, word string, n long, counts binary").select("lang", "h", "n", "word", "counts")
    monkeypatch.setattr(collocations, "materialize", lambda df, label: clash if label == "words" else df)
    assert collocations._seeded(spark.createDataFrame([("en", "x")], "lang string, text string"), 0, 9, 1 << 16) is None


def test_op12_a_task_sends_equal_suffixes_once(monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 64)

    class Bits:
        value = b"\xff" * 8  # every pair may be frequent

    def sent(texts):
        batches = (pa.RecordBatch.from_pydict({"lang": ["en"], "text": [t]}) for t in texts)
        return [tuple(r.values()) for b in collocations._suffixes(Bits, 0)(batches) for r in b.to_pylist()]

    rows = sent(["one two three four"] * 500)
    assert len(rows) == 3 and {r[-1] for r in rows} == {500}
    rows = sent([f"one two a{i} b{i}" for i in range(300)])  # mostly different ones don't stay
    assert sum(r[-1] for r in rows) == 900 and len(set(r[:-1] for r in rows)) == 900


def test_op12_sketch_of_large_input():
    # 50 GB of text have 12e9 pairs and triples or so; where counters meet least by chance alone, all pairs pass
    assert 12e9 / collocations._counters(50 << 30, 100) < 50
    assert collocations._counters(0, 100) == collocations.FEWEST and collocations._counters(800 << 20, 100) == 1 << 24
    assert 4 * collocations._counters(50 << 30, 300) == collocations._counters(50 << 30, 100) == collocations.MOST


def test_op12_rows_do_not_grow_with_the_splits_of_the_texts(spark, monkeypatch):
    made, tasks = {}, []
    real = collocations.materialize
    monkeypatch.setattr(collocations, "materialize", lambda df, label: made.setdefault(label, real(df, label)))
    monkeypatch.setattr(collocations, "_tasks", lambda size, cores: tasks.append((size, cores)) or 3)
    df = spark.createDataFrame([("en", "one two three four five six")] * 2000, "lang string, text string").repartition(40)
    monkeypatch.setattr(collocations, "discard", lambda df: None)
    found = collocations.phrases(df, 100)[0]
    assert found.count() == 14 and {r.a for r in found.collect()} == {2000}
    assert made["suffixes"].count() <= 3 * 5 and made["words"].filter("lang is not null").count() <= 3 * 6
    assert made["words"].filter("lang is null").count() <= 3 * collocations.SLICES
    assert tasks == [(2000 * 27, spark.sparkContext.defaultParallelism)]
    monkeypatch.undo()
    assert [collocations._tasks(size, 12) for size in (0, 12 << 30, (12 << 30) + 1)] == [12, 12, 13]


def test_op12_a_rare_pair_passes_only_if_both_its_counters_are_full():
    texts = [f"f{i} g{i}" for i in range(2000)] * 10 + [f"r{i} s{i}" for i in range(20_000)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(texts), "text": texts})
    halves = [batch.slice(0, len(texts) // 2), batch.slice(len(texts) // 2)]

    class Bits:
        value = b""

    sent = (b for half in halves for b in collocations._counted(0, 9, 1 << 15)(iter([half])))
    counters = [b.select(["h", "counts"]) for b in sent if b.column("lang").null_count]
    (bits,) = collocations._frequent(9)(iter(counters))
    Bits.value = b"".join(x for _, x in sorted(zip(*bits.to_pydict().values(), strict=True)))
    weights = collections.Counter(n for b in collocations._suffixes(Bits, 0)(iter(halves)) for n in b.column("n").to_pylist())
    assert weights[10] == 2000  # all that are frequent
    assert 0 < weights[1] < 600  # one counter of each: 1,200 or so


def test_op12_sort_counts_every_prefix(monkeypatch):
    monkeypatch.setattr(collocations, "SMALL", 16)
    rnd = np.random.default_rng(1)
    rows = rnd.integers(-2, 4, (5000, 4))
    rows[:, 0] = rnd.integers(0, 3, 5000)
    for i in range(1, 4):
        rows[(rows[:, i] == 0), i:] = 0
    weights = rnd.integers(1, 5, 5000)
    want = collections.Counter()
    for r, w in zip(rows.tolist(), weights.tolist(), strict=True):
        for d in range(1, 5):
            if d > 1 and r[d - 1] == 0:
                break
            want[tuple(r[:d])] += w
    ends = [min(map(tuple, rows.tolist())), max(map(tuple, rows.tolist()))]
    for least in (0, 40, 300):
        got = {}
        for d, at, sums in collocations.MultikeySort(rows, weights, least).parts():
            for i, s in zip(at.tolist(), sums.tolist(), strict=True):
                key = tuple(rows[i, :d].tolist())
                assert key not in got
                got[key] = s
        assert got == {k: v for k, v in want.items() if v >= least or any(e[: len(k)] == k for e in ends)}


def brute_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digits = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, m, b = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return (doc_id, n, "plain", None, None, text)
    if h[3] % 100 < 50:
        return (doc_id, n, "spm", len(a), len(m), f"<S>{b}<P>{a}<M>{m}")
    return (doc_id, n, "psm", len(a), len(m), f"<P>{a}<S>{b}<M>{m}")


def test_op13_equals_brute_force(spark):
    more = ["\n", "\n\n", "a\n", "a\nb", "<", "x <P", "a<P>b", "q" * 5000 + "<M>" + "z" * 5000, "<S" + "\n>" * 900, "é\n" * 9000, "a\r\nb c\n", "\n" * 40_000, "same line\n" * 3000]
    rnd = random.Random(4)
    long_text = "".join(rnd.choice("abé🙂 \n<PSM>") for _ in range(60_000))
    rows = [(i * 5 - 40, t) for i, t in enumerate([*texts(), *more, long_text.replace(">", ""), long_text[:200]])] + [(None, "no id\nhere"), (3, "x\ny"), (3, "x\ny")]
    got = infill.transform(spark.createDataFrame(rows, "doc_id long, text string"), cache=1 << 14).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(brute_infill(*r)) for r in rows)
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    for r in got:
        assert infill.restored(r.output.encode(), r.form).decode() in {t or "" for _, t in rows}


def test_op13_rates(spark):
    df = spark.range(400).selectExpr("id as doc_id", "concat('a\\n', id, '\\nb\\n') as text")
    forms = collections.Counter(r.form for r in infill.transform(df, rate=50, suffix_first=0).collect())
    assert set(forms) == {"plain", "psm"} and 140 < forms["psm"] < 260


def test_op13_marks_across_chunks_and_shared_chunks():
    rnd = random.Random(9)
    shared = "".join(rnd.choice("abcdefg \n") for _ in range(50_000)).encode()
    memo = infill.Memo()
    for head in (b"", b"other start\n", b"x" * 777):
        where = infill.Located(head + shared, memo)
        assert where.n == len(re.findall(rb"[^\n]*\n|[^\n]+", head + shared)) and not where.marked
    assert memo.hits > 20 and memo.bytes < 1.3 * len(shared)  # a passage is summarised once, wherever it stands
    for at in range(0, 3000, 7):
        text = shared[:at] + b"<S>" + shared[at:3000]
        assert infill.Located(text, memo).marked
    small = infill.Memo(4096)
    assert infill.Located(shared, small).n == infill.Located(shared, memo).n and small.bytes <= 4096
