"""The pipeline's stages and its whole run against simple versions of them."""

import collections

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import brute_simhash, brute_spans
from tests.oracle import check
from tidemark.llm import disclosure, queries
from tidemark.storage import materialize

SF = "/root/testdata/sf0.001"


def test_oracles(spark):
    for name, sql in queries.ORACLES.items():
        check(spark, queries.QUERIES[name], sql, SF)


def test_stages_keep_columns_and_clashing_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wide = docs.withColumn("score", F.lit("x")).withColumn("kept", F.lit("y")).withColumn("_bad", F.lit(1)).withColumn("spans", F.lit(2))
    narrow = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        wide, narrow = (materialize(stage(spark, x, SF), name) for x in (wide, narrow))
        assert narrow.columns == docs.columns
        assert sorted(map(repr, wide.select(docs.columns).collect())) == sorted(map(repr, narrow.collect()))


def test_run_equals_brute_force(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    rows = [(r.doc_id, r.text, r.source) for r in docs if any(map(str.isalpha, r.text))]
    pages, counts = collections.defaultdict(set), collections.Counter()
    for _, t, s in rows:
        if t not in pages[s]:
            pages[s].add(t)
            counts.update((s, x) for x in set(t.split("\n")) if x.strip(" "))
    bad = {k for k, n in counts.items() if n >= 5 and n > 0.1 * len(pages[k[0]])}
    rows = [(i, "\n".join(x for x in t.split("\n") if (s, x) not in bad)) for i, t, s in rows]
    fps, parent = [brute_simhash(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    rows = [r for i, r in enumerate(rows) if root(i) == i]
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r.start):
        pieces[r.doc_id].append(r.ids)
    plain = 0
    for i, t in rows:
        spans = [{"start": s, "kind": k, "end": e} for s, k, e in brute_spans(t)]
        ids = np.array([*tok.encode(disclosure.replaced(t, spans), add_special_tokens=False).ids, 1], "<u4").tobytes()
        plain += b"".join(pieces[i]) == ids
    assert plain >= 0.97 * len(rows)  # the rest lost disclosing terms as well


def test_stages_of_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    learn = [(1000 + i, " ".join(f"{w}{k}" for k in range(9)), lang, "s", 50) for i in range(40) for w, lang in ((f"the{i}and", "en"), (f"größe{i}ü", "de"))]
    odd = [(None, "the words and these other words of them", None, None, 0), (None, "the words and these other words of them", None, None, 0), (None, "and some other text of the kind", "en", None, 1)]
    odd += [(5, None, "en", "s", 0), (5, "", "en", "s", 0), (6, " \n ", None, None, 3), (7, "12 34", "en", "s", 5)]
    odd += [(8, "the one and the other thing is the same", "en", "t", 1), (8, "größe und über der straße", "de", "t", 1), (9, "the long " * 30_000, "en", "t", 1)]
    docs = spark.createDataFrame([*learn, *odd], schema)
    kept = materialize(corpus_pipeline.language_id(spark, docs, SF), "a")
    rows = [tuple(r) for r in kept.collect() if r.doc_id is None or r.doc_id < 1000]
    assert sorted((r[0] or 0, len(r[1])) for r in rows) == sorted((r[0] or 0, len(r[1])) for r in odd if r[1] and any(map(str.isalpha, r[1])))
    assert {r[2] for r in rows} <= {"en", "de"}  # a null one became the predicted one
    texts = materialize(docs.unionByName(docs.filter("doc_id = 8")), "b")
    lined = materialize(corpus_pipeline.line_dedup(spark, texts, SF), "c")
    assert lined.count() == texts.count() and lined.filter("text is null").count() == 1
    one = materialize(corpus_pipeline.near_dedup(spark, texts, SF), "d")
    found = [(r.doc_id, r.text) for r in one.filter("doc_id is null or doc_id < 1000").collect()]
    assert found.count((None, odd[0][1])) == 1 and (None, odd[2][1]) in found and {t for i, t in found if i == 8} == {odd[7][1], odd[8][1]} and len([1 for i, _ in found if i == 8]) == 2
    assert sum(t is None or not t.strip() for _, t in found) == 1
    clean = corpus_pipeline.personal_data(spark, texts.withColumn("a.b", F.lit(1)), SF)
    assert clean.columns == [*docs.columns, "a.b"] and sorted(map(repr, clean.drop("`a.b`").select("doc_id").collect())) == sorted(map(repr, texts.select("doc_id").collect()))
    assert clean.filter("text is null").count() == 1 and clean.filter("text = ''").count() == 1
    packed = corpus_pipeline.sequences(spark, texts, SF)
    assert packed.filter("start = 0").count() == texts.count() and packed.filter("doc_tokens = 1").count() == 3
    again = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        again = stage(spark, again, SF)
        assert again.count() == 0
