"""Operator 3: language ID by multinomial naive Bayes over hashed character n-grams.

Fitting adds up n-gram counts inside each task and once more in a grouping by language and bucket; only the
matrix, of 64 KB for each language there is, reaches the driver, a language at a time, and is broadcast. Scoring
hashes a batch of texts to one array of buckets and sums the looked-up rows of the matrix for each text.

Defined results: texts that are null or have no letter are ``und`` with score 0; with no labelled rows every
text is ``und``; ties go to the language that sorts first. The score is the posterior of the predicted
language for a text of at most ``EVIDENCE`` n-grams: log-likelihoods of longer texts are scaled down to
that many, else every score would round to 1. A text of any length is read whole; repeated rows count each time;
every language with a labelled text is learned; other columns are kept or not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidemark.llm.words import slices

BITS = 14
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
EVIDENCE = 60
#: Languages whose counts a task holds at once (128 KB each).
HELD = 64
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_SEED = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def held_out(doc_id: Column) -> Column:
    """True for the rows that fitting must not see."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_LETTER.search(text)) and any(map(str.isalpha, text)))


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the lower-cased texts joined together, and how many each text has.

    Each text is put between blanks; an n-gram begins at each of its characters."""
    padded = [f" {t.lower()}  " for t in texts]
    lengths = np.array([len(t) for t in padded], np.int64)
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    n, ends = len(codes), np.cumsum(lengths)
    out = np.empty((n, len(ORDERS)), np.uint32)
    value = np.zeros(n, np.uint32)
    for i, order in enumerate(ORDERS):
        shifted = np.zeros(n, np.uint32)
        shifted[: n - i] = codes[i:]
        for j in range(i):
            shifted[ends - 1 - j] = 0  # an n-gram ends with its text, whatever comes next
        value = (value + shifted) * np.uint32(_SEED[i])
        value ^= value >> np.uint32(15)
        out[:, i] = (value * np.uint32(0x27D4EB2F) + np.uint32(order)) >> np.uint32(32 - BITS)
    return out.reshape(-1), lengths * len(ORDERS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        rows = [(lang, np.flatnonzero(total)) for lang, total in held.items()]
        counts = [held[lang][at] for lang, at in rows]
        langs = pa.array([lang for lang, at in rows for _ in range(len(at))], pa.string())
        bucket, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([at for _, at in rows], counts))
        held.clear()
        return pa.RecordBatch.from_arrays([langs, pa.array(bucket.astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "b", "n"])

    for b in slices(batches, 512):
        texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
        for lang in set(langs):
            found, _ = buckets([t for t, x in zip(texts, langs, strict=True) if x == lang])
            if lang not in held and len(held) >= HELD:
                yield out()
            held[lang] = held.get(lang, 0) + np.bincount(found, minlength=1 << BITS)
    yield out()


@dataclass
class LanguageModel:
    languages: list[str]
    log_probability: np.ndarray  # a row for each bucket, a column for each language
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        usable = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        if not usable:
            return out
        found, sizes = buckets([texts[i] for i in usable])
        begins = np.cumsum(sizes) - sizes
        total = np.stack(
            [np.add.reduceat(self.log_probability[:, j].take(found), begins, dtype=np.float64) for j in range(len(self.languages))], axis=1
        )
        best = (total + self.prior).argmax(axis=1)
        scaled = total * np.minimum(1.0, EVIDENCE / sizes)[:, None] + self.prior
        odds = np.exp(scaled - scaled.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        for row, i in enumerate(usable):
            out[i] = (self.languages[best[row]], float(odds[row, best[row]]))
        return out


def fit(labelled: DataFrame) -> LanguageModel:
    """Learn from all rows of ``labelled(text, lang)`` that have both."""
    rows = labelled.select("text", "lang").filter("text is not null and lang is not null")
    sizes = sorted((r["lang"], r["count"]) for r in rows.groupBy("lang").count().collect())
    languages = [x for x, _ in sizes]
    place = {x: i for i, x in enumerate(languages)}
    logs = np.zeros((1 << BITS, len(languages)), np.float32)
    if languages:
        sums = rows.mapInArrow(_count, "lang string, b int, n bigint").groupBy("lang", "b").agg(F.sum("n").alias("n"))
        lists = sums.groupBy("lang").agg(F.collect_list("b").alias("b"), F.collect_list("n").alias("n"))  # of BITS bits at most
        for r in lists.toLocalIterator():
            column = np.full(1 << BITS, SMOOTHING)
            column[r["b"]] += r["n"]
            logs[:, place[r["lang"]]] = np.log(column / column.sum())
    prior = np.log(np.array([n for _, n in sizes], float) / max(1, sum(n for _, n in sizes)))
    return LanguageModel(languages, logs, prior)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``; only the text is used."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.languages, np.ascontiguousarray(model.log_probability), model.prior)
    )
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = LanguageModel(*shared.value)
        for b in slices(batches, 128):
            found = local.predict(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                [*names, "lang_pred", "score"],
            )

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out and predict all: ``(doc_id, held_out, lang_pred, score)``."""
    fold = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    model = fit(docs.filter(~fold))
    return predict(docs.select("doc_id", fold.alias("held_out"), "text"), model).drop("text")
