"""Operator 2: removal of repeated passages by a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words of one document. Each window is known by its fingerprint, the
smallest hash among its ``GRAM``-word grams; equal windows have equal fingerprints at the same place, and
neighbouring windows mostly share theirs, so about one word in nine carries one. The index keeps sorted
immutable runs of fingerprints. A new batch's fingerprints are merge-joined with the runs and with each
other; those seen before are candidates, new ones become the next run, and runs are compacted by size: a run
that isn't twice as large as the next newer one is merged with it, so each fingerprint is rewritten a
logarithmic number of times.

Candidates are verified on all of their words. A stretch is what the windows of one fingerprint
cover; a stretch whose digest occurs earlier is removed as a whole, and the first
stretches of a fingerprint that has several are compared window by window. Both digests are 128 bits of BLAKE2b
over the bytes of all words, so equal hashes of different words never count. No pairs are made: every step is a
grouping with partial sums, or a join with one row per key on one side that adaptive execution can split.

Defined results: null text has no words; documents with fewer than ``WINDOW`` words keep all; a text of any length
is read whole; rows that repeat a doc_id are separate documents, in the order of a hash of their texts, each a document of its own
wherever texts are gathered; rows that agree in id and text are stored once, and all but the first lose every word of a window; rows without a
doc_id come first (among ids within 2^40 of the least there is), in the order of such a hash; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.words import rolling, slices, window_argmin, word_hashes
from tidemark.storage import discard, drop, materialize, named_table

WINDOW = 20
GRAM = 4
#: Shares of the documents, by doc_id, that the query adds to the index as its first batches.
BATCHES = (0.125, 0.25)
#: A run is merged with the next newer one unless it is so many times as large.
TIER = 2

#: Rows without a doc_id get keys from here on, by 40 bits of a hash of the text.
_NULL_ID = -(2**63)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for b in batches:
        texts = b.column("text").cast(pa.binary())
        blobs = [None if x is None else pack.compress(x) for x in texts.to_pylist()]
        yield pa.RecordBatch.from_arrays([*[b.column(x) for x in ("k", "c", "doc_id")], pa.array(blobs, pa.binary())], ["k", "c", "doc_id", "blob"])


def _texts(column: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return [b"" if x is None else unpack.decompress(x) for x in column.to_pylist()]


def stored_documents(docs: DataFrame) -> tuple[DataFrame, str]:
    """``(k, c, doc_id, blob, m)`` and the table's name: compressed texts in a table of the shared folder, bucketed by ``k``, which is the
    doc_id or stands for it, and ``c``, a hash of the text where texts share their ``k`` (else 0). So later steps move lists of positions
    to the texts and never the texts again. Rows that agree in both are one, and ``m`` is how many they are."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    k = F.coalesce("doc_id", F.lit(_NULL_ID) + F.shiftrightunsigned(F.xxhash64("text"), 24))
    keyed = docs.select(k.alias("k"), F.xxhash64("text", F.col("doc_id").isNull()).alias("c"), "doc_id", "text")
    several = keyed.groupBy("k").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a <> b").select("k", F.lit(True).alias("several"))
    several = materialize(several, "several-texts")
    marked = keyed.join(several, "k", "left").withColumn("c", F.when(F.col("several"), F.col("c")).otherwise(F.lit(0).cast("bigint")))
    packed = marked.select("k", "c", "doc_id", "text").mapInArrow(_packed, "k bigint, c bigint, doc_id bigint, blob binary")
    one = packed.groupBy("k", "c").agg(F.first("doc_id").alias("doc_id"), F.first("blob").alias("blob"), F.count("*").alias("m"))
    name, path = named_table(spark, "texts")
    one.write.bucketBy(n, "k", "c").option("path", path).saveAsTable(name, format="parquet")
    discard(several)
    spark._jvm.System.gc()  # the shuffle files of the write go
    return spark.table(name), name


def _digests(texts: list[bytes], doc: np.ndarray, first: np.ndarray, last: np.ndarray, shape: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of a digest of the words from ``first`` up to ``last`` of each document in ``doc`` (ascending),
    and of one byte each from the columns of ``shape``."""
    out = np.empty((len(doc), 2), np.int64)
    edges = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else doc
    for low, high in zip(edges.tolist(), [*edges[1:].tolist(), len(doc)], strict=False):
        words = texts[doc[low]].split()
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        begins = np.append(0, ends)[first[low:high]].tolist()
        stops = ends[last[low:high] - 1].tolist()
        line = memoryview(b" ".join([*words, b""]))
        digest = hashlib.blake2b
        if shape is None:
            found = [digest(line[a:b], digest_size=16).digest() for a, b in zip(begins, stops, strict=True)]
        else:
            tags = np.ascontiguousarray(shape[low:high], np.uint8)
            found = [digest(line[a:b], digest_size=16, salt=t).digest() for a, b, t in zip(begins, stops, map(bytes, tags), strict=True)]
        out[low:high] = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def _anchors(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of joined documents: the hash of each fingerprint, its document, its place and the first and last
    start of the windows that have it; places count from the start of all."""
    starts = np.cumsum(lengths) - lengths
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)
    grams = rolling(hashes, GRAM)
    ends = np.repeat(starts + lengths, lengths)[:n]
    s = np.flatnonzero(np.arange(n) + WINDOW <= ends)
    place = window_argmin(grams, WINDOW - GRAM + 1)[s]
    new = np.ones(len(s), bool)
    new[1:] = (place[1:] != place[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    at = place[first]
    return grams[at], np.searchsorted(starts + lengths, at, side="right"), at, s[first], s[last] if len(s) else s


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        hashes, lengths = word_hashes(_texts(b.column("blob")))
        h, doc, at, _, _ = _anchors(hashes, lengths)
        starts = np.cumsum(lengths) - lengths
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(h.view(np.int64)),
                pa.array(b.column("k").to_numpy()[doc]),
                pa.array(b.column("c").to_numpy()[doc]),
                pa.array((at - starts[doc]).astype(np.int32)),
            ],
            ["h", "k", "c", "at"],
        )


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        texts = _texts(b.column("blob"))
        hashes, lengths = word_hashes(texts)
        h, doc, at, first, last = _anchors(hashes, lengths)
        starts = np.cumsum(lengths) - lengths
        asked = b.column("at")
        wanted = starts[np.repeat(np.arange(len(lengths)), asked.value_lengths().to_numpy())] + asked.flatten().to_numpy()
        keep = np.isin(at, wanted)
        h, doc, at, first, last = h[keep], doc[keep], at[keep], first[keep], last[keep]
        n = last - first + 1
        begin = first - starts[doc]
        d, d2 = _digests(texts, doc, begin, begin + n + WINDOW - 1, np.column_stack([n, at - first]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(h.view(np.int64)),
                pa.array(d),
                pa.array(d2),
                pa.array(b.column("k").to_numpy()[doc]),
                pa.array(b.column("c").to_numpy()[doc]),
                pa.array(begin.astype(np.int32)),
                pa.array(n.astype(np.int32)),
            ],
            ["h", "d", "d2", "k", "c", "start", "n"],
        )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 64):
        texts = _texts(b.column("blob"))
        asked = b.column("asked")
        doc = np.repeat(np.arange(len(texts)), asked.value_lengths().to_numpy())
        part = asked.flatten()
        start, n = (part.field(i).to_numpy() for i in range(2))
        n = n.astype(np.int64)
        each = np.repeat(np.arange(len(n)), n)
        local = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        doc = doc[each]
        d, d2 = _digests(texts, doc, local, local + WINDOW)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(d),
                pa.array(d2),
                pa.array(b.column("k").to_numpy()[doc]),
                pa.array(b.column("c").to_numpy()[doc]),
                pa.array(local.astype(np.int32)),
            ],
            ["d", "d2", "k", "c", "start"],
        )


#: Copies of a row that are sent at once.
_ROWS = 4096


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        out = []
        for doc_id, m, text, spans in zip(b.column("doc_id").to_pylist(), b.column("m").to_pylist(), _texts(b.column("blob")), b.column("removed").to_pylist(), strict=True):
            words = kept = text.split()
            if spans:
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, [x["start"] for x in spans], 1)
                np.add.at(change, [x["start"] + x["n"] + WINDOW - 1 for x in spans], -1)
                kept = list(compress(words, (np.cumsum(change)[:-1] == 0).tolist()))
            out.append(_result(doc_id, words, kept))
            if m > 1:  # each window of the others starts earlier, in the first
                again = _result(doc_id, words, words if len(words) < WINDOW else [])
                for low in range(0, m - 1, _ROWS):
                    yield _results([*out, *[again] * min(_ROWS, m - 1 - low)])
                    out = []
        if out:
            yield _results(out)


def _result(doc_id: int | None, words: list[bytes], kept: list[bytes]) -> tuple:
    joined = b" ".join(kept)
    return doc_id, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()


def _results(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], list(kinds))


class FingerprintIndex:
    """Sorted immutable runs of fingerprints; ``add`` gives those of a batch that were seen before."""

    def __init__(self, tier: float = TIER) -> None:
        self.runs: list[tuple[DataFrame, int]] = []  # oldest first, with their sizes
        self.tier = tier

    def add(self, batch: DataFrame) -> DataFrame:
        """Join a batch's fingerprints ``(h, ...)`` with the runs; return the repeated ones as ``(h)``."""
        counts = batch.groupBy("h").agg(F.count("*").alias("n"))
        if self.runs:
            known = self.history().withColumn("known", F.lit(True))
            found = counts.join(known.hint("merge"), "h", "left").withColumn("known", F.coalesce("known", F.lit(False)))
        else:
            found = counts.withColumn("known", F.lit(False))
        found = materialize(found, "matched")
        self._keep(found.filter("not known").select("h").sortWithinPartitions("h"), "run")
        seen = materialize(found.filter("known or n > 1").select("h"), "seen")
        discard(found)
        return seen

    def _keep(self, run: DataFrame, label: str) -> None:
        kept = materialize(run, label)
        self.runs.append((kept, kept.count()))

    def history(self) -> DataFrame:
        """All fingerprints so far; a fingerprint is in one run only."""
        out = self.runs[0][0]
        for run, _ in self.runs[1:]:
            out = out.unionByName(run)
        return out

    def compact(self) -> None:
        """Merge the newest two runs into one sorted run as long as their sizes are near."""
        while len(self.runs) > 1 and self.runs[-2][1] < self.tier * self.runs[-1][1]:
            (older, _), (newer, _) = self.runs[-2:]
            del self.runs[-2:]
            self._keep(older.unionByName(newer).repartition(F.col("h")).sortWithinPartitions("h"), "compacted")
            discard(older)
            discard(newer)

    def discard(self) -> None:
        for run, _ in self.runs:
            discard(run)


#: Where a window starts: documents come in the order of the first two.
_PLACE = ("k", "c", "start")


def _first(rows: DataFrame, *more: str) -> DataFrame:
    """The earliest row of each digest."""
    return materialize(rows.groupBy("d", "d2").agg(F.min(F.struct(*_PLACE, *more)).alias("first")), "first")


def _later(rows: DataFrame, firsts: DataFrame, n: Column) -> DataFrame:
    """``(k, c, start, n)`` of the rows that are not the earliest of their digest."""
    one = firsts.select("d", "d2", *[F.col(f"first.{x}").alias(f"_{x}") for x in _PLACE])
    return rows.join(one, ["d", "d2"]).filter("not (k = _k and c = _c and start = _start)").select(*_PLACE, n.cast("int").alias("n"))


def _beside(texts: DataFrame, rows: DataFrame, name: str, fields: list[str], how: str = "inner") -> DataFrame:
    """Texts with the values of their document as a list, as long as the document at most. Rows move before
    they are gathered: lists of a part of a document would take more room on the way than its rows.
    The join is by what the texts are bucketed by, so they stay where they are."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.col(fields[0]) if len(fields) == 1 else F.struct(*fields)
    lists = rows.repartition(n, "k", "c").groupBy("k", "c").agg(F.collect_list(value).alias(name))
    return texts.join(lists, ["k", "c"], how)


def remove_repeats(docs: DataFrame, batches: tuple[float, ...] = BATCHES, texts_too: bool = True) -> DataFrame:
    """Remove each word covered by a window whose word sequence also starts earlier.

    Returns ``(doc_id, n_words, n_removed, kept_sha256, kept)`` for each row of ``docs(doc_id, text)``.
    ``batches`` are the shares of the documents, by doc_id, that earlier additions to the index hold.
    The result reads the stored texts until ``storage.clear``; without ``texts_too`` there is no ``kept``, and nothing but
    the written result stays.
    """
    texts, name = stored_documents(docs)
    cuts = sorted(set(texts.approxQuantile("k", list(batches), 0.01))) if batches else []
    prints = materialize(texts.mapInArrow(_fingerprints, "h bigint, k bigint, c bigint, at int"), "prints")
    index, repeated = FingerprintIndex(), []
    for i in range(len(cuts) + 1):
        batch = prints
        if i:
            batch = batch.filter(F.col("k") > int(cuts[i - 1]))
        if i < len(cuts):
            batch = batch.filter(F.col("k") <= int(cuts[i]))
        repeated.append(index.add(batch))
        if i < len(cuts):
            index.compact()
    known = repeated[0]
    for x in repeated[1:]:
        known = known.unionByName(x)
    known = materialize(known.distinct(), "repeated")
    for x in repeated:
        discard(x)
    asked = prints.join(known, "h").select("k", "c", "at")
    stretches = materialize(
        _beside(texts, asked, "at", ["at"]).mapInArrow(_stretches, "h bigint, d bigint, d2 bigint, k bigint, c bigint, start int, n int"),
        "stretches",
    )
    firsts = _first(stretches, "n", "h")
    several = materialize(firsts.groupBy("first.h").agg(F.count("*").alias("m")).filter("m > 1").select("h"), "several")
    discard(prints)
    shared = firsts.select("first.*").join(several, "h").select(*_PLACE, "n")
    windows = materialize(
        _beside(texts, shared, "asked", ["start", "n"]).mapInArrow(_windows, "d bigint, d2 bigint, k bigint, c bigint, start int"), "windows"
    )
    spans = materialize(_later(stretches, firsts, F.col("n")), "stretch-spans")
    for x in (stretches, firsts, several, known):
        discard(x)
    index.discard()
    first_windows = _first(windows)
    more = materialize(_later(windows, first_windows, F.lit(1)), "window-spans")
    for x in (windows, first_windows):
        discard(x)
    spans_of = (spans, more)
    spans = spans.unionByName(more)
    out = _beside(texts, spans, "removed", ["start", "n"], "left")
    out = out.mapInArrow(_kept, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
    if texts_too:
        return out
    out = materialize(out.drop("kept"), "kept")
    drop(docs.sparkSession, name)
    for x in spans_of:
        discard(x)
    return out
