"""Operator 12: phrase collocation mining by multikey quicksort of suffix pointers.

Texts are cut into pieces and words; each place in a piece is a suffix, its first ``DEPTH`` words a row of hashes. Phrase
counts are the sizes of equal partitions in a sort of all suffixes: a multikey three-way quicksort parts suffix pointers
into less, equal and greater by one word, and goes a word deeper in the equal part, down to ``DEPTH`` words. An equal part with
fewer than ``least`` suffixes is abandoned there, as no longer phrase in it can reach the count.

On a cluster the suffixes are first routed by their leading words. Each task merges its equal suffixes into one
weighted row (a phrase that a third of all rows repeat is one row of each task, or of each block where they differ much), and these rows are range-partitioned by all of
their words, so that a frequent leading word is spread over as many partitions as it fills. Only the first and the last
prefixes of a partition can go on in the next one; they aren't abandoned, and a sum over all partitions completes their counts.
Suffixes end where a pair or triple of words can't be frequent, and aren't routed if it is their first pair: a sketch of all pairs and
triples gives upper bounds by counters that stop at ``least``, one for about 64 bytes of text within fixed bounds; each pair or triple has
two, and its bound is the lower one; it saves work and can't change a result.

Both steps over the texts run in as many tasks as there are cores, or one for ``WHOLE`` bytes if these are more: a task sends its counters and
a row of each frequent phrase, and both the phrases and Spark's own splits of the texts grow with the input, so that their product would
grow with its square.

Words are known by 64-bit hashes. All words of all texts are held against their hashes, and two of a language that share one start the
work anew with another seed, so counts are exact; scores are exact in decimals of 38 digits (``1000 * a * n`` stays below 10^38).

Defined results: null text is empty; a null lang counts as ``und``; texts of any length are read whole; equal rows count as often as
they occur; ties on score and count are ordered by phrase; an empty table gives no rows; a doc_id and other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.jaccard_groups import _bitmap
from tidemark.llm.words import hashed_runs, mix, sized
from tidemark.storage import discard, materialize

DEPTH = 5
LEAST = 100
#: Per cent of a phrase's count at which a longer one replaces it.
WITHIN = 100
TOP = 2000
UNKNOWN = "und"

#: Counters of the sketch: one for so many bytes of text, and how many there are at least and at most; slices in which tasks send them.
BYTES, FEWEST, MOST, SLICES = 64, 1 << 16, 1 << 28, 64
#: Bytes of text that a task takes at most, about, in the steps over all texts.
WHOLE = 1 << 30
#: Suffixes that a task merges at once before they are routed, and rows of a partition afterwards, about.
BLOCK, ROUTED = 1 << 19, 1 << 20
#: Parts of so few rows are sorted at once.
SMALL = 1 << 12
#: A longer word is digested instead of hashed as a polynomial.
LONG = 64
#: Bytes of text that a task takes at once, and words that it holds before it sends them.
TEXT, HELD = 512 << 10, 1 << 18

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _STOP.copy()
_GAP[[0x20, 0x09]] = True
_WORDS = [f"w{i}" for i in range(DEPTH)]
_SUFFIX = f"lang string, {', '.join(f'{w} bigint' for w in _WORDS)}"


class Words:
    """All words of some texts in order."""

    def __init__(self, texts: list[bytes | None], langs: list[str], seed: int) -> None:
        texts = [(t or b"").translate(_LOWER) for t in texts]
        self.raw = b"\n".join([*texts, b""])
        raw = np.frombuffer(self.raw, np.uint8)
        table = mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(seed << 8))
        self.hashes, self.starts, self.ends = hashed_runs(raw, _GAP, table)
        for i in np.flatnonzero(self.ends - self.starts > LONG).tolist():
            word = self.raw[self.starts[i] : self.ends[i]]
            self.hashes[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
        self.hashes[self.hashes == 0] = 1  # a zero ends a suffix
        self.doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.starts, side="right")
        #: Whether the next word is of the same piece.
        self.goes_on = np.zeros(len(self.hashes), bool)
        stops = np.concatenate([[0], np.cumsum(_STOP[raw], dtype=np.int32)])
        self.goes_on[:-1] = stops[self.starts[1:]] == stops[self.ends[:-1]]
        tags = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs]
        mine = np.array(tags, np.uint64)[self.doc]
        one, two = (np.append(self.hashes, np.zeros(2, np.uint64))[i : i + len(mine)] for i in (1, 2))
        pair = mix(mix(self.hashes ^ mine) + one)
        #: Hashes of each word and the next one or two, and whether they are of one piece.
        self.grams = [(pair, self.goes_on), (mix(pair + two), self.goes_on & np.append(self.goes_on[1:], self.goes_on[:0] if not len(mine) else [False]))]

    def other_hashes(self) -> np.ndarray:
        """Second hashes of the words, by which words of one hash are told apart."""
        raw = np.frombuffer(self.raw, np.uint8)
        return hashed_runs(raw, _GAP, mix(np.arange(1, 257, dtype=np.uint64) ^ np.uint64(1 << 63)))[0]

    def texts_of(self, places: np.ndarray) -> list[bytes]:
        return [self.raw[a:b] for a, b in zip(self.starts[places].tolist(), self.ends[places].tolist(), strict=True)]


def _words(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[Words, list[str]]]:
    for b in sized(batches, "text", TEXT):
        langs = b.column("lang").to_pylist()
        yield Words(b.column("text").cast(pa.binary()).to_pylist(), langs, seed), langs


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows change."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    new[:1] = True
    return np.flatnonzero(new)


class _Held:
    """Words of a task with their counts, until there are many."""

    def __init__(self) -> None:
        self.languages: dict[str, int] = {}
        self.columns: list[np.ndarray] = []
        self.texts: list[bytes] = []

    def add(self, words: Words, langs: list[str]) -> None:
        code = np.array([self.languages.setdefault(x, len(self.languages)) for x in langs], np.uint64)[words.doc]
        rows = np.column_stack([code, words.hashes, words.other_hashes(), np.ones(len(code), np.uint64)])
        rows, place = self._once(rows)
        self.columns.append(rows)
        self.texts += words.texts_of(place)

    @staticmethod
    def _once(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort(rows[:, 2::-1].T)
        if not len(order):
            return rows, order
        first = _heads(*rows[order, :3].T)
        sums = np.add.reduceat(rows[order, 3], first)
        return np.column_stack([rows[order[first], :3], sums]), order[first]

    def merge(self) -> None:
        rows, place = self._once(np.concatenate(self.columns))
        self.columns, self.texts = [rows], [self.texts[i] for i in place.tolist()]

    def out(self) -> pa.RecordBatch:
        rows = np.concatenate(self.columns) if self.columns else np.zeros((0, 4), np.uint64)
        langs = pa.array(list(self.languages), pa.string()).take(pa.array(rows[:, 0]))
        columns = [langs, *[pa.array(np.ascontiguousarray(rows[:, i]).view(np.int64)) for i in (1, 3)], pa.array(self.texts, pa.binary()).cast(pa.string()), pa.nulls(len(rows), pa.binary())]
        self.__init__()
        return pa.RecordBatch.from_arrays(columns, _COUNTED)


def _coded(counts: bytes) -> bytes:
    """Counters are small numbers without a pattern, so only their frequencies make them shorter."""
    code = zlib.compressobj(6, zlib.DEFLATED, 15, 9, zlib.Z_HUFFMAN_ONLY)
    return code.compress(counts) + code.flush()


_COUNTED = ["lang", "h", "n", "word", "counts"]


def _places(gram: np.ndarray, counters: int) -> list[np.ndarray]:
    """Two counters of each hash, one in each half: by its first bits, which follow the order of hashes, and by its last ones."""
    half = counters // 2
    return [(gram >> np.uint64(65 - half.bit_length())).astype(np.int64), (gram & np.uint64(half - 1)).astype(np.int64) + half]


def _count(counts: np.ndarray, gram: np.ndarray, least: int) -> None:
    """Raise both counters of each hash to what the lower one and its number here come to, so that neither is below its count."""
    gram, n = np.unique(gram, return_counts=True)
    places = _places(gram, len(counts))
    upto = np.minimum(np.minimum(*[counts[at] for at in places]) + n, least).astype(counts.dtype)
    for at in places:
        np.maximum.at(counts, at, upto)


def _counted(seed: int, least: int, counters: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words with their counts, and at the end the counters of pairs and triples (rows without a language)."""
        counts = np.zeros(counters, np.uint8 if least < 256 else np.uint32)
        held = _Held()
        for words, langs in _words(batches, seed):
            for gram, whole in words.grams:
                _count(counts, gram[whole], least)
            held.add(words, langs)
            if len(held.texts) > HELD:
                held.merge()
                if len(held.texts) > HELD // 2:
                    yield held.out()
        if held.columns:
            held.merge()
            yield held.out()
        none = [pa.nulls(1, kind) for kind in (pa.string(), pa.int64(), pa.string())]
        for i, part in enumerate(counts.reshape(SLICES, -1)):
            yield pa.RecordBatch.from_arrays([none[0], pa.array([i]), none[1], none[2], pa.array([_coded(part.tobytes())], pa.binary())], _COUNTED)

    return run


def _frequent(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which counters reach ``least``, as bits of each slice."""
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b.column("h").to_pylist(), b.column("counts").to_pylist(), strict=True):
                more = np.frombuffer(zlib.decompress(counts), np.uint8 if least < 256 else np.uint32).astype(np.uint32)
                sums[part] = np.minimum(sums[part] + more, least) if part in sums else more
        bits = [np.packbits(x >= least).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(bits, pa.binary())], ["h", "bits"])

    return run


def _merged(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows once, in order, with the sums of their weights."""
    if not len(rows):
        return rows, weights
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    first = _heads(*rows.T)
    return rows[first], np.add.reduceat(weights[order], first)


def _suffixes(bits, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Suffixes whose leading pair may be frequent, up to their first pair or triple that can't be; equal ones of a
        task once while they take less than half a block."""
        names: dict[str, int] = {}
        held: list[np.ndarray] = []
        weights: list[np.ndarray] = []
        count = 0

        def out() -> pa.RecordBatch:
            rows, n = held.pop(), weights.pop()
            langs = pa.array(list(names), pa.string()).take(pa.array(rows[:, 0]))
            return pa.RecordBatch.from_arrays([langs, *[pa.array(np.ascontiguousarray(rows[:, i + 1])) for i in range(DEPTH)], pa.array(n)], ["lang", *_WORDS, "n"])

        for words, langs in _words(batches, seed):
            (pair, triple) = (np.append(whole & _may_reach(bits.value, gram), np.zeros(DEPTH, bool)) for gram, whole in words.grams)
            code = np.array([names.setdefault(x, len(names)) for x in langs], np.int64)
            hashes = words.hashes.view(np.int64)
            at = np.flatnonzero(pair)
            for low in range(0, len(at), BLOCK):
                s = at[low : low + BLOCK]
                rows = np.zeros((len(s), DEPTH + 1), np.int64)
                rows[:, 0], rows[:, 1] = code[words.doc[s]], hashes[s]
                going = np.ones(len(s), bool)
                for d in range(1, DEPTH):
                    going &= pair[s + d - 1] & (triple[s + d - 2] if d > 1 else True)
                    rows[going, d + 1] = hashes[s[going] + d]
                held.append(rows)
                weights.append(np.ones(len(s), np.int64))
                count += len(s)
                if count >= BLOCK:
                    rows, n = _merged(np.concatenate(held), np.concatenate(weights))
                    held, weights, count = [rows], [n], len(rows)
                    if count > BLOCK // 2:
                        yield out()
                        count = 0
        if held:
            rows, n = _merged(np.concatenate(held), np.concatenate(weights))
            held, weights = [rows], [n]
            yield out()

    return run


def _in_bitmap(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in a bitmap, of as many bits as a power of two."""
    table = np.frombuffer(bits, np.uint8)
    place = (hashes.view(np.uint64) & np.uint64(8 * len(table) - 1)).astype(np.int64)
    return (table[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)


def _may_reach(bits: bytes, gram: np.ndarray) -> np.ndarray:
    """Which hashes have both counters at ``least``."""
    one, two = (_in_bitmap(bits, at) for at in _places(gram, 8 * len(bits)))
    return one & two


class MultikeySort:
    """Three-way quicksort of pointers to the rows of ``rows`` (values by row; after the first, a zero ends a row).

    Parts whose sum of ``weights`` is below ``least`` are abandoned, but for prefixes of the first and the last row of all,
    which can go on elsewhere.
    """

    def __init__(self, rows: np.ndarray, weights: np.ndarray, least: int) -> None:
        self.rows, self.weights, self.least = rows, weights, least
        self.width = rows.shape[1]
        self.borders = []
        for pick in (np.min, np.max):
            left = np.arange(len(rows))
            for d in range(self.width if len(rows) else 0):
                left = left[rows[left, d] == pick(rows[left, d])]
            self.borders += [rows[left[0]]] if len(left) else []

    def _goes_on(self, heads: np.ndarray, sums: np.ndarray, d: int) -> np.ndarray:
        keep = sums >= self.least
        for border in self.borders:
            keep |= (self.rows[heads, :d] == border[:d]).all(axis=1)
        return keep

    def parts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(d, pointers, sums)`` of equal parts of ``d`` values: a pointer to one row of each, and its sum."""
        stack = [(np.arange(len(self.rows)), 0)]
        while stack:
            pointers, d = stack.pop()
            if len(pointers) <= SMALL:
                yield from self._small(pointers, d)
                continue
            key = self.rows[pointers, d]
            sample = np.sort(key[:: max(1, len(key) // 64)])
            pivot = sample[len(sample) // 2]
            low, high = key < pivot, key > pivot
            stack += [(part, d) for part in (pointers[low], pointers[high]) if len(part)]
            if pivot == 0 and d:
                continue
            equal = pointers[~(low | high)]
            total = self.weights[equal].sum(keepdims=True)
            if self._goes_on(equal[:1], total, d + 1)[0]:
                yield d + 1, equal[:1], total
                if d + 1 < self.width:
                    stack.append((equal, d + 1))

    def _small(self, pointers: np.ndarray, d: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        part = np.zeros(len(pointers), np.int64)
        while d < self.width:
            key = self.rows[pointers, d]
            if d:
                going = key != 0
                pointers, key, part = pointers[going], key[going], part[going]
            if not len(pointers):
                return
            order = np.lexsort((key, part))
            pointers = pointers[order]
            first = _heads(key[order], part[order])
            sums = np.add.reduceat(self.weights[pointers], first)
            keep = self._goes_on(pointers[first], sums, d + 1)
            if keep.any():
                yield d + 1, pointers[first[keep]], sums[keep]
            lengths = np.diff(np.append(first, len(pointers)))
            part = np.repeat(np.arange(len(first)), lengths)
            stays = np.repeat(keep, lengths)
            pointers, part = pointers[stays], part[stays]
            d += 1


def _sorted_parts(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phrases of a range of weighted suffixes, with their sums in it."""
        names: dict[str, int] = {}
        held, weights, count = [], [], 0
        for b in batches:
            langs = b.column("lang").dictionary_encode()
            code = np.array([names.setdefault(x, len(names)) for x in langs.dictionary.to_pylist()], np.int64)
            held.append(np.column_stack([code[langs.indices.to_numpy()], *[b.column(w).to_numpy() for w in _WORDS]]))
            weights.append(b.column("n").to_numpy())
            count += b.num_rows
            if count > 2 * ROUTED:  # equal suffixes of many blocks take the room of one
                rows, n = _merged(np.concatenate(held), np.concatenate(weights))
                held, weights, count = [rows], [n], len(rows) - ROUTED
        if not held:
            return
        rows, n = np.concatenate(held), np.concatenate(weights)
        known = sorted(names)  # in the order of the ranges
        rank = {x: i for i, x in enumerate(known)}
        rows[:, 0] = np.array([rank[x] for x in names], np.int64)[rows[:, 0]]
        found, sums = [], []
        for d, pointers, total in MultikeySort(rows, n, least).parts():
            if d > 2:  # a language and two words at least
                phrase = rows[pointers]
                phrase[:, d:] = 0
                found.append(phrase)
                sums.append(total)
        if found:
            phrase = np.concatenate(found)
            langs = pa.array(known, pa.string()).take(pa.array(phrase[:, 0]))
            yield pa.RecordBatch.from_arrays([langs, *[pa.array(np.ascontiguousarray(phrase[:, i + 1])) for i in range(DEPTH)], pa.array(np.concatenate(sums))], ["lang", *_WORDS, "a"])

    return run


def _counters(size: int, least: int) -> int:
    """Counters of the sketch for so many bytes of text; wide ones are fewer."""
    return max(FEWEST, min(MOST if least < 256 else MOST // 4, 1 << (size // BYTES).bit_length()))


def _tasks(size: int, cores: int) -> int:
    """Tasks for the steps over so many bytes of text."""
    return max(cores, -(-size // WHOLE))


def _seeded(docs: DataFrame, seed: int, least: int, counters: int) -> tuple[DataFrame, DataFrame] | None:
    """``(words, counts)``; None if two words of a language share a hash."""
    words = materialize(docs.mapInArrow(_counted(seed, least, counters), "lang string, h bigint, n bigint, word string, counts binary"), "words")
    check = F.xxhash64("word")
    counts = words.filter("lang is not null").groupBy("lang", "h").agg(F.sum("n").alias("n"), F.min(check).alias("least"), F.max(check).alias("most"))
    counts = materialize(counts, "word-counts")
    if counts.filter("least <> most").isEmpty():
        return words, counts
    discard(words)
    discard(counts)
    return None


def phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(lang, w, a)``: all phrases of 2 to ``DEPTH`` words that occur ``least`` times, as arrays of hashes; counts of all words; and words with
    their hashes."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counters = _counters(size, least)
    docs = docs.coalesce(_tasks(size, spark.sparkContext.defaultParallelism))
    seed = 0
    while (found := _seeded(docs, seed, least, counters)) is None:
        seed += 1
    words, counts = found
    slices = words.filter("lang is null").select("h", "counts").repartition(SLICES, "h").mapInArrow(_frequent(least), "h bigint, bits binary")
    bits = {r.h: r.bits for r in slices.collect()}  # at most MOST bits
    sketch = spark.sparkContext.broadcast(b"".join(bits.get(i, bytes(counters // SLICES // 8)) for i in range(SLICES)))
    suffixes = materialize(docs.mapInArrow(_suffixes(sketch, seed), f"{_SUFFIX}, n bigint"), "suffixes")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-suffixes.count() // ROUTED))
    routed = suffixes.repartitionByRange(n, "lang", *_WORDS)
    parts = routed.mapInArrow(_sorted_parts(least), f"{_SUFFIX}, a bigint")
    whole = parts.groupBy("lang", *_WORDS).agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    out = materialize(whole.select("lang", F.filter(F.array(*_WORDS), lambda x: x != 0).alias("w"), "a"), "phrases")
    discard(suffixes)
    return out, counts, words


def _scored(found: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """``(lang, w, a, l, r, n, score)``: each phrase at its lowest-scoring cut."""
    single = counts.filter(F.col("n") >= least).select("lang", F.array("h").alias("w"), F.col("n").alias("a"))
    known = found.select("lang", "w", "a").unionByName(single)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    cuts = found.withColumn("cut", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.withColumn("left", F.slice("w", F.lit(1), F.col("cut"))).withColumn("right", F.slice("w", F.col("cut") + 1, F.size("w") - F.col("cut")))
    left, right = (known.select("lang", F.col("w").alias(side), F.col("a").alias(side[0])) for side in ("left", "right"))
    cuts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang")
    wide = {c: f"cast({c} as decimal(18, 0))" for c in "anlr"}
    score = F.expr(f"({wide['a']} * {wide['n']} * cast(1000 as decimal(4, 0))) div ({wide['l']} * {wide['r']})")
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r", "n")).alias("best")
    return cuts.groupBy("lang", "w", "a").agg(best).select("lang", "w", "a", "best.l", "best.r", "best.n", "best.score")


def _not_within(scored: DataFrame, within: int) -> DataFrame:
    """Phrases that no longer one with nearly their count contains."""
    longer = scored.filter(F.size("w") > 2).select("lang", "w", F.col("a").alias("outer"), F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("k"))
    inner = longer.withColumn("i", F.explode(F.expr("sequence(1, size(w) - k + 1)"))).select("lang", F.expr("slice(w, i, k)").alias("w"), "outer")
    most = inner.groupBy("lang", "w").agg(F.max("outer").alias("outer"))
    return scored.join(most, ["lang", "w"], "left").filter(F.coalesce(100 * F.col("outer") < within * F.col("a"), F.lit(True))).drop("outer")


def _maybe(bits) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words that may be asked for, so that the others don't move."""
        for b in batches:
            yield b.filter(pa.array(_in_bitmap(bits.value, b.column("h").to_numpy())))

    return run


def _spelled(found: DataFrame, words: DataFrame) -> DataFrame:
    """Add ``phrase``: the words of ``w``, space-joined."""
    each = found.select("lang", "w", F.posexplode("w").alias("i", "h"))
    asked = materialize(each.select("lang", "h").distinct(), "asked")
    bits = words.sparkSession.sparkContext.broadcast(_bitmap(asked.select(F.col("h").alias("t")))[0])
    likely = words.filter("lang is not null").select("lang", "h", "word").mapInArrow(_maybe(bits), "lang string, h bigint, word string")
    spelling = likely.join(asked, ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])
    parts = each.join(spelling, ["lang", "h"]).groupBy("lang", "w").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("parts"))
    return found.join(parts.select("lang", "w", F.array_join("parts.word", " ").alias("phrase")), ["lang", "w"])


def collocations(docs: DataFrame, least: int = LEAST, within: int = WITHIN, top: int = TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each language of ``docs(lang, text)``."""
    found, counts, words = phrases(docs, least)
    rows = materialize(_not_within(_scored(found, counts, least), within), "scored")
    discard(found)
    order = [F.col("score").desc(), F.col("a").desc()]
    salt = F.pmod(F.xxhash64("w"), F.lit(64))
    # ranks keep all that tie with the last, as ties are ordered by phrases, which only these need
    for by in (["lang", "salt"], ["lang"]):
        rows = rows.withColumn("salt", salt).withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    spelled = materialize(_spelled(rows.drop("rank"), words), "spelled")
    for x in (words, counts):
        discard(x)
    for by in (["lang", "salt"], ["lang"]):
        numbered = F.row_number().over(Window.partitionBy(*by).orderBy(*order, "phrase"))
        spelled = spelled.withColumn("rank", numbered.cast("bigint")).filter(F.col("rank") <= top)
    return spelled.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
