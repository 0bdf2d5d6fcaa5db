"""Operator 8: SimHash near-duplicates, found with Golay-code fuzzy hashing.

The perfect binary Golay code has a codeword within three bits of every 23-bit word. A word is given its
nearest codeword and, when that is three bits away, the five codewords four bits away: then any two words
that differ in at most two bits share a codeword.

Pigeonhole: of ``BLOCKS`` = 6 blocks of a 64-bit fingerprint, four errors leave at least two untouched.
The bits outside those two form two segments of 21 or 22 bits, one of which has at most two errors, so the
keys (which two blocks, their bits, which segment, a codeword near it) meet in every pair of fingerprints
that differ in at most four bits: 30 layouts, about five keys each, of 33 bits. Equal fingerprints are
one row from the start, so copies cost nothing.

Rows with the same key come to one task as a sorted stream of 8-byte fingerprints, where each pair's
distance is verified in blocks; what leaves is a forest of links (at most one row for each
fingerprint of a key), never the pairs. A key with more than ``HOT`` fingerprints leaves that task as blocks of so
many, and each pair of blocks is a task's work of its own: a fingerprint moves once for each block of its key.
Components of the forest's union equal those of all links.

Defined results: null text is empty; a text of one to three words has one shingle; no words: fingerprint
zero; a text of any length is read whole; equal fingerprints of different rows are linked, repeated rows too; a null
doc_id takes part and is the largest; an empty table has no components; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.words import slices
from tidemark.operators.components import connected_components
from tidemark.storage import discard, materialize, scratch

SHINGLE = 4
SEED = 42
DISTANCE = 4
BLOCKS = 6
#: Fixed value: the generator polynomial of the (23, 12) Golay code.
GENERATOR = 0b101011100011

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PART = 512
#: Most fingerprints of a key that one task compares with each other.
HOT = 1 << 14


def text_fingerprint(text: bytes) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(SHINGLE)], strict=False))
    hashes = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], np.uint64)
    n, ones = len(hashes), np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        found = [text_fingerprint(t or b"") for t in b.column("text").cast(pa.binary()).to_pylist()]
        names = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*[b.column(n) for n in names], pa.array(np.array(found, np.uint64).view(np.int64))], [*names, "fp"]
        )


def fingerprints(docs: DataFrame, *beside: str) -> DataFrame:
    """``(doc_id, *beside, fp bigint)`` for each row; ``fp`` has the fingerprint's bits, ``beside`` is bigint."""
    names = ["doc_id", *beside]
    return docs.select(*names, "text").mapInArrow(_fingerprinted, ", ".join(f"{n} bigint" for n in [*names, "fp"]))


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """The error pattern nearest to each syndrome, and for each syndrome what turns the nearest codeword into
    the five next ones where the pattern has three bits (else zeros)."""
    code = np.array([_times(i) for i in range(4096)], np.uint32)
    sevens = code[np.bitwise_count(code) == 7]
    leader, further = np.zeros(2048, np.uint32), np.zeros((2048, 5), np.uint32)
    for k in range(4):
        for places in combinations(range(23), k):
            error = sum(1 << p for p in places)
            s = int(syndrome(np.array([error], np.uint32))[0])
            leader[s] = error
            if k == 3:
                further[s] = sevens[(sevens & error) == error]
    return leader, further


def _times(message: int) -> int:
    out = 0
    for i in range(12):
        if message >> i & 1:
            out ^= GENERATOR << i
    return out


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of division by the generator."""
    out = words.astype(np.uint32)
    for i in range(22, 10, -1):
        out = out ^ (((out >> np.uint32(i)) & np.uint32(1)) * np.uint32(GENERATOR << (i - 11)))
    return out


def codewords(words: np.ndarray) -> np.ndarray:
    """A row of six codeword indices for each 23-bit word, repeated where it has one."""
    leader, further = golay()
    s = syndrome(words)
    nearest = words.astype(np.uint32) ^ leader[s]
    return np.column_stack([nearest, nearest[:, None] ^ further[s]]) >> np.uint32(11)


def _gather(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits side by side, runs of neighbours at once."""
    out, at, i = np.zeros(len(fp), np.uint64), 0, 0
    while i < len(bits):
        j = i
        while j + 1 < len(bits) and bits[j + 1] == bits[j] + 1:
            j += 1
        run = (fp >> np.uint64(bits[i])) & np.uint64((1 << (j - i + 1)) - 1)
        out |= run << np.uint64(at)
        at += j - i + 1
        i = j + 1
    return out


@cache
def layouts() -> list[tuple[list[int], list[int]]]:
    """The bits that must be equal and the segment that may have two errors."""
    edges = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    blocks = [list(range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    out = []
    for i, j in combinations(range(BLOCKS), 2):
        rest = [x for k, block in enumerate(blocks) if k not in (i, j) for x in block]
        half = len(rest) // 2
        out += [(blocks[i] + blocks[j], rest[:half]), (blocks[i] + blocks[j], rest[half:])]
    return out


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(key, place in fp)`` of all keys."""
    all_keys, all_rows = [], []
    rows = np.arange(len(fp))
    for layout, (exact, segment) in enumerate(layouts()):
        near = codewords(_gather(fp, segment).astype(np.uint32)).astype(np.uint64)
        base = (_gather(fp, exact) << np.uint64(12)) | np.uint64(layout << 40)
        alone = near[:, 0] == near[:, 1]
        all_keys.append(base | near[:, 0])
        all_rows.append(rows)
        more = ~alone
        all_keys.append((base[more, None] | near[more, 1:]).reshape(-1))
        all_rows.append(np.repeat(rows[more], near.shape[1] - 1))
    return np.concatenate(all_keys), np.concatenate(all_rows)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1024):
        fp = b.column("fp").to_numpy()
        key, row = keys(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp[row])], ["key", "fp"])


def forest(fp: np.ndarray) -> np.ndarray:
    """Links ``(a, b)`` that connect what links of at most ``DISTANCE`` bits connect; ``fp`` has no repeats."""
    bits, n = fp.view(np.uint64), len(fp)
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for lo in range(0, n, _PART):
        for other in range(lo, n, _PART):
            near = np.bitwise_count(bits[lo : lo + _PART, None] ^ bits[None, other : other + _PART]) <= DISTANCE
            for i in np.flatnonzero(near.any(axis=1)):
                at = other + np.flatnonzero(near[i])
                at = at[at > lo + i]
                if len(at):
                    a = root(lo + i)
                    for j in np.unique(parent[at]) if len(at) > 1 else at:
                        b = root(int(j))
                        if a != b:
                            a, b = min(a, b), max(a, b)
                            parent[b] = a
                            links.append((a, b))
    return fp[np.array(links, np.int64).reshape(-1, 2)]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, bool]]:
    """``(key, fingerprints, whole)`` of a stream sorted by key: a key with more than one fingerprint at once, or in
    blocks of ``HOT`` where it has more (``whole`` is false then)."""
    key_left, held, count, cut = None, [], 0, False
    for b in batches:
        key, fp = b.column("key").to_numpy(), b.column("fp").to_numpy()
        if not len(key):
            continue
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        starts = np.append(0, ends[:-1])
        if key_left is not None and key[0] != key_left:
            if held and (cut or count > 1):
                yield key_left, np.concatenate(held), not cut
            held, count, cut = [], 0, False
        for g in np.flatnonzero((ends - starts > 1) | (np.arange(len(ends)) == 0) | (np.arange(len(ends)) == len(ends) - 1)):
            if g:
                held, count, cut = [], 0, False
            held.append(fp[starts[g] : ends[g]])
            count += int(ends[g] - starts[g])
            while count > HOT:
                whole = np.concatenate(held)
                yield key[starts[g]], whole[:HOT], False
                held, count, cut = [whole[HOT:]], count - HOT, True
            if g < len(ends) - 1 and (cut or count > 1):
                yield key[starts[g]], np.concatenate(held), not cut
        key_left = key[-1]
    if held and (cut or count > 1):
        yield key_left, np.concatenate(held), not cut


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links ``(src, dst)`` of keys that are whole; else rows of ``(src = fingerprint, key, block)``."""
    key_before, block = None, 0
    for key, fp, whole in _groups(batches):
        if whole:
            fp = np.unique(fp)
            links = forest(fp) if len(fp) > 1 else np.zeros((0, 2), np.int64)
            if len(links):
                yield _rows(links[:, 0], links[:, 1], None, None)
        else:
            block = block + 1 if key == key_before else 0
            key_before = key
            yield _rows(fp, None, key, block)


def _rows(src: np.ndarray, dst: np.ndarray | None, key: int | None, block: int | None) -> pa.RecordBatch:
    n = len(src)

    def repeated(value: int | None) -> pa.Array:
        return pa.nulls(n, pa.int64()) if value is None else pa.array(np.full(n, value, np.int64))

    return pa.RecordBatch.from_arrays(
        [pa.array(src), repeated(None) if dst is None else pa.array(dst), repeated(key), repeated(block)], ["src", "dst", "key", "block"]
    )


def _linked_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the pairs of blocks of a stream sorted by key, each pair of which has a key of its own."""
    held, key_left = [], None

    def out() -> Iterator[pa.RecordBatch]:
        fp = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
        links = forest(fp)
        yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["src", "dst"])

    for b in batches:
        key, fp = b.column("key").to_numpy(), b.column("fp").to_numpy()
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for low, high in zip(edges, edges[1:], strict=False):
            if low < high:
                if key[low] != key_left:
                    yield from out()
                    held, key_left = [], key[low]
                held.append(fp[low:high])
    yield from out()


def link_forest(distinct: DataFrame) -> DataFrame:
    """Links ``(src, dst)`` with the components of all pairs of ``distinct(fp)`` within ``DISTANCE`` bits."""
    keyed = distinct.mapInArrow(_keyed, "key bigint, fp bigint")
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    found = materialize(dealt.mapInArrow(_linked, "src bigint, dst bigint, key bigint, block bigint"), "linked")
    links = found.filter("dst is not null").select("src", "dst")
    hot = found.filter("dst is null").select("key", "block", F.col("src").alias("fp"))
    if not hot.isEmpty():
        blocks = hot.groupBy("key").agg(F.max("block").alias("last"))
        pairs = hot.join(blocks, "key").select("key", "block", "fp", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("other"))
        own = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))  # a key that two pairs share costs time only
        n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        work = pairs.select(own.alias("key"), "fp").repartition(n, "key").sortWithinPartitions("key")
        links = links.unionByName(work.mapInArrow(_linked_blocks, "src bigint, dst bigint"))
    return links.distinct()


def _named(prints: DataFrame, least: Column) -> DataFrame:
    """``(fp, least, component)`` for each distinct ``fp``; ``least`` is an aggregate of its rows."""
    sizes = materialize(prints.groupBy("fp").agg(least.alias("least")), "distinct")
    parts = connected_components(materialize(link_forest(sizes.select("fp")), "links"))
    return sizes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``; the component is named by its smallest doc_id."""
    with scratch(docs.sparkSession) as made:
        prints = made.keep(materialize(fingerprints(docs), "simhash"))
        named = _named(prints, F.min("doc_id"))
        least = named.groupBy("component").agg(F.min("least").alias("component_id"))
        members = made.keep(materialize(named.select("fp", "component").join(least, "component").select("fp", "component_id"), "members"))
    return prints.join(members, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Names that documents don't have.
_ID, _TEXT, _ALL, _COPIES = (f"__tidemark_{x}" for x in ("id", "text", "all", "copies"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: the first by doc_id (null last), hash of the text and hash of the row.

    A row is known by these three, so rows without a doc_id, or with the same one, stay apart; rows that agree in all three
    have one text, thus one component, and the first of them that Spark meets stays for all. Documents are read and not
    copied: only keys are written. A null text is an empty one; an empty table stays empty; all columns are kept.
    """
    whole = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    marked = docs.withColumns({_ID: F.col("doc_id"), _TEXT: F.xxhash64("text"), _ALL: F.xxhash64(*whole)})
    with scratch(docs.sparkSession) as made:
        prints = materialize(fingerprints(marked, _TEXT, _ALL), "simhash")
        row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", _TEXT, _ALL)
        best = _named(prints, F.min(row)).groupBy("component").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("i"), F.col(f"least.{_TEXT}").alias("t"), F.col(f"least.{_ALL}").alias("a"))
        sizes = prints.groupBy("doc_id", _TEXT, _ALL).agg(F.count("*").alias(_COPIES))
        same = F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col(_TEXT)) & (F.col("a") == F.col(_ALL))
        keep = made.keep(materialize(sizes.join(best, same, "left_semi").select(F.col("doc_id").alias("i"), F.col(_TEXT).alias("t"), F.col(_ALL).alias("a"), _COPIES), "keep"))
    mine = F.col("i").eqNullSafe(F.col(_ID)) & (F.col("t") == F.col(_TEXT)) & (F.col("a") == F.col(_ALL))
    out = marked.join(keep.filter(f"{_COPIES} = 1"), mine, "left_semi")
    repeated = keep.filter(f"{_COPIES} > 1")
    if not repeated.isEmpty():
        out = out.unionByName(marked.join(repeated, mine, "left_semi").dropDuplicates([_ID, _TEXT, _ALL]))
    return out.drop(_ID, _TEXT, _ALL)
