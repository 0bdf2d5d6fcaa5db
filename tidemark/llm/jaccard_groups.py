"""Operator 11: n-gram Jaccard join over a token-group matrix.

A document's set is its distinct 3-word shingles, as 64-bit hashes; equal sets are one row from the start, known by 128 bits
of BLAKE2b over all of them. Sets are partitioned into groups of similar ones: those with the same two min-hashes and
about the same size come next to each other in a range partitioning and are cut into groups of at most ``GROUP`` sets and
``TOKENS`` tokens. A group stores its token union and which of its sets has which token.

Which groups can hold a partner of a query set is answered by the matrix of tokens and groups. Tokens have one global order, from
seldom to frequent by a count sketch over all documents (only consistency of that order matters for the result, not
its counts). Sets that link share one of the first n - ceil(0.9 n) + 1 tokens of both, so the matrix keeps these of each
union; a row also says how many tokens a set of the group has from there on, and the sizes of the group's sets. Two groups meet
only where a shared token leaves room for the overlap that their sizes ask for; two groups of one set each only where the kept tokens that
they share, and what both have left behind the end of the kept ones, reach it. Then, for each query set of the one group,
the overlap with the other's union bounds that with each of its sets: only sets whose bound reaches the threshold
are opened, and the overlaps of those are a product of two bit matrices.

Each set lies in one group, so each pair of sets is looked at once: a task sends a count of links for each of its sets, and a
forest of them, never the pairs. Groups of near copies of any size are spread over many groups and tasks.

Two shingles of documents that are compared share a hash with a chance of about n^2 / 2^64; else the result is exact.

Defined results: null text, and text without a word, is an empty set that links with nothing and is its own component; a text of one
or two words is one shingle; texts of any length are read whole; repeated rows are documents like any other; a null
doc_id takes part but never names a component (null if there is no other name); an empty table stays empty; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.words import mix, rolling, sized, slices, word_hashes
from tidemark.operators.components import connected_components
from tidemark.storage import discard, materialize

SHINGLE = 3
#: Per cent of the union that the intersection has at least.
PERCENT = 90
#: Most sets of a group, and most tokens of all its sets together (a larger set is alone).
GROUP, TOKENS = 128, 1 << 16
#: Counters of the sketch that orders tokens: one for so many bytes of text, and how many there are at least and at most; slices in which tasks send them.
BYTES, FEWEST, MOST, SLICES = 64, 1 << 16, 1 << 24, 64
#: Bits of the bitmap that tells which texts are opened: 16 for each, within these.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_OTHER = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(1 << 63)


def shingle_lists(texts: list[bytes | None], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The hashes of each text's shingles in order, repeats included."""
    hashes, lengths = word_hashes([(x or b"").translate(_LOWER) for x in texts])
    high = 0
    for n in lengths.tolist():
        low, high = high, high + n
        yield rolling(hashes[low:high], min(size, n)) if n else hashes[:0]


def _slot(tokens: np.ndarray, counters: int) -> np.ndarray:
    return (mix(tokens) & np.uint64(counters - 1)).astype(np.int64)


def _counted(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(counters, np.uint32)
        for b in sized(batches, "text"):
            tokens = np.concatenate(list(shingle_lists(b.column("text").cast(pa.binary()).to_pylist())))
            at, n = np.unique(_slot(tokens, counters), return_counts=True)
            counts[at] += n.astype(np.uint32)
        yield _slices(dict(enumerate(counts.reshape(SLICES, -1))))

    return run


def _slices(counts: dict[int, np.ndarray]) -> pa.RecordBatch:
    pack = zstandard.ZstdCompressor(level=1).compress
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array([pack(x.tobytes()) for x in counts.values()], pa.binary())], ["slice", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the slices of counters, on a scale of quarters of powers of two."""
    unpack = zstandard.ZstdDecompressor().decompress
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for i, counts in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist(), strict=True):
            sums[i] = sums.get(i, 0) + np.frombuffer(unpack(counts), np.uint32).astype(np.int64)
    yield _slices({i: (4 * np.log2(x + 1.0)).astype(np.uint8) for i, x in sums.items()})


def token_ranks(docs: DataFrame) -> np.ndarray:
    """How frequent the shingles on each of the counters are, in a byte for each."""
    unpack = zstandard.ZstdDecompressor().decompress
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counters = max(FEWEST, min(MOST, 1 << (size // BYTES).bit_length()))
    slices_ = docs.select("text").mapInArrow(_counted(counters), "slice bigint, counts binary").repartition(SLICES, "slice")
    out = np.zeros((SLICES, counters // SLICES), np.uint8)
    for r in slices_.mapInArrow(_summed, "slice bigint, counts binary").toLocalIterator():  # a byte for each counter
        out[r.slice] = np.frombuffer(unpack(r.counts), np.uint8)
    return out.reshape(-1)


def needed(n: int, percent: int = PERCENT) -> int:
    """Least overlap of a set of ``n`` tokens with any set that it links with."""
    return -(-percent * n // 100)


def _sets(counts, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for b in sized(batches, "text"):
            heads, firsts, rests, ends = [], [], [], []
            for shingles in shingle_lists(b.column("text").cast(pa.binary()).to_pylist()):
                tokens = np.unique(shingles)
                n = len(tokens)
                digest = np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), np.int64).tolist()
                least = [int(x.view(np.int64)) for x in (mix(tokens).min(), mix(tokens ^ _OTHER).min())] if n else [0, 0]
                heads.append((n, *digest, *least))
                ranks = table[_slot(tokens, len(table))]
                order = np.argsort(ranks, kind="stable")[: n - needed(n, percent) + 1 if n else 0]
                firsts.append(tokens[order].view(np.int64))
                ends.append((int(ranks[order[-1]]), int((tokens[order[-1]] ^ _TOP).view(np.int64))) if n else (0, 0))
                rests.append(np.arange(n, n - len(order), -1, dtype=np.int32))
            lengths = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
            columns = np.column_stack([np.array(heads, np.int64).reshape(-1, 5), np.array(ends, np.int64).reshape(-1, 2)])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("th"),
                    *[pa.array(np.ascontiguousarray(columns[:, i])) for i in range(7)],
                    pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(firsts))),
                    pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(rests))),
                ],
                ["doc_id", "th", "n", "s1", "s2", "m1", "m2", "end_rank", "end_token", "first", "rest"],
            )

    return run


_MEMBER = ("s1", "s2", "n", "copies", "least", "doc_id", "th")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of a stream of distinct sets that is sorted by its first columns."""
    task, done = TaskContext.get().partitionId() << 40, 0
    held, key, tokens = [], None, 0

    def out() -> dict:
        ids = np.concatenate([np.array(r["first"], np.int64) for r in held])
        rest = np.concatenate([np.array(r["rest"], np.int64) for r in held])
        order = np.lexsort((-rest, ids))
        ids, rest = ids[order], rest[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        sizes = [r["n"] for r in held]
        members = [{"node": task + done + i, **{c: r[c] for c in _MEMBER}} for i, r in enumerate(held)]
        return {"gid": task + done, "lo": min(sizes), "hi": max(sizes), "end_rank": held[0]["end_rank"], "end_token": held[0]["end_token"], "members": members, "token": ids[first].tolist(), "rest": rest[first].tolist()}

    rows = []
    for b in slices(batches):
        for r in b.to_pylist():
            mine = (r["m1"], r["m2"], r["band"])
            if held and (mine != key or len(held) == GROUP or tokens + r["n"] > TOKENS):
                rows.append(out())
                done += len(held)
                held, tokens = [], 0
            held.append(r)
            key, tokens = mine, tokens + r["n"]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _GROUPS)
            rows = []
    if held:
        yield pa.RecordBatch.from_pylist([out()], _GROUPS)


_GROUPS = pa.schema(
    [(c, pa.int64()) for c in ("gid", "lo", "hi", "end_rank", "end_token")]
    + [("members", pa.list_(pa.struct([(c, pa.int64()) for c in ("node", *_MEMBER)])))]
    + [("token", pa.list_(pa.int64())), ("rest", pa.list_(pa.int64()))]
)
_GROUPS_SQL = f"gid bigint, lo bigint, hi bigint, end_rank bigint, end_token bigint, members array<struct<{', '.join(f'{c}: bigint' for c in ('node', *_MEMBER))}>>, token array<bigint>, rest array<bigint>"


def token_groups(sets: DataFrame) -> DataFrame:
    """``(gid, lo, hi, members, token, rest)``: the groups of the distinct sets with their part of the matrix.

    ``copies`` and ``least`` of a member are how many rows have the set and their least doc_id; ``doc_id`` and ``th`` know one of them.
    """
    one = F.min(F.struct("th", "doc_id"))
    distinct = (
        sets.filter("n > 0")
        .groupBy("s1", "s2")
        .agg(one.alias("one"), F.count("*").alias("copies"), F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "m1", "m2", "end_rank", "end_token", "first", "rest")])
        .withColumn("band", F.floor(F.log("n") / F.log(F.lit(100 / PERCENT))))
        .select("m1", "m2", "band", "s1", "s2", "n", "copies", "least", "one.doc_id", "one.th", "end_rank", "end_token", "first", "rest")
    )
    by = ["m1", "m2", "band", "s1", "s2"]
    return distinct.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_grouped, _GROUPS_SQL)


def candidate_groups(groups: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of groups of which a query set of one may link with a set of the other."""
    names = ("gid", "lo", "hi", "single", "end")
    rows = groups.select("gid", "lo", "hi", (F.size("members") == 1).alias("single"), F.struct("end_rank", "end_token").alias("end"), F.explode(F.arrays_zip("token", "rest")).alias("x"))
    rows = rows.select(*names, "x.token", "x.rest")
    a, b = (rows.select("token", *[F.col(c).alias(f"{c}_{side}") for c in (*names, "rest")]) for side in "ab")
    met = a.join(b, "token").filter((F.col("gid_a") < F.col("gid_b")) & (100 * F.col("hi_a") >= percent * F.col("lo_b")) & (100 * F.col("hi_b") >= percent * F.col("lo_a")))
    both = F.col("single_a") & F.col("single_b")

    def reaches(overlap):
        return (100 + percent) * overlap >= percent * (F.col("lo_a") + F.col("lo_b"))

    met = met.filter(both | reaches(F.least("rest_a", "rest_b")))
    pairs = met.groupBy(F.col("gid_a").alias("a"), F.col("gid_b").alias("b")).agg(
        F.count("*").alias("shared"), F.min("rest_a").alias("rest_a"), F.min("rest_b").alias("rest_b"), *[F.first(c).alias(c) for c in ("lo_a", "lo_b")],
        F.first(both).alias("both"), F.first(F.col("end_a") <= F.col("end_b")).alias("a_ends"),
    )
    # what both share up to the nearer end is counted; one has so many tokens behind its end, the other so many behind the last shared one
    behind = {x: F.floor((percent * F.col(f"lo_{x}") + 99) / 100).cast("bigint") - 1 for x in "ab"}
    left = F.when(F.col("a_ends"), F.least(behind["a"], F.col("rest_b") - 1)).otherwise(F.least(behind["b"], F.col("rest_a") - 1))
    return pairs.filter(~F.col("both") | reaches(F.col("shared") + left)).select("a", "b")


def _asked(bits, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose text may be asked for, each once in a task."""
        asked, seen = np.unpackbits(np.frombuffer(bits.value, np.uint8)), set()
        for b in sized(batches, "text"):
            keep = []
            for i, key in enumerate(zip(b.column("doc_id").to_pylist(), b.column("th").to_pylist(), strict=True)):
                if asked[key[1] % size] and key not in seen:
                    seen.add(key)
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    return run


def _bitmap(wanted: DataFrame) -> tuple[bytes, int]:
    """Hashes of the wanted texts as bits; the driver gets a row for each byte that isn't zero. More texts
    than ``MOST_BITS`` has room for make it less sharp, no more."""
    size = max(LEAST_BITS, min(MOST_BITS, 1 << (16 * wanted.count()).bit_length()))
    place = F.pmod("t", F.lit(size))
    found = wanted.select(F.floor(place / 8).cast("int").alias("at"), F.expr(f"shiftright(128, cast(pmod(t, {size}) % 8 as int))").alias("bit"))
    rows = found.groupBy("at").agg(F.bit_or("bit").cast("int").alias("byte")).toArrow()
    out = np.zeros(size // 8, np.uint8)
    out[rows.column("at").to_numpy()] = rows.column("byte").to_numpy()
    return out.tobytes(), size


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a stream of texts sorted by group and set: each group's token union and the bits of its sets."""
    gid, held = None, {}

    def out() -> pa.RecordBatch:
        sets = [tokens for _, tokens in held.values()]
        union, where = np.unique(np.concatenate(sets), return_inverse=True)
        bits = np.zeros((len(sets), len(union)), bool)
        bits[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), where] = True
        row = {"gid": gid, "node": list(held), "copies": [n for n, _ in held.values()], "tokens": union.tobytes(), "bits": np.packbits(bits, axis=1).tobytes()}
        return pa.RecordBatch.from_pylist([row], _BLOCKS)

    for b in sized(batches, "text"):
        texts = b.column("text").cast(pa.binary()).to_pylist()
        for g, node, copies, text in zip(*[b.column(c).to_pylist() for c in ("gid", "node", "copies")], texts, strict=True):
            if held and g != gid:
                yield out()
                held = {}
            gid = g
            if node not in held:  # a row that the table repeats
                held[node] = copies, np.unique(next(shingle_lists([text])))
    if held:
        yield out()


_BLOCKS = pa.schema([("gid", pa.int64()), ("node", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())), ("tokens", pa.binary()), ("bits", pa.binary())])
_BLOCKS_SQL = "gid bigint, node array<bigint>, copies array<bigint>, tokens binary, bits binary"


class Block:
    """A group's sets, opened."""

    def __init__(self, row: dict) -> None:
        self.node, self.copies = np.array(row["node"]), np.array(row["copies"])
        self.union = np.frombuffer(row["tokens"], np.uint64)
        packed = np.frombuffer(row["bits"], np.uint8).reshape(len(self.node), -1)
        self.bits = np.unpackbits(packed, axis=1, count=len(self.union)).astype(bool)
        self.sizes = self.bits.sum(axis=1)


#: Tokens that are multiplied at once.
_COLUMNS = 4096


def links(query: Block, group: Block, percent: int = PERCENT) -> np.ndarray:
    """Which sets of ``query`` link with which of ``group``."""
    out = np.zeros((len(query.node), len(group.node)), bool)
    both, q_at, g_at = np.intersect1d(query.union, group.union, assume_unique=True, return_indices=True)
    q, g = query.bits[:, q_at], group.bits[:, g_at]
    # the overlap with the other's union bounds that with each of its sets; the others stay closed
    q_open = np.flatnonzero(100 * q.sum(axis=1) >= percent * query.sizes)
    g_open = np.flatnonzero(100 * g.sum(axis=1) >= percent * group.sizes)
    if len(q_open) and len(g_open):
        overlap = np.zeros((len(q_open), len(g_open)), np.int64)
        for low in range(0, len(both), _COLUMNS):
            a, b = (x[rows, low : low + _COLUMNS].astype(np.float32) for x, rows in ((q, q_open), (g, g_open)))
            overlap += (a @ b.T).astype(np.int64)
        total = query.sizes[q_open, None] + group.sizes[None, g_open]
        out[np.ix_(q_open, g_open)] = (100 + percent) * overlap >= percent * total
    return out


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the true cells of ``linked`` connect; no more than there are rows and columns."""
    label, out = np.full(len(right), -1), []
    for i in np.flatnonzero(linked.any(axis=1)).tolist():
        mine = np.flatnonzero(linked[i])
        old, first = np.unique(label[mine], return_index=True)
        new = mine[label[mine] == -1]
        out += [(int(left[i]), int(right[j])) for j in mine[first[old >= 0]].tolist()]
        out += [(int(left[i]), int(right[j])) for j in new.tolist()]
        label[np.isin(label, old[old >= 0])] = i
        label[new] = i
    return out


def _found(batch: list[tuple[np.ndarray, Block, Block]]) -> pa.RecordBatch:
    src, dst, n = [], [], []
    for linked, a, b in batch:
        edges = [(x, y) for x, y in forest(linked, a.node, b.node) if x != y]
        counts = [(a, linked @ b.copies)] if a is b else [(a, linked @ b.copies), (b, linked.T @ a.copies)]
        src += [x for x, _ in edges]
        dst += [y for _, y in edges]
        n += [None] * len(edges)
        for block, weight in counts:
            at = np.flatnonzero(weight)
            src += block.node[at].tolist()
            dst += [None] * len(at)
            n += weight[at].tolist()
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (src, dst, n)], ["src", "dst", "n"])


def _within(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches, "bits"):
            blocks = [Block(r) for r in b.to_pylist()]
            yield _found([(links(x, x, percent), x, x) for x in blocks])

    return run


def _across(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                found = []
                for r in batch.slice(low, 64).to_pylist():
                    a, b = (Block({c: r[f"{c}_{side}"] for c in ("node", "copies", "tokens", "bits")}) for side in "ab")
                    found.append((links(a, b, percent), a, b))
                yield _found(found)

    return run


_FOUND = "src bigint, dst bigint, n bigint"


def similar_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id, n_links)`` for each row of ``docs(doc_id, text)``.

    Rows link where ``100 * intersection >= percent * union`` of their shingles; ``component_id`` is the least doc_id that links reach,
    ``n_links`` how many other rows a row links with.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    ranks = spark.sparkContext.broadcast(token_ranks(docs))
    kinds = "doc_id bigint, th bigint, n bigint, s1 bigint, s2 bigint, m1 bigint, m2 bigint, end_rank bigint, end_token bigint, first array<bigint>, rest array<int>"
    wide = materialize(keyed.mapInArrow(_sets(ranks, percent), kinds), "wide")
    sets = materialize(wide.select("doc_id", "n", "s1", "s2"), "sets")
    groups = materialize(token_groups(wide), "groups")
    discard(wide)
    members = groups.select("gid", F.size("members").alias("size"), F.explode("members").alias("m")).select("gid", "size", "m.*")
    members = materialize(members, "members")
    pairs = materialize(candidate_groups(groups, percent), "pairs")
    discard(groups)
    asked = pairs.select(F.explode(F.array("a", "b")).alias("gid")).distinct()
    wanted = members.filter("size > 1").unionByName(members.filter("size = 1").join(asked, "gid", "left_semi"))
    wanted = materialize(wanted.select("gid", "node", "copies", F.col("doc_id").alias("i"), F.col("th").alias("t")), "wanted")
    bits, size = _bitmap(wanted)
    likely = keyed.mapInArrow(_asked(spark.sparkContext.broadcast(bits), size), "doc_id bigint, text string, th bigint")
    same = (likely["th"] == wanted["t"]) & likely["doc_id"].eqNullSafe(wanted["i"])
    opened = likely.join(wanted, same).select("gid", "node", "copies", "text").repartition("gid").sortWithinPartitions("gid", "node")
    blocks = materialize(opened.mapInArrow(_blocks, _BLOCKS_SQL), "blocks")
    discard(wanted)
    inside = blocks.filter(F.size("node") > 1).mapInArrow(_within(percent), _FOUND)
    side = {s: blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in blocks.columns]) for s in "ab"}
    met = pairs.join(side["a"], F.col("a") == F.col("gid_a")).join(side["b"], F.col("b") == F.col("gid_b"))
    met = met.drop("a", "b", "gid_a", "gid_b")
    found = materialize(inside.unionByName(met.mapInArrow(_across(percent), _FOUND)), "found")
    for x in (blocks, pairs):
        discard(x)
    parts = connected_components(found.filter("dst is not null").select("src", "dst"))
    more = found.filter("dst is null").groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("more"))
    named = members.select("node", "s1", "s2", "least", "copies", "size").join(parts, "node", "left").join(more, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    # a set of a larger group has met itself already
    n_links = F.coalesce("more", F.lit(0)) + F.when(F.col("size") > 1, 0).otherwise(F.col("copies")) - 1
    classes = materialize(named.join(names, "component").select("s1", "s2", "component_id", n_links.alias("n_links")), "classes")
    for x in (found, members):
        discard(x)
    empty = sets.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links"))
    filled = sets.filter("n > 0").join(classes, ["s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    return filled.unionByName(empty)
