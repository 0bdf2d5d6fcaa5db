"""Operator 13: fill-in-the-middle transformation, its cuts located by memoized chunks.

A text is cut into lines; two of its line ends, drawn from a hash of the doc_id, divide it into prefix, middle and suffix, which
are put in another order behind marks. The line ends are found without looking at each text's every line anew: a rolling
hash of the last 32 bytes ends a chunk where its low bits are zero, so equal passages give equal chunks in
whatever text they stand. Each distinct chunk is summarised once: where its lines end, code points up to there, its first
and last bytes and whether a mark is inside. Summaries wait in a cache of bounded size whose key is the chunk's content, so a
hit is verified by all of its bytes. Running sums of the chunks' counts give a text's units and code points, and lead to
the chunk in which a cut falls; a mark across the border of chunks is found by their first and last bytes.

The work is one pass over the documents without a shuffle; a task holds a batch of texts and the cache.

Defined results: null text is empty; an empty text and one that contains a mark stay plain; texts of any length are read
whole; equal rows give equal results; a missing doc_id counts as an empty one in the hash; an empty table stays empty; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.words import mix, sized

SEED = 7
#: Per cent of the documents that are transformed, and of those that put the suffix first.
RATE, SUFFIX_FIRST = 100, 50
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_MARKS = (PREFIX, SUFFIX, MIDDLE)

#: A chunk ends where so many low bits of the rolling hash are zero; it has LEAST bytes at least (but for the last of a text) and MOST at most.
BITS, LEAST, MOST = 10, 256, 8192
#: Bytes of chunks in the cache of a task.
CACHE = 16 << 20

_GEAR = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
#: Bytes that are hashed at once.
_BLOCK = 1 << 20


def chunk_ends(text: bytes) -> list[int]:
    """Where chunks end; a place depends on the bytes since the chunk's start only."""
    raw = np.frombuffer(text, np.uint8)
    found = []
    for low in range(0, len(raw), _BLOCK):
        first = max(0, low - 31)
        h = _GEAR[raw[first : low + _BLOCK]]
        for width in (1, 2, 4, 8, 16):  # a byte leaves the 32-bit sum after 32 doublings
            h[width:] += h[:-width] << np.uint32(width)
        # a byte's weight doubles with each that follows, so low bits see the last bytes only and high bits see all 32
        found.append(np.flatnonzero((h >> np.uint32(32 - BITS))[low - first :] == 0) + low + 1)
    marks = np.concatenate(found) if found else np.zeros(0, np.int64)
    ends, at = [], 0
    while at < len(raw):
        i = int(np.searchsorted(marks, at + LEAST))
        at = min(int(marks[i]) if i < len(marks) else len(raw), at + MOST, len(raw))
        ends.append(at)
    return ends


class Summary(NamedTuple):
    """What the whole text needs to know of a chunk."""

    chars: int
    ends: np.ndarray  # bytes up to and with each line feed
    chars_at: np.ndarray  # code points up to there
    head: bytes
    tail: bytes
    marked: bool


_EDGE = len(PREFIX) - 1


def summarise(chunk: bytes) -> Summary:
    raw = np.frombuffer(chunk, np.uint8)
    ends = np.flatnonzero(raw == 10) + 1
    begins = (raw & 0xC0) != 0x80  # a code point begins here
    upto = np.cumsum(begins)
    return Summary(int(upto[-1]), ends, upto[ends - 1], chunk[:_EDGE], chunk[-_EDGE:], any(m in chunk for m in _MARKS))


class Memo:
    """Summaries by content; the longest unused go when the chunks take more than ``most`` bytes."""

    def __init__(self, most: int = CACHE) -> None:
        self.most, self.bytes, self.hits, self.misses = most, 0, 0, 0
        self.known: OrderedDict[bytes, Summary] = OrderedDict()

    def __call__(self, chunk: bytes) -> Summary:
        found = self.known.get(chunk)
        if found is not None:
            self.hits += 1
            self.known.move_to_end(chunk)
            return found
        self.misses += 1
        found = self.known[chunk] = summarise(chunk)
        self.bytes += len(chunk)
        while self.bytes > self.most:
            self.bytes -= len(self.known.popitem(last=False)[0])
        return found


class Located:
    """A text's units and code points from the summaries of its chunks."""

    def __init__(self, text: bytes, memo: Memo) -> None:
        stops = chunk_ends(text)
        self.starts = [0, *stops[:-1]] if stops else []
        self.parts = [memo(text[a:b]) for a, b in zip(self.starts, stops, strict=True)]
        self.lines = np.cumsum([0, *(len(p.ends) for p in self.parts)])
        self.chars = np.cumsum([0, *(p.chars for p in self.parts)])
        self.size = len(text)
        self.n = int(self.lines[-1]) + bool(text and not text.endswith(b"\n"))
        before, self.marked = b"", False
        for p in self.parts:
            self.marked |= p.marked or any(m in before + p.head for m in _MARKS)
            before = (before + p.tail)[-_EDGE:]

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points of the first ``units`` units."""
        if units == 0:
            return 0, 0
        if units > self.lines[-1]:
            return self.size, int(self.chars[-1])
        at = int(np.searchsorted(self.lines, units)) - 1
        i = units - int(self.lines[at]) - 1
        return self.starts[at] + int(self.parts[at].ends[i]), int(self.chars[at]) + int(self.parts[at].chars_at[i])


def draws(doc_id: int | None, seed: int) -> list[int]:
    """The first four 8-digit groups of the hash of seed and doc_id."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def restored(output: bytes, form: str) -> bytes:
    """The text that ``output`` was made from."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    body = output[len(first) :]
    a, rest = body.split(second, 1)
    b, middle = rest.split(MIDDLE, 1)
    return b + middle + a if form == "spm" else a + middle + b


def _transformed(seed: int, rate: int, suffix_first: int, cache: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(cache)
        for b in sized(batches, "text"):
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                text = text or b""
                where = Located(text, memo)
                h = draws(doc_id, seed)
                if not text or where.marked or h[2] % 100 >= rate:
                    out.append((where.n, "plain", None, None, text))
                    continue
                low, high = sorted((h[0] % (where.n + 1), h[1] % (where.n + 1)))
                (p, p_chars), (m, m_chars) = where.cut(low), where.cut(high)
                if h[3] % 100 < suffix_first:
                    made = ("spm", (SUFFIX, text[m:], PREFIX, text[:p]))
                else:
                    made = ("psm", (PREFIX, text[:p], SUFFIX, text[m:]))
                out.append((where.n, made[0], p_chars, m_chars - p_chars, b"".join((*made[1], MIDDLE, text[p:m]))))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    *[pa.array([x[i] for x in out], kind) for i, kind in ((0, pa.int64()), (1, pa.string()), (2, pa.int64()), (3, pa.int64()))],
                    pa.array([x[4] for x in out], pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, cache: int = CACHE) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` for each row of ``docs(doc_id, text)``.

    ``rate`` per cent of the documents are transformed, ``suffix_first`` per cent of those in the order suffix, prefix, middle; ``cache``
    bounds the bytes of chunks that a task remembers. Results depend on doc_id, text, seed and rates only.
    """
    kinds = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return docs.select("doc_id", "text").mapInArrow(_transformed(seed, rate, suffix_first, cache), kinds)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sized(batches, "output"):
        outputs = b.column("output").cast(pa.binary()).to_pylist()
        forms = b.column("form").to_pylist()
        sha = [hashlib.sha256(x).hexdigest() for x in outputs]
        back = [s if f == "plain" else hashlib.sha256(restored(x, f)).hexdigest() for x, f, s in zip(outputs, forms, sha, strict=True)]
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
        yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(sha), pa.array(back)], [*names, "output_sha256", "restored_sha256"])


def digests(found: DataFrame) -> DataFrame:
    """Hashes of the outputs and of the texts that are rebuilt from them alone."""
    kinds = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"
    return found.mapInArrow(_digested, kinds)
