"""Operator 7: order-preserving packing of token sequences by dynamic programming.

Documents are dealt to tasks by ranges of doc_id and stay in that order. Inside a task the tokens form
one line that is cut into windows of at most ``SIZE`` tokens. Cuts may fall at document ends (free), at sentence
ends (a small penalty for the truncated document) and, where a sentence leaves no other choice, inside it (a
larger one). The cost of a window is its padding plus the penalty of its cut, so with f the least cost up to
a cut at t, ``f(t) = penalty(t) + SIZE - t + min(f(s) + s)`` over cuts s within ``SIZE``; a monotone queue keeps
that minimum, so each cut point is handled once. Each ``STRETCH`` tokens the windows that all best cuts so far
have in common are closed; as every later cut builds on one of those, the cuts of a task are the best of its
whole line, while it holds little more than a stretch and the document at hand. The last
window of a task may instead be cut into lengths that are powers of two, which take no padding.

Words are tokenized once per task: white space separates what the tokenizer treats apart, so ids of a word are
remembered (up to a fixed number, those in use before others), and those of the new words of a batch come from one call. ASCII marks at the
end of a word, behind a letter or digit, are a word of their own, as the tokenizer parts them there. The tokenizer's special tokens are recognised in texts, as it does by itself.

Defined results: null and empty texts have only the end id; repeated rows are packed as often as they occur;
rows without a doc_id come first, those with the same one in the order of a hash of their texts, also across tasks; a text of any length is
cut where it must be; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer, pre_tokenizers

from tidemark.llm.words import sized

SIZE = 2048
END_ID = 1
SENTENCE_PENALTY = 24
INSIDE_PENALTY = 192
STRETCH = 1 << 18
#: Bytes of text whose words are parted at once.
TEXT = 1 << 20
#: Farthest apart that two possible cuts may lie.
REACH = 1024

#: ASCII marks that no contraction begins with, behind a letter or digit and at the end of a word.
_MARKS = re.compile(rb"([!-&(-/:-@[-`{-~](?:(?<=[A-Za-z0-9].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[!-&(-/:-@[-`{-~]*)(?=\s|\Z)")
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


class Words(dict):
    """Ids of words as little-endian unsigned 32-bit integers. When there are many, those not asked for since the last time go."""

    limit = 150_000

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer = tokenizer
        self.older: dict[bytes, bytes] = {}
        # what is left of the tokenizer's steps for words of letters in lower case, between blanks
        self.plain = Tokenizer(tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )

    def learn(self, words: list[bytes]) -> None:
        """Keep the ids of new words, each given once."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.limit:
            self.older = dict(self) if len(self) <= self.limit else {}
            self.clear()
            new = words
        plain = []
        for word in new:
            ids = self.older.get(word)
            if ids is not None:
                self[word] = ids
            elif word.isalpha() or _LETTERS.fullmatch(word):
                plain.append(word)
            else:
                self[word] = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        # a mark between the words gives an id that letters never give
        text = b" ! ".join([b"", *plain, b""]).decode().lower()
        ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        cuts = (4 * np.flatnonzero(ids == ids[0])).tolist()
        raw = ids.tobytes()
        self.update(zip(plain, [raw[a + 4 : b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))


class Coder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        self.words = Words(tokenizer)
        self.ends = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
        for token, i in tokenizer.get_vocab().items():
            self.ends[i] = token.removesuffix("</w>")[-1:] in (".", "!", "?")

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
        """For each text its ids with the end id, and the places after sentence ends."""
        parts = pc.ascii_split_whitespace(pa.array(map(_parted, texts), pa.large_binary()).view(pa.large_string()))
        words = parts.flatten().dictionary_encode()
        different = words.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        self.words.learn(different)
        ids = pa.array(map(self.words.__getitem__, different), pa.large_binary()).take(words.indices)
        _, offsets, data = ids.buffers()
        joined = data.to_pybytes() if data else b""
        after = np.frombuffer(offsets, np.int64, len(ids) + 1) // 4
        stops = after[parts.offsets.to_numpy()[1:]].tolist()
        after = after[1:][np.diff(after) > 0]
        after = after[self.ends[np.frombuffer(joined, "<u4")[after - 1]]]
        cuts = np.searchsorted(after, stops, side="right").tolist()
        out, low, first, end = [], 0, 0, END_ID.to_bytes(4, "little")
        for high, last in zip(stops, cuts, strict=True):
            out.append((joined[4 * low : 4 * high] + end, after[first:last] - low))
            low, first = high, last
        return out


def _parted(text: bytes) -> bytes:
    """A to Z in lower case, as the tokenizer does first, and a blank before marks that end a word; but not where
    that could hide a special token, make one, or make a letter that joins with a combining mark (of U+0300 to
    U+036F) in lower case only."""
    if b"<|" in text:
        return text
    parted = _MARKS.sub(rb" \1", text)
    return parted if b"\xcc" in text or b"\xcd" in text else parted.lower()


_ready: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _ready:
        _ready[path] = Coder(path)
    return _ready[path]


def cut_points(lengths: np.ndarray, sentences: list[np.ndarray], carried: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where the line may be cut, ascending from 0, and their penalties. The first document
    has lost ``carried`` tokens to the window before."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    inner = np.concatenate([s + starts[i] - (carried if i == 0 else 0) for i, s in enumerate(sentences)])
    place = np.concatenate([[0], ends, inner[inner > 0]]).astype(np.int64)
    cost = np.full(len(place), SENTENCE_PENALTY, np.int64)
    cost[: len(ends) + 1] = 0
    order = np.lexsort((cost, place))
    place, cost = place[order], cost[order]
    once = np.append(True, place[1:] != place[:-1])
    place, cost = place[once], cost[once]
    gaps = np.diff(place)
    if len(gaps) and gaps.max() > REACH:
        wide = np.flatnonzero(gaps > REACH)
        more = np.concatenate([np.arange(place[i] + REACH, place[i + 1], REACH) for i in wide])
        place = np.concatenate([place, more])
        cost = np.concatenate([cost, np.full(len(more), INSIDE_PENALTY, np.int64)])
        order = np.argsort(place, kind="stable")
        place, cost = place[order], cost[order]
    return place, cost


def transitions(place: np.ndarray, cost: np.ndarray, size: int = SIZE) -> list[int]:
    """For each place the one before it on the cheapest way there from the first."""
    at, penalty = place.tolist(), cost.tolist()
    n = len(at)
    before = [0] * n
    queue, head = [0], 0
    value = [at[0]] + [0] * (n - 1)
    for j in range(1, n):
        t = at[j]
        low = t - size
        while at[queue[head]] < low:
            head += 1
        before[j] = i = queue[head]
        value[j] = v = penalty[j] + size + value[i]
        while len(queue) > head and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    return before


def path_to(j: int, before: list[int]) -> list[int]:
    cuts = [j]
    while j:
        j = before[j]
        cuts.append(j)
    return cuts[::-1]


def best_cuts(place: np.ndarray, cost: np.ndarray, size: int = SIZE) -> list[int]:
    """Indices of the cuts of least cost, from the first place to the last."""
    return path_to(len(place) - 1, transitions(place, cost, size))


def settled_cuts(place: np.ndarray, cost: np.ndarray, size: int = SIZE) -> list[int]:
    """Indices of the cuts that stay the best whatever follows the last place: those on the cheapest ways
    to all places that a later window may begin at."""
    before = transitions(place, cost, size)
    ways = set(np.flatnonzero(place > place[-1] - size).tolist())
    while len(ways) > 1:
        last = max(ways)
        ways.remove(last)
        ways.add(before[last])
    return path_to(ways.pop(), before)


def tail_lengths(n: int) -> list[int]:
    """Lengths of the last windows: one with padding, or powers of two if cutting costs less."""
    powers = [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]
    return powers if (len(powers) - 1) * INSIDE_PENALTY < SIZE - n else [n]


_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")
SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, ids binary"
)


class _Line:
    """The documents of a task that are not yet in a closed window."""

    def __init__(self, first_sequence: int, keep_ids: bool) -> None:
        self.docs: list[tuple] = []  # doc_id, ids, sentence ends
        self.carried = 0  # tokens of the first document that are in closed windows
        self.tokens = 0
        self.next_close = STRETCH
        self.sequence = first_sequence
        self.keep_ids = keep_ids

    def add(self, doc_id: int | None, ids: bytes, sentences: np.ndarray) -> None:
        self.docs.append((doc_id, ids, sentences))
        self.tokens += len(ids) // 4

    def close(self, last: bool) -> list[tuple]:
        """Rows of the windows that are closed now: those that are settled, or all."""
        if not self.tokens:
            return []
        lengths = np.array([len(d[1]) // 4 for d in self.docs], np.int64)
        lengths[0] -= self.carried
        place, cost = cut_points(lengths, [d[2] for d in self.docs], self.carried)
        edges = [int(place[i]) for i in (best_cuts if last else settled_cuts)(place, cost)]
        if last:
            for n in tail_lengths(edges.pop() - edges[-1]):
                edges.append(edges[-1] + n)
        return self._rows(edges, lengths)

    def _rows(self, edges: list[int], lengths: np.ndarray) -> list[tuple]:
        rows, ends = [], np.cumsum(lengths).tolist()
        doc, at = 0, 0
        for low, high in zip(edges, edges[1:], strict=False):
            while at < high:
                doc_id, ids, _ = self.docs[doc]
                total = len(ids) // 4
                stop = min(high, ends[doc])
                start = total - (ends[doc] - at)
                piece = ids[4 * start : 4 * (start + stop - at)]
                rows.append((doc_id, start, stop - at, zlib.crc32(piece), total, self.sequence, at - low, piece if self.keep_ids else None))
                at = stop
                if stop == ends[doc]:
                    doc += 1
            self.sequence += 1
        if doc < len(self.docs):
            self.carried = len(self.docs[doc][1]) // 4 - (ends[doc] - at)
        else:
            self.carried = 0
        self.docs = self.docs[doc:]
        self.tokens -= at
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(_COLUMNS))


def pack(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """Pack ``docs(doc_id, text)`` with the tokenizer file at ``path``, which every executor has: a row for
    each piece of a document, with its sequence and its offset there. Each sequence is padded to ``SIZE`` tokens
    unless its length is a power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        line = _Line(TaskContext.get().partitionId() << 36, keep_ids)
        for b in sized(batches, "text", TEXT):
            rows = []
            found = own.encode([t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()])
            for doc_id, (ids, sentences) in zip(b.column("doc_id").to_pylist(), found, strict=True):
                line.add(doc_id, ids, sentences)
                if line.tokens >= line.next_close:
                    rows += line.close(last=False)
                    line.next_close = line.tokens + STRETCH
            if rows:
                yield _batch(rows)
        rows = line.close(last=True)
        if rows:
            yield _batch(rows)

    # rows of one id, or without any, are ranges of their own by a hash of their texts
    order = ["doc_id", "_tie"]
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie")).repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select("doc_id", "text").mapInArrow(run, SCHEMA)
