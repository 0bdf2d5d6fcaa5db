"""Operator 5: byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The pattern cuts a text into pieces, and a piece's ids depend on it alone. So the library encodes each different piece
once while it is kept; a text's ids are those of its pieces in order. The regex module cuts as the library's own engine
does, but knows later versions of Unicode: a text with a code point that is unassigned in Python's is encoded whole by the library.

A rank file gives each token's bytes and its rank. Its bytes are written in the printable alphabet of
byte-level BPE, and every way to cut a token into two tokens becomes a merge, ordered by the rank of what
it makes; so the library merges as the ranks say. A piece that is a token as a whole is that token.

Decoding joins the printable characters of the tokens and reverses the byte table over all of them at once. A token
may begin or end inside a character: offsets then name the whole character for each of its tokens, ``n_split``
counts the tokens that begin inside one, and decoding joins the bytes before anything reads them as UTF-8.

Defined results: null text is empty; empty text has no tokens; no special tokens are added or recognised; a text of
any length is encoded whole; repeated rows have equal results; other columns are not read.
"""

from __future__ import annotations

import base64
import os
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from tidemark.llm.words import slices


def byte_alphabet() -> list[str]:
    """The printable character for each byte: itself if printable in Latin-1, else one from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    place = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [place[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def unassigned() -> np.ndarray:
    """Of each code point, whether Python's Unicode has no character for it."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)])


#: Pieces that a process keeps the ids of, the characters of the longest, and those that the library gets at once.
PIECES, LONGEST, AT_ONCE = 1 << 18, 64, 1000


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        alphabet = byte_alphabet()

        def shown(token: bytes) -> str:
            return "".join(alphabet[b] for b in token)

        merges = []
        for token, rank in ranks.items():
            cuts = [(ranks[token[:i]], ranks[token[i:]], i) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += [(rank, *cut[:2], shown(token[: cut[2]]), shown(token[cut[2] :])) for cut in cuts]
        merges.sort()
        vocabulary = {shown(token): rank for token, rank in ranks.items()}
        model = models.BPE(vocab=vocabulary, merges=[m[3:] for m in merges], ignore_merges=True)
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), as_bytes])
        self.one_piece = Tokenizer(model)
        self.one_piece.pre_tokenizer = as_bytes
        self.known: dict[str, bytes] = {}
        self.cut, self.odd = regex.compile(pattern).findall, unassigned()
        size = max(ranks.values()) + 1
        self.tokens = [""] * size
        self.inside = np.zeros(size, bool)
        for token, rank in ranks.items():
            self.tokens[rank] = shown(token)
            self.inside[rank] = 0x80 <= token[0] < 0xC0
        self.byte_of = np.zeros(256 + 256, np.uint8)
        for byte, character in enumerate(alphabet):
            self.byte_of[ord(character)] = byte

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        cuts = [None if self._is_odd(text) else self.cut(text) for text in texts]
        different = set().union(*filter(None, cuts))
        new = [p for p in different if p not in self.known]
        if len(self.known) + len(new) > PIECES:
            self.known.clear()
            new = list(different)
        self._learn(new)
        found = [self._whole(text) if cut is None else np.frombuffer(b"".join(map(self.known.__getitem__, cut)), dtype="<u4") for text, cut in zip(texts, cuts, strict=True)]
        for p in new:
            if len(p) > LONGEST or len(different) > PIECES:
                del self.known[p]
        return found

    def _is_odd(self, text: str) -> bool:
        return not text.isascii() and bool(self.odd[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any())

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, pieces: list[str]) -> None:
        """Keep the ids of pieces, as bytes."""
        for start in range(0, len(pieces), AT_ONCE):
            some = pieces[start : start + AT_ONCE]
            for piece, coded in zip(some, self.one_piece.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[piece] = np.array(coded.ids, dtype="<u4").tobytes()

    def offsets(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """The characters that each token's bytes belong to, as (start, end)."""
        return [x.offsets for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens: their printable characters, through the byte table backwards."""
        characters = "".join(map(self.tokens.__getitem__, ids.tolist()))
        return self.byte_of[np.frombuffer(characters.encode("utf-16-le"), np.uint16)].tobytes()

    def split(self, ids: np.ndarray) -> int:
        """How many tokens begin inside a character."""
        return int(np.count_nonzero(self.inside[ids]))

    def decode_stream(self, ids: Iterator[int]) -> Iterator[str]:
        """Text piece by piece; a character whose bytes lie in several tokens comes with its last one."""
        held = b""
        for i in ids:
            held += self.decode(np.array([i]))
            cut = len(held)
            for back in range(1, min(4, len(held)) + 1):
                lead = held[-back]
                if lead < 0x80:
                    break
                if lead >= 0xC0:
                    if back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                        cut = len(held) - back
                    break
            yield held[:cut].decode(errors="replace")
            held = held[cut:]
        if held:
            yield held.decode(errors="replace")


_ready: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """The coder for a rank file, built once in each process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, pattern) not in _ready:
        _ready[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _ready[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode the texts of ``docs(doc_id, text)``.

    ``path`` names a rank file that every executor has. Returns ``(doc_id, ids binary, decoded binary, n_split)``;
    ids are little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for b in slices(batches, 64):
            ids = bpe.encode([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([x.tobytes() for x in ids], pa.binary()),
                    pa.array([bpe.decode(x) for x in ids], pa.binary()),
                    pa.array([bpe.split(x) for x in ids], pa.int64()),
                ],
                ["doc_id", "ids", "decoded", "n_split"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids binary, decoded binary, n_split bigint")


def token_offsets(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids array<int>, starts array<int>, ends array<int>)``: the characters of each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for b in slices(batches, 64):
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids, spans = bpe.encode(texts), bpe.offsets(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),
                    pa.array([[s for s, _ in x] for x in spans], pa.list_(pa.int32())),
                    pa.array([[e for _, e in x] for x in spans], pa.list_(pa.int32())),
                ],
                ["doc_id", "ids", "starts", "ends"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>, starts array<int>, ends array<int>")


def digests(encoded: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, n_split)`` of what ``encode`` returns."""
    return encoded.select(
        "doc_id",
        (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "n_split",
    )


__all__ = ["ByteBpe", "coder", "digests", "encode", "read_ranks", "token_offsets"]
