"""Operator 10: personal data and the terms that give it away.

Base matches are e-mail addresses, IP addresses, card numbers and phone numbers. Each match's value is a protected
entity. Over the whole corpus, terms that stand near an entity are counted with it, by documents; with n(t)
documents that hold term t, n(e) that hold entity e, n(t, e) where both stand together, of N, the
disclosure of e by t is

    log2(n(t, e) N / (n(e) n(t))) / log2(N / n(e)),

the share of the entity's information that the term gives away: 1 if all documents with the term name the
entity. A term stands near a match if at most ``NEAR - 1`` other terms are between them, whatever else is. Terms are
runs of three letters or more, or of two that are not ASCII. Terms seen with an entity in ``SUPPORT`` different texts that disclose ``GENERALISE`` of it are
generalised wherever they stand, from ``REMOVE`` on they are removed.

Counting n(t) reads every document, but moves only terms that may stand near an entity often enough; these are
told by a bitmap of a bounded size (a full bitmap costs speed, not results, as an exact join follows).

Defined results: null and empty texts have no spans; the work of a text is in proportion to its length, of any length;
matches of different kinds may overlap, terms never overlap base matches; ``sanitise`` replaces overlapping spans as
one, and rows that repeat are each rewritten; an empty table has no terms; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.words import slices
from tidemark.storage import materialize, scratch

KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
BASE = 4
SUPPORT = 2
GENERALISE = 0.8
REMOVE = 0.95
#: Terms on each side of a match that stand near it.
NEAR = 6
#: Bits of the bitmap of terms: 2 MiB to 32 MiB, whatever the corpus.
LEAST_BITS, MOST_BITS = 1 << 24, 1 << 28

_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}|[^\W\d_A-Za-z]{2}")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)``, sorted; each kind's matches are the leftmost that don't overlap."""
    out = []
    at, taken = text.find("@"), 0
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, 0, domain.end()))
            taken = domain.end()
        else:
            taken = max(taken, at + 1)
        at = text.find("@", max(at + 1, taken))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(kind: int, value: str) -> str:
    """The name under which a match's value is counted."""
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else ''.join(filter(str.isdigit, value))}"


def _hash(value: str) -> int:
    return xxhash.xxh64_intdigest(value) - (1 << 63)


def terms_outside(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """``(start, end)`` of the terms that overlap none of the sorted spans."""
    found = [m.span() for m in _TERM.finditer(text)]
    if not spans or not found:
        return found
    at = np.array(found)
    upto = np.maximum.accumulate([e for _, _, e in spans])  # the last end of the spans up to each
    before = np.searchsorted([s for s, _, _ in spans], at[:, 1], side="left")  # spans that start before the term's end
    free = np.append(0, upto)[before] <= at[:, 0]
    return [found[i] for i in np.flatnonzero(free).tolist()]


def _near_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, entity and term near it (term null: the entity alone)."""
    for b in slices(batches):
        rows = []
        for text in b.column("text").to_pylist():
            spans = base_spans(text or "")
            if not spans:
                continue
            terms = terms_outside(text, spans)
            starts, ends = [s for s, _ in terms], [e for _, e in terms]
            found = set()
            for start, kind, end in spans:
                e = _hash(entity(kind, text[start:end]))
                found.add((e, None))
                before, after = bisect_right(ends, start), bisect_left(starts, end)
                found |= {(e, _hash(text[s:t].lower())) for s, t in [*terms[max(0, before - NEAR) : before], *terms[after : after + NEAR]]}
            mark = _hash(text)
            rows += [(e, t, mark) for e, t in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["e", "t", "mark"])


def _bits(df: DataFrame) -> np.ndarray:
    """A bitmap of the terms' hashes, as bytes: 16 bits for each term and ``LEAST_BITS`` at least, ``MOST_BITS`` at most. The
    driver gets a row for each 64 bits of it."""
    n = df.select("t").distinct().count()
    size = max(LEAST_BITS, min(MOST_BITS, 1 << (16 * n).bit_length()))
    place = F.pmod("t", F.lit(size))
    words = df.select(F.floor(place / 64).cast("int").alias("w"), place.alias("p")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).toPandas()
    bits = np.zeros(size // 64, np.int64)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return bits.view(np.uint8)


class _Terms(dict):
    """Which lower-cased terms are in a bitmap, as hash or None; forgets all at a fixed number."""

    limit = 300_000

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    def __missing__(self, term: str) -> int | None:
        if len(self) >= self.limit:
            self.clear()
        h = _hash(term.lower())
        place = h % (8 * len(self.bits))
        self[term] = h = h if self.bits[place >> 3] >> (place & 7) & 1 else None
        return h


def _document_counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(shared.value)
        for b in batches:
            counts: Counter = Counter()
            for part in slices(iter([b])):
                for text in part.column("text").to_pylist():
                    counts.update({terms[w] for w in set(_TERM.findall(text or ""))} - {None})
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["t", "n"])

    return run


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """``(t, disclosure)``: hashes of terms and the most that each discloses of any entity, where that is
    ``GENERALISE`` or more."""
    spark = docs.sparkSession
    texts = docs.select("text")
    total = docs.count()
    marks = texts.mapInArrow(_near_terms, "e bigint, t bigint, mark bigint").groupBy("e", "t", "mark").agg(F.count("*").alias("n"))
    counts = materialize(marks.groupBy("e", "t").agg(F.sum("n").alias("n"), F.count("*").alias("texts")), "near")
    pairs = materialize(counts.filter((F.col("texts") >= SUPPORT) & F.col("t").isNotNull()).select("e", "t", F.col("n").alias("nte")), "pairs")
    shared = spark.sparkContext.broadcast(_bits(pairs))
    seen = texts.mapInArrow(_document_counts(shared), "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("nt"))
    entities = counts.filter("t is null").select("e", F.col("n").alias("ne"))
    n = F.lit(float(max(total, 1)))
    gain = F.log2(F.col("nte") * n / (F.col("ne") * F.col("nt")))
    information = F.log2(n / F.col("ne"))
    share = F.when(information > 0, gain / information).otherwise(F.lit(0.0))
    return (
        pairs.join(materialize(pairs.select("t").distinct().join(seen, "t"), "terms"), "t")
        .join(entities, "e")
        .groupBy("t")
        .agg(F.max(share).alias("disclosure"))
        .filter(F.col("disclosure") >= GENERALISE)
    )


def _found(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(shared.value)
        kinds = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
        likely = pa.struct([("t", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
        for b in slices(batches):
            base, more = [], []
            for text in b.column("text").to_pylist():
                text = text or ""
                spans = base_spans(text)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                likely_terms = {w for w in set(_TERM.findall(text)) if terms[w] is not None}
                found = terms_outside(text, spans) if likely_terms else []
                more.append([{"t": terms[w], "start": s, "end": e} for s, e in found if (w := text[s:e]) in likely_terms])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("at"), pa.array(base, pa.list_(kinds)), pa.array(more, pa.list_(likely))],
                ["doc_id", "at", "base", "likely"],
            )

    return run


_SPAN = "array<struct<start:int,kind:int,end:int>>"


def find_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, at, base, spans)`` for each row of ``docs(doc_id, text)``: arrays of (start, kind, end),
    ends exclusive, in code points; ``kind`` is a place in ``KINDS``; ``at`` is the hash of the text."""
    with scratch(docs.sparkSession) as made:
        terms = made.keep(materialize(disclosing_terms(docs), "disclosing"))
    shared = docs.sparkSession.sparkContext.broadcast(_bits(terms))
    rows = docs.select("doc_id", F.xxhash64("text").alias("at"), "text").mapInArrow(
        _found(shared), f"doc_id bigint, at bigint, base {_SPAN}, likely array<struct<t:bigint,start:int,end:int>>"
    )
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "found")
    likely = rows.select("row", F.explode("likely").alias("x")).select("row", "x.*")
    kind = F.when(F.col("disclosure") >= REMOVE, KINDS.index("remove")).otherwise(KINDS.index("generalise"))
    more = likely.join(terms, "t").groupBy("row").agg(F.collect_list(F.struct("start", kind.cast("int").alias("kind"), "end")).alias("more"))
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(_SPAN))))
    return rows.drop("likely").join(more, "row", "left").select("doc_id", "at", "base", spans.alias("spans"))


def listed(spans: str):
    """kind:start:end by start, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_generalised, n_removed)``."""

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:BASE]],
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
        count("generalise").alias("n_generalised"),
        count("remove").alias("n_removed"),
    )


def replaced(text: str | None, spans: list[dict] | None) -> str | None:
    """The text with base matches and generalised terms named by their kind, and removed terms left out."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], "" if KINDS[s["kind"]] == "remove" else f"<{'term' if s['kind'] >= BASE else KINDS[s['kind']]}>"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


#: Names that documents don't have.
_ID, _AT, _HASH, _SPANS = (f"__tidemark_{x}" for x in ("id", "at", "hash", "spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with its ``text`` rewritten, and ``n_chars`` with it where there is such a column."""
    found = find_spans(docs).filter(F.size("spans") > 0).select("doc_id", F.col("at").alias("_at"), "spans").distinct()
    names = docs.columns
    marked = _joined(docs, found).select(*[F.col(f"`{c}`") for c in names], _SPANS).toDF(*map(str, range(len(names))), _SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            new = [replaced(t, s) for t, s in zip(b.column(names.index("text")).to_pylist(), b.column(_SPANS).to_pylist(), strict=True)]
            columns = list(b.columns[: len(names)])
            columns[names.index("text")] = pa.array(new, pa.string())
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in new], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, list(map(str, range(len(names)))))

    return marked.mapInArrow(run, marked.drop(_SPANS).schema).toDF(*names)


def _joined(docs: DataFrame, found: DataFrame) -> DataFrame:
    right = found.select(F.col("doc_id").alias(_ID), F.col("_at").alias(_AT), F.col("spans").alias(_SPANS))
    left = docs.withColumn(_HASH, F.xxhash64("text"))
    return left.join(right, F.col("doc_id").eqNullSafe(F.col(_ID)) & (F.col(_HASH) == F.col(_AT)), "left").drop(_ID, _AT, _HASH)
