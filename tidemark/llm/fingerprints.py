"""Operator 1: document fingerprints as invertible Bloom lookup sketches, in SQL expressions only.

A text's paragraphs (its lines that are not blank) become 64-bit digests. A sketch deals each digest
to one cell of each of three tables; a cell holds a count and the sums of the digest's two halves and
of a check value. Two sketches subtract cell by cell; what both texts hold cancels, and the rest is
peeled: a cell whose sums are ``count`` times one digest with the right check value gives that digest,
which is then taken out of its other cells. If cells are left over, the pair is retried with a sketch
four times as large (and other hash seeds), dealt into blocks of cells that are peeled on their own,
so that the work stays proportional to the paragraphs of a document. Pairs that no size peels (none is known) are
settled by counting their digests.

Defined results: a null text counts as empty; an empty text, or one of blank lines, has a sketch of
zeros; two such texts have likeness 1. Repeated paragraphs count as often as they occur; rows that repeat, or tie on
doc_id, are each a document, those that tie in the order of their texts; a text of any length is one sketch of
fixed size; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.order import with_next
from tidemark.storage import materialize

#: Cells of a block, in three tables of a third each.
CELLS = 24
#: Digests that a block of a retry gets on average.
LOAD = 8
#: Rounds of peeling; each takes out every pure cell at once.
ROUNDS = 14
LEVELS = 9

_MASK = 0xFFFFFFFF
_CELL = "named_struct('c', {c}, 'hi', {hi}, 'lo', {lo}, 'ck', {ck})"
_ZERO = _CELL.format(c="0L", hi="0L", lo="0L", ck="0L")


def paragraphs(text: Column) -> Column:
    """Digests of the lines of a text that are not blank."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.trim(x)) > 0)
    return F.transform(lines, lambda x: F.xxhash64(x))


def _hi(key: str) -> str:
    return f"(shiftrightunsigned({key}, 32) & {_MASK}L)"


def _lo(key: str) -> str:
    return f"({key} & {_MASK}L)"


def _check(hi: str, lo: str) -> str:
    return f"(xxhash64({hi}, {lo}, 'check') & 2147483647L)"


def _places(hi: str, lo: str, level: int) -> list[str]:
    third = CELLS // 3
    h = f"xxhash64({hi}, {lo}, {level})"
    return [f"cast({j * third} + pmod(shiftrightunsigned({h}, {16 * j}), {third}) as int)" for j in range(3)]


def _sketch(keys: str) -> str:
    """SQL for the cells of an array of digests, at level 0."""
    hi, lo = "d.hi", "d.lo"
    digests = (
        f"transform(transform({keys}, k -> named_struct('hi', {_hi('k')}, 'lo', {_lo('k')})), d -> named_struct("
        f"'hi', d.hi, 'lo', d.lo, 'ck', {_check(hi, lo)}, "
        + ", ".join(f"'i{j}', {p}" for j, p in enumerate(_places(hi, lo, 0)))
        + "))"
    )
    into = _CELL.format(c="a.c + 1L", hi="a.hi + p.hi", lo="a.lo + p.lo", ck="a.ck + p.ck")
    return (
        f"transform(array({digests}), ds -> transform(sequence(0, {CELLS - 1}), i -> aggregate(ds, {_ZERO}, "
        f"(a, p) -> if(p.i0 = i or p.i1 = i or p.i2 = i, {into}, a))))[0]"
    )


def _subtract(left: str, right: str) -> str:
    cell = _CELL.format(c="x.c - y.c", hi="x.hi - y.hi", lo="x.lo - y.lo", ck="x.ck - y.ck")
    return f"zip_with({left}, {right}, (x, y) -> {cell})"


def _pure(cells: str, level: int) -> str:
    """SQL for the digests that stand alone in a cell, each once, with their counts and places."""
    alone = f"filter({cells}, x -> x.c <> 0 and x.hi % x.c = 0 and x.lo % x.c = 0)"
    halves = f"transform({alone}, x -> named_struct('c', x.c, 'hi', x.hi div x.c, 'lo', x.lo div x.c, 'ck', x.ck))"
    sound = f"filter({halves}, x -> x.hi >= 0 and x.lo >= 0 and {_check('x.hi', 'x.lo')} * x.c = x.ck)"
    places = ", ".join(f"'i{j}', {p}" for j, p in enumerate(_places("x.hi", "x.lo", level)))
    return f"transform(array_distinct({sound}), x -> named_struct('c', x.c, 'hi', x.hi, 'lo', x.lo, 'ck', x.ck, {places}))"


def peel(cells: str, level: int) -> str:
    """SQL for ``struct(ok, digests)``: the signed digests that the cells give up, and whether none is left."""
    less = _CELL.format(c="a.c - p.c", hi="a.hi - p.c * p.hi", lo="a.lo - p.c * p.lo", ck="a.ck - p.ck")
    without = (
        "transform(s.cells, (x, i) -> aggregate(filter(s.pure, p -> p.i0 = i or p.i1 = i or p.i2 = i), x, "
        f"(a, p) -> {less}))"
    )
    out = "concat(s.out, transform(s.pure, p -> named_struct('c', p.c, 'digest', shiftleft(p.hi, 32) | p.lo)))"
    step = (
        f"transform(array({without}), z -> named_struct('cells', z, 'pure', {_pure('z', level)}, 'out', {out}))[0]"
    )
    start = (
        f"transform(array({cells}), z -> named_struct('cells', z, 'pure', {_pure('z', level)}, "
        "'out', cast(array() as array<struct<c:bigint,digest:bigint>>)))[0]"
    )
    return (
        f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> if(size(s.pure) = 0, s, {step}), "
        "s -> named_struct('ok', not exists(s.cells, x -> x.c <> 0 or x.hi <> 0 or x.lo <> 0 or x.ck <> 0), 'digests', s.out))"
    )


def _text(cells: str) -> str:
    return f"array_join(transform({cells}, x -> concat_ws('.', hex(x.c), hex(x.hi), hex(x.lo), hex(x.ck))), '-')"


def sketches(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the fingerprint string of column ``text``."""
    keyed = df.withColumn("_keys", paragraphs(F.col(text)))
    return keyed.withColumn(out, F.expr(_text(_sketch("_keys")))).drop("_keys")


def difference(pairs: DataFrame) -> DataFrame:
    """Digests in which two versions differ, for ``pairs(pair, ka, kb)``: an id without nulls or repeats
    and the paragraph digests of both. Returns ``(pair, digests)`` with signed counts: more in ``ka``
    is positive."""
    done = []
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that few bytes don't mean few tasks
    first = pairs.withColumn("_p", F.expr(peel(_subtract(_sketch("ka"), _sketch("kb")), 0)))
    state = materialize(first, "peel0")
    done.append(state.filter("_p.ok").select("pair", F.col("_p.digests").alias("digests")))
    rest = state.filter("not _p.ok").select("pair", "ka", "kb")
    for level in range(1, LEVELS):
        blocks = f"greatest(1, cast(ceil((size(ka) + size(kb)) / {LOAD}) as int)) * {4 ** (level - 1)}"
        both = "concat(transform(ka, k -> named_struct('k', k, 's', 1L)), transform(kb, k -> named_struct('k', k, 's', -1L)))"
        spread = (
            rest.repartition(n, "pair")
            .select("pair", F.expr(blocks).alias("blocks"), F.explode(F.expr(both)).alias("d"))
            .select("pair", "blocks", F.expr("d.s").alias("s"), F.expr(_hi("d.k")).alias("hi"), F.expr(_lo("d.k")).alias("lo"))
            .withColumn("block", F.expr(f"pmod(xxhash64(hi, lo, 'block', {level}), blocks)"))
            .withColumn("ck", F.expr(_check("hi", "lo")))
            .withColumn("cell", F.explode(F.expr("array(" + ", ".join(_places("hi", "lo", level)) + ")")))
        )
        cells = spread.groupBy("pair", "block", "cell").agg(
            F.sum("s").alias("c"), *[F.sum(F.col("s") * F.col(x)).alias(x) for x in ("hi", "lo", "ck")]
        )
        listed = cells.groupBy("pair", "block").agg(F.collect_list(F.struct("cell", "c", "hi", "lo", "ck")).alias("l"))
        dense = (
            f"transform(sequence(0, {CELLS - 1}), i -> aggregate(filter(l, x -> x.cell = i), {_ZERO}, (a, x) -> "
            + _CELL.format(c="x.c", hi="x.hi", lo="x.lo", ck="x.ck")
            + "))"
        )
        peeled = listed.select("pair", F.expr(peel(dense, level)).alias("_p"))
        got = materialize(
            peeled.groupBy("pair").agg(
                F.every(F.col("_p.ok")).alias("ok"), F.flatten(F.collect_list("_p.digests")).alias("digests")
            ),
            f"peel{level}",
        )
        done.append(got.filter("ok").select("pair", "digests"))
        if got.filter("not ok").isEmpty():
            break
        rest = rest.join(got.filter("not ok").select("pair"), "pair", "left_semi")
    else:
        done.append(_counted(rest))
    return reduce(DataFrame.unionByName, done)


def _counted(pairs: DataFrame) -> DataFrame:
    """``(pair, digests)`` by counting the digests of both sides, without sketches."""
    both = "concat(transform(ka, k -> named_struct('k', k, 's', 1L)), transform(kb, k -> named_struct('k', k, 's', -1L)))"
    each = pairs.select("pair", F.explode(F.expr(both)).alias("d")).groupBy("pair", F.col("d.k").alias("digest")).agg(F.sum("d.s").alias("c"))
    differ = F.when(F.col("c") != 0, F.struct("c", "digest"))
    return each.groupBy("pair").agg(F.collect_list(differ).alias("digests"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprint each text, its edited text and the next document's.

    The next document follows by descending doc_id; after the last comes the first. The edited text is
    the text with its last floor(n/2) code points replaced by the first as many (or all) of the next
    document's. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_paragraphs, digests_edited (how many digests differ). One row for each input row.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text").cast("bigint")
    half = (n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.col("next"), F.lit(1), half))
    rows = (
        with_next(base, "doc_id", "text", "next")
        .withColumn("edited", edited)
        .select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            n.alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            paragraphs(F.col("text")).alias("ka"),
            paragraphs(F.col("edited")).alias("ke"),
            paragraphs(F.col("next")).alias("kn"),
        )
    )
    rows = materialize(rows, "paragraphs")
    pairs = rows.select((F.col("row") * 2).alias("pair"), "ka", F.col("ke").alias("kb")).unionByName(
        rows.select((F.col("row") * 2 + 1).alias("pair"), "ka", F.col("kn").alias("kb"))
    )
    count = F.aggregate("digests", F.lit(0).cast("bigint"), lambda a, x: a + F.abs(x["c"]))
    found = difference(pairs).select(F.expr("pair div 2").alias("row"), (F.col("pair") % 2).alias("kind"), count.alias("n"))
    counts = found.groupBy("row").agg(
        F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("de"), F.max(F.when(F.col("kind") == 1, F.col("n"))).alias("dn")
    )

    def likeness(other: str, differ: str) -> Column:
        total = F.size("ka") + F.size(other)
        return F.when(total == 0, F.lit(1.0)).otherwise((total - F.col(differ)) / (total + F.col(differ)))

    return rows.join(counts, "row").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.expr(_text(_sketch("ka"))).alias("fingerprint"),
        F.expr(_text(_sketch("ke"))).alias("edited_fingerprint"),
        likeness("ke", "de").alias("near_edited"),
        likeness("kn", "dn").alias("near_next"),
        F.size("ka").cast("bigint").alias("n_paragraphs"),
        F.col("de").alias("digests_edited"),
    )
