"""Document fingerprints as invertible Bloom lookup tables over paragraph digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabproof.llm.common import measured, whole_text

#: Cells of a fingerprint, a third for each hash function. A failed comparison goes on with more.
CELLS = 36
GROWTH, TRIES, ROUNDS = 4, 9, 40
#: Lines that are cut, and where: short texts have few lines, and a changed end should not hide an equal start.
CUT_LINES, CUTS = 2, (0, 40, 160, 640, 2560, 10_240)
#: Ids of a slice in which documents see the next one.
SLICE = 1000
#: Slices whose first ids are broadcast at most; beyond that they are joined by shuffle.
BROADCAST_SLICES = 200_000

#: A cell that is not empty: its place, the count, the xor of the digests and the xor of their checks.
_CELL = "struct<c:bigint,n:int,k:bigint,h:int>"
_CELLS = f"array<{_CELL}>"


def paragraph_digests(text: Column) -> Column:
    """Distinct digests of a text's paragraphs: its lines; the first few in pieces of growing length."""
    cuts = list(zip(CUTS, [*CUTS[1:], None]))

    def pieces(line: Column, i: Column) -> Column:
        cut = [F.substring(line, a + 1, b - a if b else 2**31 - 1) for a, b in cuts]
        return F.when(i < CUT_LINES, F.filter(F.array(*cut), lambda p: p != "")).otherwise(F.array(line))

    lines = F.flatten(F.transform(F.split(text, "\n"), pieces))
    return F.array_distinct(F.transform(F.filter(lines, lambda p: p != ""), lambda p: F.xxhash64(p)))


def _cell(c: Column, n: Column, k: Column, h: Column) -> Column:
    return F.struct(c.alias("c"), n.cast("int").alias("n"), k.alias("k"), h.alias("h"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _entries(digests: Column, sign: int, cells: Column) -> Column:
    """Each digest alone in its three cells, one in each third of the table."""
    width = F.floor(cells / 3)

    def places(d: Column) -> Column:
        spread = (d, F.shiftrightunsigned(d, 21), F.shiftrightunsigned(d, 42))
        return F.array(*[_cell(F.pmod(x, width) + i * width, F.lit(sign), d, F.hash(d)) for i, x in enumerate(spread)])

    return F.flatten(F.transform(digests, places))


def _merged(entries: Column) -> Column:
    """Cells summed by place; those that come out empty are left out.

    Sorted entries of one place stand together, so each cell sums one slice: no entry is copied twice.
    """
    def starts(s: Column) -> Column:
        first = lambda i: (i == 0) | (F.get(s, i)["c"] != F.get(s, i - 1)["c"])
        return F.when(F.size(s) > 0, F.filter(F.sequence(F.lit(0), F.size(s) - 1), first)).otherwise(F.array().cast("array<int>"))

    def add(one: Column, x: Column) -> Column:
        return _cell(x["c"], one["n"] + x["n"], one["k"].bitwiseXOR(x["k"]), one["h"].bitwiseXOR(x["h"]))

    def cells(s: Column, at: Column) -> Column:
        nothing = _cell(F.lit(0).cast("bigint"), F.lit(0), F.lit(0).cast("bigint"), F.lit(0)).cast(_CELL)

        def cell(start: Column, j: Column) -> Column:
            end = F.coalesce(F.get(at, j + 1), F.size(s))
            return F.aggregate(F.slice(s, start + 1, end - start), nothing, add)

        return F.filter(F.transform(at, cell), lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["h"] != 0))

    return _let(F.sort_array(entries), lambda s: _let(starts(s), lambda at: cells(s, at)))


def table_of(digests: Column, cells: Column) -> Column:
    """The lookup table of a set of digests, without its empty cells."""
    return _merged(_entries(digests, 1, cells))


def subtracted(one: Column, other: Column) -> Column:
    """Cell by cell, so that digests in both tables leave no trace."""
    return _merged(F.concat(one, F.transform(other, lambda c: _cell(c["c"], -c["n"], c["k"], c["h"]))))


def peeled(difference: Column, cells: Column) -> Column:
    """Number of signed digests that a difference of tables gives up; -1 unless it gives up all.

    A cell with one digest left names it; taking it out of its other cells leaves more such cells.
    """
    state = f"struct<table:{_CELLS},found:bigint,stuck:boolean>"

    def named(table: Column, sign: int) -> Column:
        alone = F.filter(table, lambda c: (c["n"] == sign) & (F.hash(c["k"]) == c["h"]))
        return F.array_distinct(F.transform(alone, lambda c: c["k"]))

    def peel(s: Column, keys: Column) -> Column:
        left, right = keys["left"], keys["right"]
        rest = _merged(F.concat(s["table"], _entries(left, -1, cells), _entries(right, 1, cells)))
        count = (F.size(left) + F.size(right)).cast("bigint")
        moved = F.struct(rest.alias("table"), (s["found"] + count).alias("found"), F.lit(False).alias("stuck"))
        stuck = F.struct(s["table"].alias("table"), s["found"].alias("found"), F.lit(True).alias("stuck"))
        return F.when(count == 0, stuck).otherwise(moved)

    def look(s: Column, _: Column) -> Column:
        keys = F.struct(named(s["table"], 1).alias("left"), named(s["table"], -1).alias("right"))
        return F.when(s["stuck"] | (F.size(s["table"]) == 0), s).otherwise(_let(keys, lambda k: peel(s, k)))

    start = F.struct(difference.alias("table"), F.lit(0).cast("bigint").alias("found"), F.lit(False).alias("stuck")).cast(state)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, look,
        lambda s: F.when(F.size(s["table"]) == 0, s["found"]).otherwise(F.lit(-1).cast("bigint")),
    )


def differing(one: Column, other: Column, one_table: Column, other_table: Column) -> Column:
    """Number of digests in one of two sets only.

    The tables of ``CELLS`` are subtracted and peeled; on failure both sets are tabled anew with
    ``GROWTH`` times the cells, and so on. Should the last table fail too, the sets are compared.
    """
    def attempt(difference: Column, cells: Column) -> Column:
        return F.struct(cells.alias("cells"), peeled(difference, cells).alias("n"))

    def again(s: Column, _: Column) -> Column:
        larger = _let(
            s["cells"] * GROWTH, lambda cells: attempt(subtracted(table_of(one, cells), table_of(other, cells)), cells)
        )
        return F.when(s["n"] >= 0, s).otherwise(larger)

    exact = (F.size(F.array_except(one, other)) + F.size(F.array_except(other, one))).cast("bigint")
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(TRIES)), attempt(subtracted(one_table, other_table), F.lit(CELLS).cast("bigint")), again,
        lambda s: F.when(s["n"] >= 0, s["n"]).otherwise(exact),
    )


def likeness(one: Column, other: Column, differ: Column) -> Column:
    """Share of all digests that both sets hold, 1 for two empty sets, from how many differ."""
    sizes = F.size(one) + F.size(other)
    return F.when(sizes == 0, F.lit(1.0)).otherwise((sizes - differ) / (sizes + differ))


def written(table: Column, digests: Column) -> Column:
    """A table as text: number of digests, then place, count, digests and checks of each cell that is not empty."""
    parts = F.transform(
        table,
        lambda c: F.concat_ws(":", c["c"].cast("string"), c["n"].cast("string"), F.hex(c["k"]), F.hex(c["h"].bitwiseAND(F.lit(0xFFFFFFFF)))),
    )
    return F.concat_ws(";", F.size(digests).cast("string"), F.array_join(parts, ";"))


def _slice(key: str) -> Column:
    return F.expr(f"({key} - pmod({key}, {SLICE}L)) div {SLICE}L")


def following(keys: DataFrame, low: int, high: int) -> DataFrame:
    """``(key, next)``: the next larger key of distinct whole numbers between ``low`` and ``high``; null for the last.

    Keys see each other within slices of ``SLICE`` numbers. Where a slice ends, the first key of the next
    slice comes next, which is the same question about a thousandth of the range.
    """
    if high - low < SLICE:  # so at most SLICE rows
        return keys.select("key", F.lead("key").over(Window.orderBy("key")).alias("next"))
    sliced = keys.withColumn("slice", _slice("key"))
    firsts = sliced.groupBy("slice").agg(F.min("key").alias("first"))
    after = following(firsts.select(F.col("slice").alias("key")), low // SLICE, high // SLICE)
    starts = after.join(firsts.select(F.col("slice").alias("next"), "first"), "next").select(F.col("key").alias("slice"), "first")
    inside = F.lead("key").over(Window.partitionBy("slice").orderBy("key"))
    return (
        sliced.withColumn("inside", inside)
        .join(starts, "slice", "left")
        .select("key", F.coalesce("inside", "first").alias("next"))
    )


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of ``docs(doc_id, text, digests)`` with ``next_text`` and ``next_digests`` of the next larger doc_id.

    The last document is followed by the first. Rows are sent once, to a slice of ids; the first
    row after a slice is sent to it too. Rows of one doc_id follow each other in the order of
    their texts. A null doc_id has an empty document next.
    """
    span = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    alone = docs.where("doc_id is null").select(
        *docs.columns, F.lit("").alias("next_text"), F.array().cast("array<bigint>").alias("next_digests")
    )
    if span[0] is None:
        return alone
    of = _slice("doc_id")
    firsts = docs.where("doc_id is not null").groupBy(of.alias("slice")).agg(F.min("doc_id").alias("first"))
    after = following(firsts.select(F.col("slice").alias("key")), span[0] // SLICE, span[1] // SLICE)
    follows = after.join(firsts.select(F.col("slice").alias("next"), "first"), "next", "left").select(
        F.coalesce("first", F.lit(span[0])).alias("doc_id"), F.col("key").alias("before")
    )
    follows, got = measured(follows, F.count("*").alias("n"))
    if got["n"] <= BROADCAST_SLICES:
        follows = F.broadcast(follows)
    sent = (
        docs.where("doc_id is not null")
        .join(follows, "doc_id", "left")
        .select("*", F.explode(F.array_compact(F.array(F.struct(of.alias("slice"), F.lit(False).alias("guest")),
                F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("slice"), F.lit(True).alias("guest")))))).alias("_to"))
        .select(*docs.columns, F.col("_to.slice").alias("_slice"), F.col("_to.guest").alias("_guest"))
    )
    order = Window.partitionBy("_slice").orderBy("_guest", "doc_id", "text")
    seen = sent.withColumns({"next_text": F.lead("text").over(order), "next_digests": F.lead("digests").over(order)})
    return seen.where("not _guest").drop("_slice", "_guest").unionByName(alone)


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` per row of ``docs(doc_id, text, …)``.

    The edited text has its last ``n_chars div 2`` code points replaced by the first as many (or all)
    of the next document. ``near_edited`` and ``near_next`` are the likeness of the fingerprint to those of the
    edited text and of the next document: the share of paragraphs in both, from the
    difference that subtracting and peeling recovers.

    Null texts count as empty; an empty text has an empty table, and two empty texts are alike (1).
    Repeated rows follow each other, so a row's next document can be its copy. A null doc_id has
    an empty document next. Other columns are ignored. An empty table gives no rows.
    """
    rows = docs.select("doc_id", whole_text().alias("text")).select("doc_id", "text", paragraph_digests(F.col("text")).alias("digests"))
    n = F.col("n_chars")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), n.cast("int") - half), F.left(F.col("next_text"), half))
    small = F.lit(CELLS).cast("bigint")
    tabled = (
        with_next(rows)
        .withColumn("n_chars", F.length("text").cast("bigint"))
        .withColumn("edited", edited)
        .withColumn("edited_digests", paragraph_digests(F.col("edited")))
        .select(
            "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "digests", "edited_digests",
            "next_digests", *[table_of(F.col(d), small).alias(t) for d, t in (("digests", "t"), ("edited_digests", "te"), ("next_digests", "tn"))],
        )
    )
    near = {
        name: likeness(F.col("digests"), F.col(d), differing(F.col("digests"), F.col(d), F.col("t"), F.col(t)))
        for name, d, t in (("near_edited", "edited_digests", "te"), ("near_next", "next_digests", "tn"))
    }
    return tabled.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("t"), F.col("digests")).alias("fingerprint"),
        written(F.col("te"), F.col("edited_digests")).alias("edited_fingerprint"), *[c.alias(k) for k, c in near.items()],
    )
