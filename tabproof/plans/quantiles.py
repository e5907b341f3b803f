"""Exact distinct counts and interpolated quantiles of many columns: one scan to bound, one to settle.

``percentile`` keeps every distinct value of a column in one aggregation buffer, and several
``count(DISTINCT …)`` copy each row once per column. Here rank sketches, merged in two steps, give each
wanted rank a value range. Then one grouping of narrow ``(column, value)`` pairs has all that is
left to know: how many values a column has, how many rows lie between the ranges, and which values in
a range stand at the wanted ranks. Ranges with too many rows to sort in one task are first narrowed, one scan a step.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabproof.plans import sketches as S
from tabproof.session import saved

#: Size of the rank sketches: ranges hold 0.3 % of the rows.
_ACCURACY = 8000
#: Rows of a range whose distinct values one task sorts.
_MAX_INSIDE = 1_000_000
#: Columns whose values meet in one grouping.
_COLUMNS_PER_PASS = 40
#: Ranks that a narrowing step asks a sketch for, evenly spread.
_GRID = 64


@dataclass
class _Target:
    """One wanted rank and the closed value range that should hold it."""

    column: int
    rank: int
    low: float
    high: float
    about: float  # rows inside, as the sketch has it

    @property
    def wide(self) -> bool:
        return self.low != self.high


@dataclass
class _Column:
    """A measured expression: its rows, value range and wanted ranks."""

    id: int
    value: str
    probabilities: Sequence[float]
    rows: int = 0
    low: float | None = None
    high: float | None = None
    targets: list[_Target] = field(default_factory=list)

    @property
    def positions(self) -> list[float]:
        return [q * (self.rows - 1) for q in self.probabilities]

    def ranges(self) -> list[tuple[float, float]]:
        """The targets' ranges, overlapping ones merged, in order."""
        merged: list[tuple[float, float]] = []
        for low, high in sorted(((t.low, t.high) for t in self.targets), key=lambda r: (_order(r[0]), _order(r[1]))):
            if merged and _order(low) <= _order(merged[-1][1]):
                low, high = merged[-1][0], max(merged[-1][1], high, key=_order)
                merged.pop()
            merged.append((low, high))
        return merged


def _order(value: float) -> tuple[bool, float]:
    """NaN counts as the largest value."""
    return (True, 0.0) if math.isnan(value) else (False, value)


def _double(value: float) -> str:
    return f"double('{value!r}')"


def _top(value: float) -> float:
    """A sketched upper end. Sketches hold NaN as infinity."""
    return math.nan if value == math.inf else value


def _slack(accuracy: int) -> float:
    """Twice the rank error of a sketch, as a share of its rows."""
    return min(0.5, 2 * 2.3 / accuracy**0.9)


def _bounded(df: DataFrame, columns: Sequence[_Column], accuracy: int) -> None:
    """One scan: rows, ends and a range for every wanted rank."""
    slack, stats = _slack(accuracy), {}
    for c in columns:
        ends = [p for q in c.probabilities for p in (max(0.0, q - slack), min(1.0, q + slack))]
        stats |= {
            f"n{c.id}": S.plain(f"count({c.value})"),
            f"min{c.id}": S.plain(f"min({c.value})"),
            f"max{c.id}": S.plain(f"max({c.value})"),
            f"ends{c.id}": S.quantiles(c.value, ends, accuracy),
        }
    row = S.aggregate(df, stats).first()
    for c in columns:
        c.rows, c.low, c.high = row[f"n{c.id}"], row[f"min{c.id}"], row[f"max{c.id}"]
        ends = row[f"ends{c.id}"]
        for k, position in enumerate(c.positions if c.rows else []):
            low, high = ends[2 * k], _top(ends[2 * k + 1])
            for rank in {math.floor(position), math.ceil(position)}:
                c.targets.append(_Target(c.id, rank, low, high, 2 * slack * c.rows))


def _narrowed(df: DataFrame, columns: Sequence[_Column], accuracy: int, max_inside: int) -> None:
    """Shrink the ranges that hold more than ``max_inside`` rows, one scan for all of them, until none shrinks any more."""
    values = {c.id: c for c in columns}
    slack = _slack(accuracy)
    grid = [i / _GRID for i in range(_GRID + 1)]
    wide = [t for c in columns for t in c.targets if t.wide and t.about > max_inside]
    while wide:
        # Ranks beside each other have one range.
        place = {r: i for i, r in enumerate(dict.fromkeys((t.column, repr(t.low), repr(t.high)) for t in wide))}
        stats = {}
        for (column, low, high), i in place.items():
            v = values[column].value
            within = f"({v} >= double('{low}') and {v} <= double('{high}'))"
            stats |= {
                f"b{i}": S.plain(f"count_if({v} < double('{low}'))"),
                f"i{i}": S.plain(f"count_if({within})"),
                f"g{i}": S.quantiles(f"if({within}, {v}, null)", grid, accuracy),
            }
        row, left = S.aggregate(df, stats).first(), []
        for t in wide:
            i = place[t.column, repr(t.low), repr(t.high)]
            below, inside, cuts = row[f"b{i}"], row[f"i{i}"], row[f"g{i}"]
            column = values[t.column]
            if not below <= t.rank < below + inside:  # the sketch was off: all values again
                if t.low != column.low or _order(t.high) != _order(column.high):
                    t.low, t.high, t.about = column.low, column.high, column.rows
                    left.append(t)
                continue
            share = (t.rank - below) / max(1, inside - 1)
            at, to = math.floor(max(0.0, share - slack) * _GRID), math.ceil(min(1.0, share + slack) * _GRID)
            low, high, about = cuts[at], _top(cuts[to]), inside * (to - at) / _GRID
            shrunk = (low, high) != (t.low, t.high) and about < 0.9 * t.about
            # The outermost cuts are the range's own ends.
            t.low, t.high, t.about = (low if at else t.low), (high if to < _GRID else t.high), min(about, inside)
            if shrunk and t.wide and t.about > max_inside:
                left.append(t)
        wide = left


def _cases(columns: Mapping[int, str], otherwise: str) -> str:
    if not columns:
        return otherwise
    return "case id " + " ".join(f"when {i} then {sql}" for i, sql in columns.items()) + f" else {otherwise} end"


def _settled(
    df: DataFrame, keys: Mapping[int, tuple[str, str]], columns: Sequence[_Column]
) -> tuple[dict[int, int], dict[tuple[int, int], float]]:
    """One scan: distinct values of every column, and the values at the wanted ranks as far as the ranges hold them."""
    measured = {c.id: c for c in columns}
    entries = []
    for i in {**keys, **measured}:
        a, b = keys.get(i, ("0L", "0L"))
        value = measured[i].value if i in measured else "cast(null as double)"
        present = a if i in keys else value
        entry = f"named_struct('id', {i}, 'a', {a}, 'b', {b}, 'v', {value})"
        entries.append(f"if({present} is null, null, {entry})")
    values = (
        df.selectExpr(f"inline(array({', '.join(entries)}))")
        .where("id is not null")
        .groupBy("id", "a", "b", "v")
        .agg(F.count("*").alias("n"))
    )
    # Part 0 lies before the first range, 1 in it, 2 between it and the second, and so on.
    parts = {
        i: " + ".join(f"int(v >= {_double(low)}) + int(v > {_double(high)})" for low, high in c.ranges())
        for i, c in measured.items()
        if c.targets
    }
    # One row for each part between ranges, and one for each value in a range: the groups are read once for both.
    tagged = values.withColumn("part", F.expr(_cases(parts, "0")))
    kept = F.expr("if(part % 2 = 1, v, null)").alias("v")
    tagged = tagged.groupBy("id", "part", kept).agg(F.sum("n").alias("n"), F.count("*").alias("values"))
    tagged = saved(tagged) if parts else tagged
    totals = tagged.groupBy("id", "part").agg(F.sum("n").alias("n"), F.sum("values").alias("values"))
    listed = totals.select("id", "values", F.lit(None).cast("long").alias("rank"), F.lit(None).cast("double").alias("v"))
    if parts:
        before = Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        below = totals.select("id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"))
        upto = Window.partitionBy("id", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        inside = tagged.where("part % 2 = 1").withColumn("seen", F.sum("n").over(upto)).join(F.broadcast(below), ["id", "part"])
        wanted = {i: f"array({', '.join(f'{r}L' for r in sorted({t.rank for t in c.targets}))})" for i, c in measured.items() if c.targets}
        ranks = f"filter({_cases(wanted, 'array()')}, r -> r >= below + seen - n and r < below + seen)"
        found = inside.selectExpr("id", "0L as values", f"explode({ranks}) as rank", "v")
        listed = listed.unionByName(found)
    distinct: dict[int, int] = dict.fromkeys(keys, 0)
    at_rank: dict[tuple[int, int], float] = {}
    for r in listed.collect():
        if r["rank"] is not None:
            at_rank[r["id"], r["rank"]] = r["v"]
        elif r["id"] in keys:
            distinct[r["id"]] += r["values"]
    return distinct, at_rank


def value_statistics(
    df: DataFrame,
    keys: Mapping[int, tuple[str, str]],
    measured: Mapping[int, tuple[str, Sequence[float]]],
    *,
    accuracy: int = _ACCURACY,
    max_inside: int = _MAX_INSIDE,
) -> tuple[dict[int, int], dict[int, list[float | None]]]:
    """Distinct counts of the columns of ``keys``, and quantiles of those of ``measured``, by their ids.

    ``keys`` gives two numbers that tell values apart (the first NULL for no value), see
    :func:`tabproof.functions.text.value_digest`; ``measured`` a numeric SQL expression and the wanted probabilities.
    Quantiles are interpolated linearly; NaN counts as the largest value. Only counts, range ends and
    answers reach the driver. Wide tables are settled some columns at a time.
    """
    columns = {i: _Column(i, f"double({sql})", list(wanted)) for i, (sql, wanted) in measured.items()}
    for some in _chunks(list(columns)):
        _bounded(df, [columns[i] for i in some], accuracy)
    _narrowed(df, list(columns.values()), accuracy, max_inside)
    distinct, at_rank = {}, {}
    for some in _chunks(list({**keys, **columns})):
        mine = [columns[i] for i in some if i in columns]
        counted, found = _settled(df, {i: keys[i] for i in some if i in keys}, mine)
        missed = [t for c in mine for t in c.targets if (t.column, t.rank) not in found]
        while missed:  # a sketch was off by more than its slack: all values of such columns are its range
            for t in missed:
                t.low, t.high = columns[t.column].low, columns[t.column].high
            again = [columns[i] for i in {t.column for t in missed}]
            found |= _settled(df, {}, again)[1]
            missed = [t for t in missed if (t.column, t.rank) not in found]
        distinct |= counted
        at_rank |= found
    quantiles: dict[int, list[float | None]] = {}
    for c in columns.values():
        quantiles[c.id] = []
        for position in c.positions if c.rows else []:
            low, high = (at_rank[c.id, r] for r in (math.floor(position), math.ceil(position)))
            share = position - math.floor(position)
            quantiles[c.id].append(low if share == 0 else low + (high - low) * share)
        if not c.rows:
            quantiles[c.id] = [None] * len(c.probabilities)
    return distinct, quantiles


def _chunks(ids: Sequence[int]) -> list[Sequence[int]]:
    return [ids[at : at + _COLUMNS_PER_PASS] for at in range(0, len(ids), _COLUMNS_PER_PASS)]


def exact_quantiles(
    df: DataFrame,
    columns: Mapping[int, str],
    probabilities: Sequence[float],
    *,
    accuracy: int = _ACCURACY,
    max_inside: int = _MAX_INSIDE,
) -> dict[int, list[float | None]]:
    """Exact, linearly interpolated quantiles of each numbered numeric SQL expression; see :func:`value_statistics`."""
    measured = {i: (sql, probabilities) for i, sql in columns.items()}
    return value_statistics(df, {}, measured, accuracy=accuracy, max_inside=max_inside)[1]
