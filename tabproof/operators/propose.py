"""Proposing checks by measuring the data.

Each proposer prunes its candidates on the profile, which is one row per column, and
then measures the rest in as few passes as it can. Its measurements can be turned into
checks in their flat form.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import log, prod

from pyspark.sql import DataFrame, Observation, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabproof.functions import text as X
from tabproof.functions import types as K
from tabproof.functions.guard import spark_expression
from tabproof.operators.checks import CHECK_SCHEMA, check_key
from tabproof.operators.evaluate import unique_violations
from tabproof.operators.narrow import dimensions
from tabproof.operators.profile import (
    EXPRESSION_BUDGET,
    KEY_SHARE,
    ColumnSpec,
    column_specs,
    column_stats,
    percent,
    profile_table,
)
from tabproof.plans import sketches
from tabproof.plans.distinct import values_by_id
from tabproof.plans.keyed_rows import rows_with_keys
from tabproof.session import local_frame, saved, shuffles_removed

# Placeholders that hide in otherwise valid columns.
NUMERIC_SENTINELS = (0, -1, 9999)
DATE_SENTINEL = dt.date(1970, 1, 1)
TEXT_SENTINEL = ""

# Statistics that are no keys may be sketches; six of their standard errors.
_SKETCH_SLACK = 1 + 6 * 1.04 / 2 ** (sketches.DISTINCT_SIZE / 2)

# Rows that a look for repeated combinations takes, and combinations that one pass looks at.
_LOOKED_AT = 1 << 16
_LOOKS_PER_PASS = 40
# Combinations whose digests are made in one scan: few enough for a scan that is compiled.
_LOOKS_PER_SCAN = 5
# Combinations counted in one job, on so many parts of their keys one after another, each of so many rows at least.
_COUNTED_AT_ONCE = 8
_COUNTED_PARTS = 8
_PART_ROWS = 1_000_000

# Columns per 64-bit word of a set of columns; the sign bit stays unused.
_BITS = 63

# Sketches of 2 ** 12 smallest digests, 32 KB a column. Their thresholds and sketched counts are within
# a tenth (six standard errors); a pair is ruled out wrongly with probability 1e-12 at most.
_CONTAINMENT_SIZE = 12
_CONTAINMENT_SLACK = 0.9
_CONTAINMENT_MISS = 1e-12


# --------------------------------------------------- references between columns


@dataclass(frozen=True)
class _Candidate:
    """A column that may take part in a reference, with what the profile says of it."""

    id: int
    table: str
    name: str
    family: str
    domain: str
    distinct: int
    rows: int
    is_key: bool
    low: float | None
    high: float | None
    whole: bool

    def may_reference(self, parent: _Candidate) -> bool:
        if (self.table, self.name) == (parent.table, parent.name) or self.family != parent.family:
            return False
        if None not in (self.low, self.high, parent.low, parent.high):
            if self.high < parent.low or self.low > parent.high:
                return False
        if self.name == parent.name:
            return True
        return self.whole and parent.whole and parent.is_key


def catalog_stats(catalog, *, exact: bool = True) -> dict[str, list[Row]]:
    """``column_stats`` of every table, collected together: one row per column."""
    rows = reduce(
        DataFrame.unionByName,
        [column_stats(t.df, exact=exact).withColumn("table", F.lit(t.table)) for t in catalog.tables],
    ).collect()
    return {t.table: [r for r in rows if r["table"] == t.table] for t in catalog.tables}


def _candidates(catalog, stats: Mapping[str, Sequence[Row]]) -> list[_Candidate]:
    out = []
    for entry in catalog.tables:
        for row in stats[entry.table]:
            data_type = entry.df.schema[row["name"]].dataType
            family = K.type_family(data_type)
            if family not in ("numeric", "text", "temporal") or row["class"] == K.OTHER:
                continue
            if not row["distinct_count"]:
                continue
            domain = family
            if family == "numeric" and not K.is_integral(data_type):
                domain = "fractional"
            low = high = None
            if family == "numeric":
                low, high = float(row["low"]), float(row["high"])
            filled = row["row_count"] - row["null_count"]
            is_key = row["null_count"] == 0 and row["distinct_count"] >= KEY_SHARE * filled
            out.append(
                _Candidate(
                    len(out), entry.table, row["name"], family, domain, row["distinct_count"],
                    row["row_count"], is_key, low, high, row["whole"],
                )
            )
    return out


def _shared_value(column: str, data_type: T.DataType, domain: str, all_integral: bool) -> str:
    """A column's values in the form all columns of its family are compared in."""
    if domain == "text":
        return X.key_digest(column)
    if domain == "temporal":
        return f"string(cast({column} as timestamp_ntz))"
    if all_integral:
        # Wide enough for any whole number, so values of all columns share one type.
        return f"cast({column} as decimal(38,0))"
    if domain == "fractional":
        whole = f"abs({column}) < 9e15 and {column} = floor({column})"
        return f"if({whole}, string(bigint({column})), string({column} + 0.0d))"
    return f"string({column})"


def _value_sets(catalog, columns: Mapping[int, _Candidate], all_integral: bool) -> DataFrame:
    """``(child, ids, n)``: how many values each set of columns shares, per member column.

    The set of columns that hold a value is a few 64-bit words, so values are grouped
    by hash with map-side combining: a value is one row per task before the shuffle,
    whatever its frequency.
    """
    place = {c: i for i, c in enumerate(columns)}
    parts = []
    for table in dict.fromkeys(c.table for c in columns.values()):
        df = catalog.frame(table)
        values = [
            (
                place[c.id],
                _shared_value(
                    X.quote_name(c.name), df.schema[c.name].dataType, c.domain, all_integral
                ),
            )
            for c in columns.values()
            if c.table == table
        ]
        parts.append(values_by_id(df, values, "place", "value"))
    words = [f"w{i}" for i in range(len(columns) // _BITS + 1)]
    held = (
        reduce(DataFrame.unionByName, parts)
        .filter("value is not null")
        .groupBy("value")
        .agg(
            *[
                F.expr(f"bit_or(if(place div {_BITS} = {i}, shiftleft(1L, int(place % {_BITS})), 0L))").alias(w)
                for i, w in enumerate(words)
            ]
        )
    )
    sets = held.groupBy(*words).agg(F.count("*").alias("n"))
    members = ", ".join(
        f"if(getbit(w{i // _BITS}, {i % _BITS}) = 1, {c}, null)" for c, i in place.items()
    )
    ids = F.expr(f"filter(array({members}), c -> c is not null)")
    return sets.select(ids.alias("ids"), "n").select(F.explode("ids").alias("child"), "ids", "n")


def _value_sketches(catalog, columns: Sequence[_Candidate]) -> DataFrame:
    """``(id, sketch)``: the smallest digests of each column's values, one scan a table, texts hashed and not moved."""
    parts = []
    for table in dict.fromkeys(c.table for c in columns):
        df, mine, stats = catalog.frame(table), [c for c in columns if c.table == table], {}
        for c in mine:
            value = X.quote_name(c.name)
            if c.domain != "text":
                value = _shared_value(value, df.schema[c.name].dataType, c.domain, False)
            stats[f"s{c.id}"] = sketches.smallest_digests(value, _CONTAINMENT_SIZE)
        rows = ", ".join(f"named_struct('id', {c.id}, 'sketch', s{c.id})" for c in mine)
        parts.append(sketches.aggregate(df, stats).selectExpr(f"inline(array({rows}))"))
    return reduce(DataFrame.unionByName, parts)


def _least_shared(child: _Candidate, parent: _Candidate, min_inclusion: float) -> float:
    """Estimates of shared values below this rule a pair out; 0 where a sketch can say nothing.

    A digest is among the smallest of both with the lower of two thresholds, independently of others, so
    the shared digests of a pair that holds are binomial: Chernoff's bound says how low they may come out.
    """
    needed = min_inclusion * child.distinct * _CONTAINMENT_SLACK
    size, most = 2**_CONTAINMENT_SIZE, max(child.distinct, parent.distinct)
    if most <= size * _CONTAINMENT_SLACK / 2:  # both sketches hold all values
        return needed
    expected = needed * _CONTAINMENT_SLACK * min(1.0, size / most)
    return needed * max(0.0, 1 - (2 * log(1 / _CONTAINMENT_MISS) / expected) ** 0.5)


def _may_hold(catalog, pairs: Sequence[tuple[_Candidate, _Candidate]], min_inclusion: float):
    """The pairs that may include ``min_inclusion`` of the child's values, told from sketches.

    The sketches are a row per column in the shared folder; only numbers of shared values come back.
    """
    pairs = [(c, p) for c, p in pairs if p.distinct >= min_inclusion * c.distinct * _CONTAINMENT_SLACK**2]
    told = {(c.id, p.id): _least_shared(c, p, min_inclusion) for c, p in pairs}
    open_ids = {i for pair, least in told.items() if least > 0 for i in pair}
    if not open_ids:
        return pairs
    kept = saved(_value_sketches(catalog, list({c.id: c for pair in pairs for c in pair if c.id in open_ids}.values())))
    asked = local_frame(catalog.spark, [pair for pair, least in told.items() if least > 0], "child int, parent int")
    one, other = (kept.select(F.col("id").alias(side), F.col("sketch").alias(f"{side}_sketch")) for side in ("child", "parent"))
    shared = F.expr("theta_sketch_estimate(theta_intersection(child_sketch, parent_sketch))")
    counted = asked.join(one, "child").join(other, "parent").select("child", "parent", shared.alias("n")).collect()
    out = {(r["child"], r["parent"]) for r in counted if r["n"] + 1 < told[r["child"], r["parent"]]}
    return [(c, p) for c, p in pairs if (c.id, p.id) not in out]


def _listed(catalog, pairs) -> DataFrame:
    """Candidate pairs as rows: one per pair of columns, so small enough to broadcast."""
    return local_frame(
        catalog.spark,
        [(c.id, p.id, c.table, c.name, p.table, p.name, max(p.rows, 1)) for c, p in pairs],
        "child int, parent int, table string, column string, references_table string, references_column string, parent_rows bigint",
    )


def reference_candidates(
    catalog, stats: Mapping[str, Sequence[Row]] | None = None, *, min_inclusion: float = 0.0
) -> DataFrame:
    """Measure every column pair that may be a reference, in both directions.

    A pair is measured when the families agree, ranges overlap, and either the names
    agree or the parent is a key. Numbers with fractions are measures, so they count only
    under a shared name. Distinct values of all columns are grouped once; a value that
    fills a column is one row per task there. Output: ``inclusion`` is the share of the
    child's distinct values the parent has, ``ratio`` that of the child's distinct values
    to the parent's rows, to rank by.

    With ``min_inclusion`` above 0 only pairs that reach it come out, with the same figures. Sketches of
    the smallest digests then rule out most other pairs first, and columns in no pair left are never grouped;
    the distinct counts that this takes may be sketches too, so the statistics are cheaper.
    """
    spark = catalog.spark
    if stats is None:
        stats = catalog_stats(catalog, exact=min_inclusion <= 0)
    columns = _candidates(catalog, stats)
    pairs = [(c, p) for c in columns for p in columns if c.may_reference(p)]
    if min_inclusion > 0:
        pairs = _may_hold(catalog, pairs, min_inclusion)
    schema = (
        "table string, column string, references_table string, references_column string, ratio double, "
        "child_values bigint, shared_values bigint, inclusion double"
    )
    if not pairs:
        return local_frame(spark, [], schema)
    # Whole numbers are compared as such; only pairs with a fractional column need text.
    kinds: dict[tuple[str, bool], list[tuple[_Candidate, _Candidate]]] = {}
    for pair in pairs:
        fractional = any(c.domain == "fractional" for c in pair)
        kinds.setdefault((pair[0].family, fractional), []).append(pair)
    grouped = [
        _value_sets(catalog, {c.id: c for pair in members for c in pair}, not fractional)
        .join(F.broadcast(_listed(catalog, members)), "child")
        for (_, fractional), members in sorted(kinds.items())
    ]
    shared = F.when(F.array_contains("ids", F.col("parent")), F.col("n")).otherwise(0)
    names = ["table", "column", "references_table", "references_column"]
    found = (
        reduce(DataFrame.unionByName, grouped)
        .groupBy(*names, "parent_rows")
        .agg(F.sum("n").alias("child_values"), F.sum(shared).alias("shared_values"))
        .withColumn("ratio", F.col("child_values") / F.col("parent_rows"))
        .withColumn("inclusion", F.col("shared_values") / F.col("child_values"))
        .select(*names, "ratio", "child_values", "shared_values", "inclusion")
    )
    return found.filter(F.col("inclusion") >= min_inclusion) if min_inclusion > 0 else found


# ------------------------------------------------------------- composite keys


def composite_keys(
    df: DataFrame, table: str, stats: Sequence[Row] | None = None, *, max_columns: int = 3
) -> DataFrame:
    """Smallest column combinations that are unique although no part of them is.

    A combination is dropped when its parts cannot have enough distinct values, then when it repeats
    among some rows, or among the keys of a slice of its digests. One repetition disproves a key, so
    nothing else is left out; the others are counted exactly, on all rows. Output: ``(table, columns, row_count)``.
    """
    spark = df.sparkSession
    if stats is None:
        with shuffles_removed(spark):
            stats = column_stats(df).collect()
    rows = stats[0]["row_count"] if stats else 0
    # A NULL is one more value of its column.
    distinct = {
        r["name"]: r["distinct_count"] + (r["null_count"] > 0)
        for r in stats
        if r["class"] != K.NESTED and r["distinct_count"] > 1
    }
    distinct = {c: n * _SKETCH_SLACK for c, n in distinct.items() if n < rows}
    found: list[tuple[str, ...]] = []
    looked = None
    with shuffles_removed(spark):
        for size in range(2, max_columns + 1):
            left = [
                c
                for c in combinations(distinct, size)
                if not any(set(key) <= set(c) for key in found) and prod(distinct[x] for x in c) >= rows
            ]
            if not left:
                continue
            share = -(-rows // _LOOKED_AT)
            if looked is None:
                looked = df.select(*[X.quote_name(c) for c in distinct])
                looked = saved(looked.where(f"pmod({_digest(df, distinct, 0)}, {share}) = 0"))
            left = _not_repeated(looked, left)
            if share > 1:
                left = _not_repeated(df, left, share)
            for at in range(0, len(left), _COUNTED_AT_ONCE):
                found += _unique(df, left[at : at + _COUNTED_AT_ONCE], min(_COUNTED_PARTS, -(-rows // _PART_ROWS)))
    return local_frame(
        spark,
        [(table, list(c), rows) for c in found],
        "table string, columns array<string>, row_count bigint",
    )


def _digest(df: DataFrame, columns: Iterable[str], seed: int) -> str:
    """A number that is equal for rows with equal values in the columns; NULL is a value, zeros are equal."""
    values = [f"{seed}L"]
    for c in columns:
        name = X.quote_name(c)
        values += [f"({name} + 0.0d)" if K.is_floating(df.schema[c].dataType) else name, f"{name} is null"]
    return f"xxhash64({', '.join(values)})"


def _not_repeated(df: DataFrame, combos: Sequence[tuple[str, ...]], share: int = 1) -> list[tuple[str, ...]]:
    """The combinations that repeat in none of the rows, looking at the keys of one digest in ``share``."""
    repeated: set[int] = set()
    numbered = list(enumerate(combos))
    for at in range(0, len(combos), _LOOKS_PER_PASS):
        scans = []
        for first in range(at, min(at + _LOOKS_PER_PASS, len(combos)), _LOOKS_PER_SCAN):
            keys = []
            for i, c in numbered[first : min(first + _LOOKS_PER_SCAN, at + _LOOKS_PER_PASS)]:
                key = f"named_struct('i', {i}, 'a', {_digest(df, c, 0)}, 'b', {_digest(df, c, 1)})"
                keys.append(f"if(pmod({_digest(df, c, 0)}, {share}) = 0, {key}, null)")
            scans.append(df.selectExpr(f"inline(array({', '.join(keys)}))").where("i is not null"))
        seen = reduce(DataFrame.unionByName, scans).groupBy("i", "a", "b").agg(F.count("*").alias("n"))
        repeated |= {r["i"] for r in seen.where("n > 1").select("i").distinct().collect()}
    return [c for i, c in numbered if i not in repeated]


def _unique(df: DataFrame, combos: Sequence[tuple[str, ...]], parts: int) -> list[tuple[str, ...]]:
    """The combinations that no two rows share, counted exactly: part by part of their keys, so that few are shuffled at once."""
    left = list(combos)
    for part in range(parts):
        counted = [
            unique_violations(df.where(f"pmod({_digest(df, c, 2)}, {parts}) = {part}") if parts > 1 else df, c).withColumn("i", F.lit(i))
            for i, c in enumerate(left)
        ]
        left = [left[r["i"]] for r in reduce(DataFrame.unionByName, counted).where("violations = 0").orderBy("i").collect()] if left else []
    return left


# ------------------------------------------------------------ within one table


def minority_rows(df: DataFrame, column: str, *, threshold: float = 0.05) -> DataFrame:
    """Rows whose format is held by less than ``threshold`` of the column's values.

    One grouping gives the total and the formats at or above the threshold, which are at
    most ``1 / threshold``; they are listed in a filter, so rows are not shuffled.
    """
    if not 0.001 <= threshold <= 1:
        raise ValueError("threshold is a share from 0.001 to 1.")
    name = X.quote_name(column)
    shaped = df.withColumn("_shape", F.expr(X.format_mask(name))).filter(f"{name} is not null")
    seen = Observation()
    counts = shaped.groupBy("_shape").agg(F.count("*").alias("_n")).observe(seen, F.sum("_n").alias("total"))
    most = counts.orderBy(F.desc("_n"), "_shape").limit(int(1 / threshold) + 1).collect()
    common = [r["_shape"] for r in most if r["_n"] >= threshold * (seen.get["total"] or 0)]
    rows = shaped.filter(~F.col("_shape").isin(common)) if common else shaped
    return rows.withColumn("_shape", F.expr(X.collapse_runs("_shape"))).withColumnRenamed("_shape", "shape")


def _sentinels(spec: ColumnSpec) -> dict[str, str]:
    if spec.kind == K.NUMERIC:
        return {str(v): f"{spec.sql} = {v}" for v in NUMERIC_SENTINELS}
    if spec.kind == K.TEMPORAL:
        return {DATE_SENTINEL.isoformat(): f"to_date({spec.sql}) = date'{DATE_SENTINEL}'"}
    if spec.kind == K.STRING:
        return {TEXT_SENTINEL: f"{spec.sql} = '{TEXT_SENTINEL}'"}
    return {}


def _measure(df: DataFrame, measures: Sequence[tuple[dict[str, str], dict[str, str]]]) -> DataFrame:
    """Evaluate aggregates in one scan and return one row per measure.

    Each measure is a pair of literal fields and aggregate expressions. Very many are
    split over several scans, each reading its own columns.
    """
    size = max(1, EXPRESSION_BUDGET // len(measures[0][1]))
    parts = []
    for at in range(0, len(measures), size):
        aggregates, rows = [], []
        for i, (labels, stats) in enumerate(measures[at : at + size]):
            aggregates += [f"{sql} as m{i}_{name}" for name, sql in stats.items()]
            fields = [f"'{k}', {X.quote_text(v)}" for k, v in labels.items()]
            fields += [f"'{name}', m{i}_{name}" for name in stats]
            rows.append(f"named_struct({', '.join(fields)})")
        parts.append(df.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(rows)}))"))
    return reduce(DataFrame.unionByName, parts)


def sentinel_counts(df: DataFrame) -> DataFrame:
    """``(name, sentinel, filled, hits, pct)`` for every column that can hold one."""
    measures = [
        ({"name": s.name, "sentinel": text}, {"filled": f"count({s.sql})", "hits": f"count_if({test})"})
        for s in column_specs(df)
        for text, test in _sentinels(s).items()
    ]
    if not measures:
        return local_frame(
            df.sparkSession,
            [],
            "name string, sentinel string, filled bigint, hits bigint, pct double",
        )
    return _measure(df, measures).withColumn("pct", F.expr(percent("hits", "filled")))


def order_invariants(
    df: DataFrame, stats: Sequence[Row] | None = None, *, max_share: float = 0.05
) -> DataFrame:
    """Pairs with ``low_column <= high_column`` in nearly every row, in one pass.

    Pairs whose order already follows from the profile's ranges are left out, as are
    pairs that no row can satisfy. Output: ``(low_column, high_column, compared,
    violations, share)``.
    """
    if stats is None:
        stats = column_stats(df, exact=False).collect()
    ranges = {}
    for r in stats:
        as_value = float if r["class"] == K.NUMERIC else str
        if r["low"] is not None:
            ranges[r["name"]] = (as_value(r["low"]), as_value(r["high"]))
    measures = []
    for a in column_specs(df):
        for b in column_specs(df):
            if a.name == b.name or a.kind != b.kind or a.kind not in (K.NUMERIC, K.TEMPORAL):
                continue
            if a.name not in ranges or b.name not in ranges:
                continue
            (a_low, a_high), (b_low, b_high) = ranges[a.name], ranges[b.name]
            if a_high <= b_low or a_low > b_high:
                continue
            measures.append(
                (
                    {"low_column": a.name, "high_column": b.name},
                    {
                        "compared": f"count_if({a.sql} is not null and {b.sql} is not null)",
                        "violations": f"count_if({a.sql} > {b.sql})",
                    },
                )
            )
    if not measures:
        return local_frame(
            df.sparkSession,
            [], "low_column string, high_column string, compared bigint, violations bigint, share double"
        )
    share = F.when(F.col("compared") > 0, F.col("violations") / F.col("compared"))
    return _measure(df, measures).withColumn("share", share).filter(F.col("share") <= max_share)


def conditional_rules(
    df: DataFrame,
    predicates: Sequence[str],
    dims: Sequence[str] | None = None,
    *,
    min_rows: int = 1,
) -> DataFrame:
    """Predicates that hold for every row with some column value, but not for all rows.

    All dimensions and predicates are counted in one pass. Output: ``(dim, value,
    predicate, rows, overall_violations)``.
    """
    dims = dimensions(df) if dims is None else list(dims)
    texts = [d for d in dims if K.column_class(df.schema[d].dataType) != K.TEMPORAL]
    if not texts or not predicates:
        return local_frame(
            df.sparkSession,
            [],
            "dim string, value string, predicate string, rows bigint, overall_violations bigint",
        )
    bad = [
        f"if(not coalesce(({spark_expression(p)}), true), 1L, 0L) as _p{i}"
        for i, p in enumerate(predicates)
    ]
    flags = ", ".join(f"'_p{i}', _p{i}" for i in range(len(predicates)))
    pairs = ", ".join(
        f"named_struct('dim', {X.quote_text(d)}, 'value', string({X.quote_name(d)}), {flags})"
        for d in texts
    )
    counted = (
        df.selectExpr("*", *bad)
        .selectExpr(f"inline(array({pairs}))")
        .groupBy("dim", "value")
        .agg(
            F.count("*").alias("rows"),
            *[F.sum(f"_p{i}").alias(f"_p{i}") for i in range(len(predicates))],
        )
    )
    rules = ", ".join(
        f"named_struct('predicate', {X.quote_text(p)}, 'violations', _p{i})"
        for i, p in enumerate(predicates)
    )
    long = counted.select("dim", "value", "rows", F.expr(f"inline(array({rules}))"))
    # Each dimension covers all rows, so its values add up to a predicate's overall count.
    # By now a dimension has one row per value, and the table was read once.
    whole = Window.partitionBy("dim", "predicate")
    return (
        long.withColumn("overall_violations", F.sum("violations").over(whole))
        .filter((F.col("violations") == 0) & (F.col("rows") >= min_rows) & (F.col("overall_violations") > 0))
        .select("dim", "value", "predicate", "rows", "overall_violations")
    )


def numeric_texts(df: DataFrame) -> DataFrame:
    """``(name, filled, numeric, share)``: text columns and how much of them is whole numbers."""
    measures = [
        (
            {"name": s.name},
            {
                "filled": f"count({s.sql})",
                "numeric": f"count_if(try_cast({s.sql} as bigint) is not null)",
            },
        )
        for s in column_specs(df)
        if s.kind == K.STRING
    ]
    if not measures:
        return local_frame(df.sparkSession, [], "name string, filled bigint, numeric bigint, share double")
    share = F.when(F.col("filled") > 0, F.col("numeric") / F.col("filled"))
    return _measure(df, measures).withColumn("share", share)


def near_bounds(df: DataFrame, table: str, profile: DataFrame | None = None) -> DataFrame:
    """``(name, at_min, at_max, to_p01, from_p99)``: rows at and near the range ends.

    Many rows exactly at an end of the range suggest a cap or a placeholder.
    """
    described = profile_table(df, table, shapes=False) if profile is None else profile
    measures = []
    for r in described.filter("numeric is not null").select("name", "numeric").collect():
        c, stats = f"double({X.quote_name(r['name'])})", r["numeric"]
        if stats["min"] is None:
            continue
        ends = {
            "at_min": f"{c} = double('{stats['min']!r}')",
            "at_max": f"{c} = double('{stats['max']!r}')",
            "to_p01": f"{c} <= double('{stats['p01']!r}')",
            "from_p99": f"{c} >= double('{stats['p99']!r}')",
        }
        measures.append(({"name": r["name"]}, {k: f"count_if({v})" for k, v in ends.items()}))
    if not measures:
        return local_frame(
            df.sparkSession,
            [], "name string, at_min bigint, at_max bigint, to_p01 bigint, from_p99 bigint"
        )
    return _measure(df, measures)


# --------------------------------------------------------------- into checks


def _quoted(name: str) -> str:
    """SQL that puts the column named by a text expression in double quotes."""
    return f"""concat('"', replace({name}, '"', '""'), '"')"""


def _sign_predicates(stats: Sequence[Row]) -> list[str]:
    """For columns that reach zero or below: that they do not."""
    out = []
    for r in stats:
        if r["class"] == K.NUMERIC and r["low"] is not None and float(r["low"]) <= 0:
            name = '"' + r["name"].replace('"', '""') + '"'
            out.append(f"{name} > 0" if float(r["low"]) == 0 else f"{name} >= 0")
    return out


def _wire(rows: DataFrame, **fields: str) -> DataFrame:
    """Measurements as checks: each flat field from a SQL expression, others empty."""
    empty = {
        "title": "''", "rationale": "''", "severity": "'medium'", "kind": "'row_predicate'",
        "table": "''", "columns": "cast(array() as array<string>)", "expression": "''",
        "references_table": "''", "references_columns": "cast(array() as array<string>)",
    }
    return rows.selectExpr(*[f"{sql} as {name}" for name, sql in {**empty, **fields}.items()])


def propose_checks(
    catalog,
    *,
    min_inclusion: float = 0.9,
    min_rule_share: float = 0.05,
    max_sentinel_pct: float = 5.0,
    sentinels: Sequence[str] = ("-1", "9999"),
    max_values: int | None = 50,
) -> DataFrame:
    """Checks worth running on a catalog, in their flat form, most valuable first.

    References come in both directions: that every child has a parent and that every
    parent has a child are different claims. Placeholders are proposed against when they are among
    ``sentinels`` and rarer than ``max_sentinel_pct``; rules are looked for in columns of at
    most ``max_values`` values, or in all with None.
    """
    spark = catalog.spark
    with shuffles_removed(spark):
        stats = catalog_stats(catalog)
    references = saved(reference_candidates(catalog, stats, min_inclusion=min_inclusion))
    to_parent = _wire(
        references,
        title="concat('every ', table, '.', column, ' exists in ', references_table)",
        rationale="format_string('%d of %d distinct values are shared.', shared_values, child_values)",
        severity="'high'",
        kind="'references'",
        table="table",
        columns="array(column)",
        references_table="references_table",
        references_columns="array(references_column)",
    )
    to_child = _wire(
        references,
        title="concat('every ', references_table, '.', references_column, ' is used in ', table)",
        rationale="format_string('%d of %d distinct values are shared.', shared_values, child_values)",
        kind="'references'",
        table="references_table",
        columns="array(references_column)",
        references_table="table",
        references_columns="array(column)",
    )
    parts = [to_parent.unionByName(to_child).distinct()]
    for entry in catalog.tables:
        quoted = X.quote_text(entry.table)
        parts.append(
            _wire(
                composite_keys(entry.df, entry.table, stats[entry.table]),
                title="concat(array_join(columns, ', '), ' together are unique')",
                rationale="format_string('No combination repeats in %d rows.', row_count)",
                kind="'unique'",
                table=quoted,
                columns="columns",
            )
        )
        parts.append(
            _wire(
                order_invariants(entry.df, stats[entry.table]),
                title="concat(low_column, ' <= ', high_column)",
                rationale="format_string('Broken by %d of %d rows.', violations, compared)",
                table=quoted,
                expression=f"concat({_quoted('low_column')}, ' <= ', {_quoted('high_column')})",
            )
        )
        rare = sentinel_counts(entry.df).filter(
            (F.col("hits") > 0) & (F.col("pct") < max_sentinel_pct) & F.col("sentinel").isin(*sentinels)
        )
        literal = "if(sentinel rlike '^-?[0-9]+$', sentinel, concat(chr(39), sentinel, chr(39)))"
        parts.append(
            _wire(
                rare,
                title="concat(name, ' is never ', sentinel)",
                rationale="format_string('%d of %d values look like a placeholder.', hits, filled)",
                table=quoted,
                expression=f"concat({_quoted('name')}, ' <> ', {literal})",
            )
        )
        signs = _sign_predicates(stats[entry.table])
        dims = dimensions(entry.df, max_values=max_values) if signs else []
        if signs and dims:
            rows = stats[entry.table][0]["row_count"]
            rules = conditional_rules(
                entry.df, signs, dims, min_rows=max(1, int(rows * min_rule_share))
            ).filter("value is not null")
            parts.append(
                _wire(
                    rules,
                    title="concat('when ', dim, ' is ', value, ' then ', predicate)",
                    rationale="format_string('Holds for all %d such rows, broken by %d others.', rows, overall_violations)",
                    severity="'low'",
                    table=quoted,
                    expression=f"concat('string(', {_quoted('dim')}, ') <> ', chr(39), "
                    "replace(value, chr(39), concat(chr(39), chr(39))), chr(39), ' OR ', predicate)",
                )
            )
    with shuffles_removed(spark):
        proposed = reduce(DataFrame.unionByName, parts).collect()
    rank = {"high": 0, "medium": 1, "low": 2}
    proposed.sort(key=lambda r: (rank[r["severity"]], r["kind"], r["table"], r["title"]))
    names = [f.split()[0] for f in CHECK_SCHEMA.split(", ")]
    return local_frame(
        spark,
        [(i + 1, *[r[n] for n in names[1:]]) for i, r in enumerate(proposed)], CHECK_SCHEMA
    )


def not_yet_run(proposed: DataFrame, runs: DataFrame) -> DataFrame:
    """Proposed checks that no earlier round has asked, whatever their wording."""
    keyed = proposed.withColumn("_key", check_key())
    asked = runs.select(check_key().alias("_key")).distinct()
    fresh = keyed.groupBy("_key").agg(F.count("*").alias("n")).join(asked, "_key", "left_anti")
    return rows_with_keys(keyed, fresh, ["_key"]).drop("_key")
