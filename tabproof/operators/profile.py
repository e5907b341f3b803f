"""Metadata-only column profiles: counts, ranges, quantiles, masked shapes.

A profile holds no cell value apart from date bounds. One row describes one column.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabproof.functions import text as X
from tabproof.functions import types as K
from tabproof.plans import sketches as S
from tabproof.plans.distinct import exact_distinct, values_by_id
from tabproof.plans.quantiles import value_statistics
from tabproof.session import local_frame

# Fixed values.
EXPRESSION_BUDGET = 180  # expressions in one aggregate
TOP_SHAPES = 8
KEY_SHARE = 0.99
SPARSE_NULL_PCT = 50
QUANTILES = {"p01": 0.01, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p99": 0.99}

# Expressions per column in the short statistics.
_STATS_COST = 8

# A sketched distinct count this close to the number of values is settled by counting.
_SKETCH_SLACK = 6 * 1.04 / 2 ** (S.DISTINCT_SIZE / 2)

_NUMERIC = "struct<min:double,max:double,avg:double,stddev:double,p01:double,p25:double,p50:double,p75:double,p99:double,zero_count:bigint,negative_count:bigint,non_finite_count:bigint>"
_TEMPORAL = "struct<min_iso:string,max_iso:string,span_days:int,future_count:bigint,epoch_zero_count:bigint>"
_BOOLEAN = "struct<true_count:bigint,false_count:bigint>"
_CLASS_PCT = "struct<alpha:double,digit:double,space:double,punct:double,other:double>"
_SHAPES = "array<struct<shape:string,count:bigint>>"
_STRING = f"struct<len_min:int,len_p50:double,len_max:int,len_avg:double,empty_count:bigint,whitespace_only_count:bigint,untrimmed_count:bigint,char_class_pct:{_CLASS_PCT},distinct_case_insensitive:bigint,shapes:{_SHAPES}>"
_BLOCKS = {K.NUMERIC: _NUMERIC, K.TEMPORAL: _TEMPORAL, K.BOOLEAN: _BOOLEAN, K.STRING: _STRING}

PROFILE_SCHEMA = (
    "table string, label string, format string, ordinal int, name string, sql_type string, "
    "class string, row_count bigint, null_count bigint, null_pct double, distinct_count bigint, "
    "distinct_pct double, is_candidate_key boolean, is_exact_key boolean, "
    f"numeric {_NUMERIC}, temporal {_TEMPORAL}, boolean {_BOOLEAN}, string {_STRING}"
)


@dataclass(frozen=True)
class ColumnSpec:
    """A column of a table and the class that decides its statistics."""

    ordinal: int
    name: str
    data_type: T.DataType

    @property
    def kind(self) -> str:
        return K.column_class(self.data_type)

    @property
    def sql(self) -> str:
        return X.quote_name(self.name)

    def named(self, stat: str) -> str:
        return f"c{self.ordinal}_{stat}"


def column_specs(df: DataFrame) -> list[ColumnSpec]:
    return [ColumnSpec(i, f.name, f.dataType) for i, f in enumerate(df.schema.fields)]


def percent(part: str, whole: str) -> str:
    """``part`` in percent of ``whole``; 0 when there is nothing to divide."""
    return f"if({whole} = 0, 0d, double({part}) / {whole} * 100)"


def _finite(value: str) -> str:
    """A statistic as a double, NULL when it is NaN or infinite."""
    return f"if(abs(double({value})) < double('Infinity'), double({value}), null)"


def column_aggregates(spec: ColumnSpec, *, exact: bool, as_of: str) -> dict[str, tuple[str, str]]:
    """The aggregates of one column, by statistic: of a part of the table, and merged.

    In exact mode the first of the two is taken over the whole table, and quantiles are
    measured apart.
    """
    c = spec.sql
    out = {"nonnull": S.plain(f"count({c})")}
    if not exact and spec.kind != K.NESTED:
        out["ndv"] = S.distinct([c])
    if spec.kind == K.NUMERIC:
        out |= {
            "min": S.plain(f"min({c})"),
            "max": S.plain(f"max({c})"),
            "avg": (f"avg(double({c}))", "") if exact else S.mean(c),
            "stddev": (f"stddev_samp(double({c}))", "") if exact else S.deviation(c),
            "zero": S.plain(f"count_if({c} = 0)"),
            "negative": S.plain(f"count_if({c} < 0)"),
        }
        if not exact:
            out["quantiles"] = S.quantiles(c, list(QUANTILES.values()))
        if K.is_floating(spec.data_type):
            odd = f"isnan({c}) or abs({c}) = double('Infinity')"
            out["nonfinite"] = S.plain(f"count_if({odd})")
    elif spec.kind == K.TEMPORAL:
        out |= {
            "min": S.plain(f"min({c})"),
            "max": S.plain(f"max({c})"),
            "future": S.plain(f"count_if({c} > {as_of})"),
            "epoch": S.plain(f"count_if(to_date({c}) = date'1970-01-01')"),
        }
    elif spec.kind == K.BOOLEAN:
        out |= {"true": S.plain(f"count_if({c})"), "false": S.plain(f"count_if(not {c})")}
    elif spec.kind == K.STRING:
        lengths = X.class_lengths(c)
        out |= {
            "lenmin": S.plain(f"min(length({c}))"),
            "lenmax": S.plain(f"max(length({c}))"),
            "empty": S.plain(f"count_if({c} = '')"),
            "blank": S.plain(f"count_if({X.is_blank(c)})"),
            "untrimmed": S.plain(f"count_if({X.is_untrimmed(c)})"),
            **{name: S.plain(f"sum({length})") for name, length in lengths.items()},
        }
        if not exact:
            out["lenp50"] = S.quantiles(f"length({c})", [0.5])
            out["ndv_ci"] = S.distinct([f"lower({c})"])
    return out


def chunk_columns(
    specs: Sequence[ColumnSpec], costs: Sequence[int], budget: int = EXPRESSION_BUDGET
) -> list[list[ColumnSpec]]:
    """Split columns so that no aggregate carries more than ``budget`` expressions."""
    chunks: list[list[ColumnSpec]] = []
    room = 0
    for spec, cost in zip(specs, costs):
        if not chunks or cost > room:
            chunks.append([])
            room = budget
        chunks[-1].append(spec)
        room -= cost
    return chunks


def _struct(fields: dict[str, str], as_type: str) -> str:
    inner = ", ".join(f"'{name}', {sql}" for name, sql in fields.items())
    return f"cast(named_struct({inner}) as {as_type})"


def _block(kind: str, spec: ColumnSpec, stat) -> str:
    """One nested block of a profile row, NULL unless the column is of that class."""
    if spec.kind != kind:
        return f"cast(null as {_BLOCKS[kind]})"
    if kind == K.NUMERIC:
        fields = {s: _finite(stat(s)) for s in ("min", "max", "avg", "stddev")}
        fields |= {p: _finite(f"{stat('quantiles')}[{i}]") for i, p in enumerate(QUANTILES)}
        fields |= {
            "zero_count": stat("zero"),
            "negative_count": stat("negative"),
            "non_finite_count": stat("nonfinite") if K.is_floating(spec.data_type) else "0L",
        }
    elif kind == K.TEMPORAL:
        fields = {
            "min_iso": f"string({stat('min')})",
            "max_iso": f"string({stat('max')})",
            "span_days": f"datediff({stat('max')}, {stat('min')})",
            "future_count": stat("future"),
            "epoch_zero_count": stat("epoch"),
        }
    elif kind == K.BOOLEAN:
        fields = {"true_count": stat("true"), "false_count": stat("false")}
    else:
        n = {p: f"coalesce({stat(p)}, 0L)" for p in ("chars", "alpha", "digit", "space", "punct")}
        rest = f"({n['chars']} - {n['alpha']} - {n['digit']} - {n['space']} - {n['punct']})"
        classes = {p: percent(n[p], n["chars"]) for p in ("alpha", "digit", "space", "punct")}
        classes["other"] = f"greatest(0d, {percent(rest, n['chars'])})"
        fields = {
            "len_min": stat("lenmin"),
            "len_p50": f"{stat('lenp50')}[0]",
            "len_max": stat("lenmax"),
            "len_avg": f"try_divide({stat('chars')}, {stat('nonnull')})",
            "empty_count": stat("empty"),
            "whitespace_only_count": stat("blank"),
            "untrimmed_count": stat("untrimmed"),
            "char_class_pct": _struct(classes, _CLASS_PCT),
            "distinct_case_insensitive": "null",
            "shapes": "null",
        }
    return _struct(fields, _BLOCKS[kind])


def _profile_rows(
    df: DataFrame, chunk: Sequence[ColumnSpec], known: dict[int, list[float | None]], **options
) -> DataFrame:
    """Aggregate one chunk of columns and turn the wide row into one row per column."""
    aggregates, rows = {"row_count": S.plain("count(*)")}, []
    for spec in chunk:
        stats = column_aggregates(spec, **options)
        aggregates |= {spec.named(name): sql for name, sql in stats.items()}

        def stat(name: str, spec: ColumnSpec = spec) -> str:
            if name in ("quantiles", "lenp50") and spec.ordinal in known:
                given = ["null" if v is None else f"double('{v!r}')" for v in known[spec.ordinal]]
                return f"array({', '.join(given)})"
            return spec.named(name)

        row = {
            "ordinal": str(spec.ordinal),
            "name": X.quote_text(spec.name),
            "sql_type": X.quote_text(spec.data_type.simpleString()),
            "class": f"'{spec.kind}'",
            "row_count": "row_count",
            "nonnull": stat("nonnull"),
            "ndv": f"bigint({stat('ndv') if 'ndv' in stats else 'null'})",
            "ndv_ci": f"bigint({stat('ndv_ci') if 'ndv_ci' in stats else 'null'})",
        } | {kind: _block(kind, spec, stat) for kind in _BLOCKS}
        rows.append(
            "named_struct(" + ", ".join(f"'{name}', {sql}" for name, sql in row.items()) + ")"
        )
    return _aggregate(df, aggregates, options["exact"]).selectExpr(f"inline(array({', '.join(rows)}))")


def _aggregate(df: DataFrame, stats: dict[str, tuple[str, str]], exact: bool) -> DataFrame:
    """One row of aggregates, in scans that are compiled; those with sketches are merged in parts."""
    if exact:
        named = [f"{sql} as {name}" for name, (sql, _) in stats.items()]
        scans = [df.selectExpr(*named[at : at + S.PLAIN_PER_SCAN]) for at in range(0, len(named), S.PLAIN_PER_SCAN)]
        return reduce(DataFrame.crossJoin, scans)
    return S.aggregate(df, stats)


def _with_settled_keys(df: DataFrame, found: DataFrame, specs: Sequence[ColumnSpec], filled: str) -> DataFrame:
    """Sketched statistics, one row per column, with ``ndv`` counted wherever a key flag hangs on it."""
    rows = found.collect()
    near = {
        r["ordinal"]
        for r in rows
        if r["row_count"] and r[filled] == r["row_count"] and (r["ndv"] or 0) >= KEY_SHARE * r["row_count"] * (1 - _SKETCH_SLACK)
    }
    columns = [(s.ordinal, X.value_digest(s.sql, s.data_type)) for s in specs if s.ordinal in near]
    counted = {r["id"]: r["ndv"] for r in exact_distinct(df, columns).collect()}
    settled = [r.asDict() | {"ndv": counted.get(r["ordinal"], r["ndv"])} for r in rows]
    return df.sparkSession.createDataFrame([tuple(r[c] for c in found.columns) for r in settled], found.schema)


def distinct_counts(df: DataFrame, specs: Sequence[ColumnSpec]) -> DataFrame:
    """Exact distinct counts ``(ordinal, ndv, ndv_ci)``, the second ignoring case."""
    return _counts_frame(df, specs, value_statistics(df, _distinct_keys(specs), {})[0])


def _distinct_keys(specs: Sequence[ColumnSpec]) -> dict[int, tuple[str, str]]:
    """What tells the values of each column apart; texts without case follow, by ordinal and number of columns."""
    keys = {s.ordinal: X.value_digest(s.sql, s.data_type) for s in specs if s.kind != K.NESTED}
    return keys | {s.ordinal + len(specs): X.digest_pair(f"lower({s.sql})") for s in specs if s.kind == K.STRING}


def _counts_frame(df: DataFrame, specs: Sequence[ColumnSpec], counts: dict[int, int]) -> DataFrame:
    rows = [(s.ordinal, counts.get(s.ordinal), counts.get(s.ordinal + len(specs))) for s in specs if s.ordinal in counts]
    return local_frame(df.sparkSession, rows, "ordinal int, ndv bigint, ndv_ci bigint")


def shape_counts(df: DataFrame, specs: Sequence[ColumnSpec]) -> DataFrame:
    """``(ordinal, shape, n)``: how often each masked format occurs in each column."""
    return (
        values_by_id(df, [(s.ordinal, X.format_mask(s.sql)) for s in specs], "ordinal", "shape")
        .filter("shape is not null")
        .groupBy("ordinal", "shape")
        .agg(F.count("*").alias("n"))
    )


def top_shapes(counts: DataFrame, k: int = TOP_SHAPES) -> DataFrame:
    """The ``k`` most frequent shapes of each column, ranked, runs collapsed.

    Spark keeps the best ``k`` per column inside each task before it shuffles.
    """
    best = Window.partitionBy("ordinal").orderBy(F.desc("n"), F.asc("shape"))
    return (
        counts.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .withColumn("shape", F.expr(X.collapse_runs("shape")))
    )


def sample_rows(df: DataFrame, n: int, by: Sequence[str] | None = None) -> DataFrame:
    """``n`` rows of a table, or all if it has fewer: those of smallest MD5 of their ``by`` columns, all columns unless given.

    The same rows come out whatever the partitions. Rows are counted first; a bound on the digest then leaves little
    more than ``n`` rows, so the tasks' candidates fit in the one that merges them. Rows of equal ``by`` columns are
    taken in the order of the other columns' digests. NULL counts as an empty text.
    """
    names = list(by or df.columns)

    def digest(columns: Sequence[str]) -> str:
        texts = [f"coalesce(string({X.quote_name(c)}), '')" for c in columns]
        return f"md5(concat_ws('\x1f', {', '.join(texts)}))"

    rows = df.count()
    wide = n + 8 * math.isqrt(max(n, 1)) + 64
    place = F.expr(digest(names))
    order = [place, F.expr(digest(df.columns))]
    if wide < rows:
        few = df.where(F.substring(place, 1, 15) <= f"{int(wide / rows * 16**15):015x}")
        if few.count() >= n:
            df = few
    return df.orderBy(*order).limit(n)


def shape_histogram(
    df: DataFrame,
    specs: Sequence[ColumnSpec] | None = None,
    *,
    k: int = TOP_SHAPES,
    max_columns: int | None = None,
    sample_fraction: float | None = None,
    seed: int = 42,
    sample: int | None = None,
    sample_by: Sequence[str] | None = None,
) -> DataFrame:
    """Top shapes ``(ordinal, shape, n, rank)`` of all text columns in one pass.

    The whole table is read unless a ``sample_fraction``, or a ``sample`` of so many rows, see
    :func:`sample_rows`, is asked for.
    """
    texts = [s for s in (specs or column_specs(df)) if s.kind == K.STRING][:max_columns]
    if not texts:
        return local_frame(df.sparkSession, [], "ordinal int, shape string, n bigint, rank int")
    rows = df if sample_fraction is None else df.sample(sample_fraction, seed=seed)
    rows = rows if sample is None else sample_rows(rows, sample, sample_by)
    return top_shapes(shape_counts(rows, texts), k)


def profile_table(
    df: DataFrame,
    table: str,
    *,
    label: str | None = None,
    fmt: str | None = None,
    exact: bool = True,
    as_of: dt.datetime | None = None,
    shapes: bool = True,
    max_shape_columns: int | None = None,
    shape_fraction: float | None = None,
) -> DataFrame:
    """Profile every column of a table: one row per column, see ``PROFILE_SCHEMA``.

    Distinct counts and quantiles are exact at every size. With ``exact=False`` they are
    sketches at every size, except that key flags are always settled by counting.
    """
    specs = column_specs(df)
    moment = "current_timestamp()" if as_of is None else f"timestamp_ntz'{as_of}'"
    options = dict(exact=exact, as_of=moment)

    known: dict[int, list[float | None]] = {}
    counts: dict[int, int] = {}
    if exact:
        # Numbers and lengths are bounded in one scan; a second one settles them and all distinct counts.
        n = len(specs)
        measured = {s.ordinal: (s.sql, list(QUANTILES.values())) for s in specs if s.kind == K.NUMERIC}
        measured |= {s.ordinal + 2 * n: (f"length({s.sql})", [0.5]) for s in specs if s.kind == K.STRING}
        counts, found = value_statistics(df, _distinct_keys(specs), measured)
        known = {i % n: values for i, values in found.items()}

    costs = [len(column_aggregates(s, **options)) for s in specs]
    fmt = fmt or "parquet"
    # Text columns apart: one aggregate of all would be too long to be compiled.
    kinds = [[i for i, s in enumerate(specs) if (s.kind == K.STRING) == text] for text in (False, True)]
    chunks = [c for mine in kinds for c in chunk_columns([specs[i] for i in mine], [costs[i] for i in mine], EXPRESSION_BUDGET)]
    profile = reduce(DataFrame.unionByName, [_profile_rows(df, chunk, known, **options) for chunk in chunks])
    if not exact:
        profile = _with_settled_keys(df, profile, specs, "nonnull")
    if exact:
        counted = _counts_frame(df, specs, counts)
        # One row per column, so always small enough to broadcast.
        profile = profile.drop("ndv", "ndv_ci").join(F.broadcast(counted), "ordinal", "left")
    if shapes:
        tops = (
            shape_histogram(
                df, specs, max_columns=max_shape_columns, sample_fraction=shape_fraction
            )
            .groupBy("ordinal")
            .agg(F.expr("array_sort(collect_list(struct(rank, shape, n)))").alias("tops"))
        )
        profile = profile.join(F.broadcast(tops), "ordinal", "left")
    else:
        empty = F.lit(None).cast("array<struct<rank:int,shape:string,n:bigint>>")
        profile = profile.withColumn("tops", empty)
    return _finish(profile, table, label or table, fmt)


def _finish(profile: DataFrame, table: str, label: str, fmt: str) -> DataFrame:
    """Derive the percentages and flags and put the fields in their declared order."""
    # A sketch can overshoot; there are never more distinct values than values.
    distinct = "least(coalesce(ndv, 0L), nonnull)"
    nulls = "(row_count - nonnull)"
    shapes = (
        "transform(coalesce(tops, array()), s -> named_struct('shape', s.shape, 'count', s.n))"
    )
    kept = ", ".join(
        f"'{f}', string.{f}"
        for f in T.StructType.fromDDL(f"s {_STRING}")["s"].dataType.names
        if f not in ("distinct_case_insensitive", "shapes")
    )
    string = (
        f"if(string is null, null, named_struct({kept}, "
        f"'distinct_case_insensitive', coalesce(ndv_ci, 0L), 'shapes', {shapes}))"
    )
    return profile.selectExpr(
        f"{X.quote_text(table)} as table",
        f"{X.quote_text(label)} as label",
        f"'{fmt}' as format",
        "ordinal",
        "name",
        "sql_type",
        "class",
        "row_count",
        f"{nulls} as null_count",
        f"{percent(nulls, 'row_count')} as null_pct",
        f"{distinct} as distinct_count",
        f"{percent(distinct, 'greatest(1L, nonnull)')} as distinct_pct",
        f"({nulls} = 0 and nonnull > 0 and {distinct} >= nonnull * {KEY_SHARE}d) as is_candidate_key",
        f"({nulls} = 0 and nonnull > 0 and {distinct} = nonnull) as is_exact_key",
        "numeric",
        "temporal",
        "boolean",
        f"cast({string} as {_STRING}) as string",
    )


def column_stats(df: DataFrame, *, exact: bool = True) -> DataFrame:
    """The part of a profile that prunes candidates, cheaper than the whole.

    One row per column: ``(ordinal, name, class, row_count, null_count, distinct_count,
    low, high, whole)``; the range is numeric, or text for dates, and NULL for other
    classes; ``whole`` is false for numbers with fractions. With ``exact=False`` distinct
    counts are sketches, except where a column may be a key.
    """
    specs = column_specs(df)
    chunks = chunk_columns(specs, [_STATS_COST] * len(specs), EXPRESSION_BUDGET)
    stats = reduce(DataFrame.unionByName, [_stats_rows(df, chunk, exact) for chunk in chunks])
    if exact:
        columns = [(s.ordinal, X.value_digest(s.sql, s.data_type)) for s in specs if s.kind != K.NESTED]
        counted = exact_distinct(df, columns).select(F.col("id").alias("ordinal"), "ndv")
        stats = stats.drop("ndv").join(F.broadcast(counted), "ordinal", "left")
    else:
        stats = _with_settled_keys(df, stats.withColumn("filled", F.expr("row_count - null_count")), specs, "filled")
        stats = stats.drop("filled")
    distinct = F.least(F.coalesce("ndv", F.lit(0)), F.col("row_count") - F.col("null_count"))
    return stats.withColumn("distinct_count", distinct).drop("ndv")


def _stats_rows(df: DataFrame, specs: Sequence[ColumnSpec], exact: bool) -> DataFrame:
    """``column_stats`` of some columns, with sketched distinct counts unless exact."""
    aggregates, rows = {"row_count": S.plain("count(*)")}, []
    for s in specs:
        ranged = s.kind in (K.NUMERIC, K.TEMPORAL)
        sketched = not exact and s.kind != K.NESTED
        measured = s.kind == K.NUMERIC and not K.is_integral(s.data_type)
        aggregates[s.named("n")] = S.plain(f"count({s.sql})")
        if measured:
            aggregates[s.named("parts")] = S.plain(f"count_if({s.sql} <> floor({s.sql}))")
        if ranged:
            aggregates[s.named("min")] = S.plain(f"min({s.sql})")
            aggregates[s.named("max")] = S.plain(f"max({s.sql})")
        if sketched:
            aggregates[s.named("ndv")] = S.distinct([s.sql])

        def end(which: str, spec: ColumnSpec = s, ranged: bool = ranged) -> str:
            if not ranged:
                return "cast(null as string)"
            value = spec.named(which)
            return f"string(double({value}))" if spec.kind == K.NUMERIC else f"string({value})"

        rows.append(
            f"named_struct('ordinal', {s.ordinal}, 'name', {X.quote_text(s.name)}, "
            f"'class', '{s.kind}', 'row_count', row_count, "
            f"'null_count', row_count - {s.named('n')}, "
            f"'ndv', bigint({s.named('ndv') if sketched else 'null'}), "
            f"'low', {end('min')}, 'high', {end('max')}, "
            f"'whole', {s.named('parts') + ' = 0' if measured else 'true'})"
        )
    return _aggregate(df, aggregates, exact).selectExpr(f"inline(array({', '.join(rows)}))")


def profile_catalog(catalog, **options) -> DataFrame:
    """Profile every table of a catalog: one row per table and column."""
    return reduce(
        DataFrame.unionByName,
        [
            profile_table(entry.df, entry.table, label=entry.label, fmt=entry.format, **options)
            for entry in catalog.tables
        ],
    )


# ------------------------------------------------------------------ publication


def shape_leaks(profile: DataFrame) -> DataFrame:
    """Shapes that may not be published: ``(table, name, shape, problem)``."""
    return (
        profile.select("table", "name", F.explode("string.shapes").alias("s"))
        .select("table", "name", F.col("s.shape").alias("shape"))
        .withColumn("problem", F.expr(X.shape_problem("shape")))
        .filter("problem is not null")
    )


class RedactionError(ValueError):
    """A profile holds a shape that may carry part of a value."""


def publish_profile(profile: DataFrame, *, strict: bool = False) -> DataFrame:
    """Exactly the declared fields of a profile, without shapes that may leak.

    ``strict`` raises instead of dropping such shapes.
    """
    declared = T.StructType.fromDDL(PROFILE_SCHEMA)
    clean = profile.select(*[F.col(f.name).cast(f.dataType) for f in declared.fields])
    if strict:
        leak = shape_leaks(clean).select("table", "name", "problem").first()
        if leak is not None:
            raise RedactionError(f"{leak['table']}.{leak['name']}: {leak['problem']}")
    safe = f"filter(string.shapes, s -> ({X.shape_problem('s.shape')}) is null)"
    return clean.withColumn(
        "string",
        F.when(F.col("string").isNotNull(), F.col("string").withField("shapes", F.expr(safe))),
    )


def profile_rollup(profile: DataFrame) -> DataFrame:
    """One row per table: rows, columns, and whether a column is mostly NULL."""
    return profile.groupBy("table").agg(
        F.max("row_count").alias("row_count"),
        F.count("*").alias("column_count"),
        F.max(F.col("null_pct") > SPARSE_NULL_PCT).alias("sparse"),
    )


def _number(value: str) -> str:
    return (
        f"case when {value} is null then '-' "
        f"when {value} = floor({value}) and abs({value}) < 1e15 "
        f"then format_number(bigint({value}), 0) "
        f"when abs({value}) < 1 then format_string('%.4f', double({value})) "
        f"else format_string('%.2f', double({value})) end"
    )


def _tail(count: str, word: str) -> str:
    return f"if({count} > 0, concat(format_number({count}, 0), ' {word}'), null)"


def column_summary() -> Column:
    """One line with the most telling statistics of a profile row."""
    n, t, b, s = (f"{k}." for k in (K.NUMERIC, K.TEMPORAL, K.BOOLEAN, K.STRING))
    numeric = (
        f"concat_ws(' · ', concat({_number(n + 'min')}, ' … ', {_number(n + 'max')}), "
        f"{_tail(n + 'negative_count', 'negative')}, {_tail(n + 'zero_count', 'zero')}, "
        f"{_tail(n + 'non_finite_count', 'NaN/Inf')})"
    )
    temporal = (
        f"concat_ws(' · ', concat(coalesce({t}min_iso, '-'), ' … ', coalesce({t}max_iso, '-')), "
        f"{_tail(t + 'future_count', 'future')}, {_tail(t + 'epoch_zero_count', 'at epoch')})"
    )
    boolean = (
        f"concat(format_number({b}true_count, 0), ' true · ', "
        f"format_number({b}false_count, 0), ' false')"
    )
    first = f"array_join(transform(slice({s}shapes, 1, 3), x -> x.shape), ', ')"
    text = (
        f"concat_ws(' · ', concat('len ', {_number(s + 'len_min')}, '-', {_number(s + 'len_max')}), "
        f"{_tail(s + 'empty_count', 'empty')}, {_tail(s + 'untrimmed_count', 'untrimmed')}, "
        f"if(size({s}shapes) > 0, concat('shapes: ', {first}), null))"
    )
    return F.expr(
        f"case when numeric is not null then {numeric} when temporal is not null then {temporal} "
        f"when boolean is not null then {boolean} when string is not null then {text} else '' end"
    )
