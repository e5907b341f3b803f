"""Sketch aggregates over whole tables, merged in two steps.

A sketch is kilobytes where a count is eight bytes, and a table of many terabytes is
read by hundreds of thousands of tasks. Sent to one reducer, their sketches would be
the bottleneck, so tasks first merge into a fixed number of groups and only those meet.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_GROUP = "spark_partition_id() % 64"

# Sizes: 2 ** 12 buckets have a standard error of 1.04 / 2 ** 6 = 1.6 %; quantile
# sketches of 2000 have a rank error below 0.2 %.
DISTINCT_SIZE = 12
QUANTILE_SIZE = 2000

# Counts, sums and ends that one scan takes: few enough for an aggregate that is compiled.
PLAIN_PER_SCAN = 24

_MERGES = {
    "count": "coalesce(sum({0}), 0L)",
    "sum": "sum({0})",
    "min": "min({0})",
    "max": "max({0})",
}


def plain(sql: str) -> tuple[str, str]:
    """A count, sum, min or max: the aggregate itself and how its parts merge."""
    return sql, _MERGES[sql.split("(")[0].split("_")[0]]


def mean(value: str) -> tuple[str, str]:
    """Average of an expression; parts carry its sum and count."""
    return (
        f"named_struct('s', sum(double({value})), 'n', count({value}))",
        "try_divide(sum({0}.s), sum({0}.n))",
    )


def deviation(value: str) -> tuple[str, str]:
    """Sample standard deviation; parts carry count, mean and squared differences.

    The few parts are merged pairwise, which stays exact where sums of squares cancel.
    """
    part = (
        f"named_struct('n', double(count({value})), 'm', coalesce(avg(double({value})), 0d), "
        f"'d', coalesce(var_pop(double({value})), 0d) * count({value}))"
    )
    step = (
        "(a, p) -> if(a.n + p.n = 0, a, named_struct('n', a.n + p.n, "
        "'m', a.m + (p.m - a.m) * p.n / (a.n + p.n), "
        "'d', a.d + p.d + (p.m - a.m) * (p.m - a.m) * a.n * p.n / (a.n + p.n)))"
    )
    done = "a -> if(a.n > 1, sqrt(a.d / (a.n - 1)), null)"
    zero = "named_struct('n', 0d, 'm', 0d, 'd', 0d)"
    return part, f"aggregate(collect_list({{0}}), {zero}, {step}, {done})"


def distinct(columns: Sequence[str], size: int = DISTINCT_SIZE) -> tuple[str, str]:
    """Estimated distinct count of one expression, or of a combination.

    Values are hashed first, so any type can be sketched. A combination with NULLs in
    it counts; a single NULL does not.
    """
    value = f"xxhash64({', '.join(columns)})"
    if len(columns) == 1:
        value = f"if({columns[0]} is null, null, {value})"
    return (
        f"hll_sketch_agg({value}, {size})",
        "coalesce(hll_sketch_estimate(hll_union_agg({0})), 0L)",
    )


def smallest_digests(value: str, size: int) -> tuple[str, str]:
    """Sketch of an expression's distinct values: its ``2 ** size`` smallest digests. NULL is no value.

    Two sketches tell how many values two columns share, whatever the columns' types of text.
    """
    return (
        f"theta_sketch_agg(if(({value}) is null, null, xxhash64({value})), {size})",
        f"theta_union_agg({{0}}, {size})",
    )


def quantiles(value: str, probabilities: Sequence[float], size: int = QUANTILE_SIZE) -> tuple[str, str]:
    """Estimated quantiles of a numeric expression as an array; NULL without values.

    NaN is the largest value, as in exact quantiles; it comes out as infinity.
    """
    value = f"double({value})"
    value = f"if(isnan({value}), double('Infinity'), {value})"
    wanted = f"array({', '.join(f'{p}d' for p in probabilities)})"
    merged = "kll_merge_agg_double({0})"
    return (
        f"kll_sketch_agg_double({value}, {max(8, min(size, 65535))})",
        f"if(coalesce(kll_sketch_get_n_double({merged}), 0L) = 0, null, "
        f"kll_sketch_get_quantile_double({merged}, {wanted}))",
    )


def aggregate(df: DataFrame, stats: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row with the named aggregates of a frame, merged in two steps.

    Sketches keep a whole aggregate from being compiled, so all others have scans of their own, which cost far less.
    """
    heavy = [name for name, (part, _) in stats.items() if "_sketch_agg" in part]
    light = [name for name in stats if name not in set(heavy)]
    scans = [heavy] if heavy else []
    scans += [light[at : at + PLAIN_PER_SCAN] for at in range(0, len(light), PLAIN_PER_SCAN)]
    # One row each, so their product is one row.
    rows = reduce(DataFrame.crossJoin, [_aggregate(df, {name: stats[name] for name in scan}) for scan in scans])
    return rows.select(*stats)


def _aggregate(df: DataFrame, stats: Mapping[str, tuple[str, str]]) -> DataFrame:
    parts = ", ".join(f"'{name}', {part}" for name, (part, _) in stats.items())
    grouped = (
        df.groupBy(F.expr(_GROUP))
        .agg(F.expr(f"named_struct({parts})").alias("_parts"))
        .select("_parts.*")
    )
    return grouped.selectExpr(
        *[f"{merge.format(name)} as {name}" for name, (_, merge) in stats.items()]
    )
