"""Narrowing: which values of which columns a violation is confined to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabproof.functions import types as K
from tabproof.functions.text import quote_name, quote_text
from tabproof.operators.checks import Check
from tabproof.operators.evaluate import violates, violating_rows
from tabproof.plans import sketches
from tabproof.session import local_frame, saved

MAX_VALUES = 50
TIME_BUCKET = "month"


def dimension_sizes(df: DataFrame) -> dict[str, int]:
    """Sketched numbers of values of the columns that may be dimensions, dates apart.

    One pass with small sketches, so wide tables cost no more than one scan. Those above
    the limit given to :func:`dimensions` are the ones it leaves out.
    """
    plain = [
        f.name
        for f in df.schema.fields
        if K.column_class(f.dataType) in (K.STRING, K.BOOLEAN) or K.is_integral(f.dataType)
    ]
    if not plain:
        return {}
    stats = {f"n{i}": sketches.distinct([quote_name(c)]) for i, c in enumerate(plain)}
    row = sketches.aggregate(df, stats).first()
    return {c: row[f"n{i}"] for i, c in enumerate(plain)}


def dimensions(df: DataFrame, *, max_values: int | None = MAX_VALUES) -> list[str]:
    """Columns with at most ``max_values`` values (None: any number), and date columns.

    What a violation may be confined to; :func:`dimension_sizes` tells what was left out, and
    :func:`worst_values` narrows to the values of those.
    """
    few = {c for c, n in dimension_sizes(df).items() if max_values is None or n <= max_values}
    dates = {f.name for f in df.schema.fields if K.column_class(f.dataType) == K.TEMPORAL}
    return [c for c in df.columns if c in few | dates]


def _by_dimension(df: DataFrame, dims: Sequence[str], bucket: str, extra: Sequence[str] = ()) -> DataFrame:
    """One row ``(dim, value, …extra)`` per row and dimension."""
    pairs = []
    for name in dims:
        sql = quote_name(name)
        if K.column_class(df.schema[name].dataType) == K.TEMPORAL:
            sql = f"date_format(date_trunc('{bucket}', {sql}), 'yyyy-MM-dd')"
        fields = "".join(f", '{e}', {e}" for e in extra)
        pairs.append(f"named_struct('dim', {quote_text(name)}, 'value', string({sql}){fields})")
    return df.selectExpr(f"inline(array({', '.join(pairs)}))")


def _with_lift(counts: DataFrame) -> DataFrame:
    """Add ``rate`` and ``lift``. Every dimension covers all rows, so each gives the total."""
    # One row per dimension, so broadcast: the values of one dimension need not meet.
    whole = counts.groupBy(F.col("dim").alias("_dim")).agg(
        (F.sum("violations") / F.sum("rows")).alias("_overall")
    )
    rate = F.col("violations") / F.col("rows")
    return (
        counts.join(F.broadcast(whole), F.col("dim") == F.col("_dim"))
        .withColumn("rate", rate)
        .withColumn("lift", F.when(F.col("_overall") > 0, rate / F.col("_overall")).otherwise(0.0))
        .drop("_dim", "_overall")
    )


def narrow_predicate(
    df: DataFrame, expression: str, dims: Sequence[str] | None = None, *, bucket: str = TIME_BUCKET
) -> DataFrame:
    """``(dim, value, rows, violations, rate, lift)`` of a row predicate, in one pass."""
    dims = dimensions(df) if dims is None else list(dims)
    flagged = df.withColumn("_bad", F.when(violates(expression), 1).otherwise(0))
    counts = (
        _by_dimension(flagged, dims, bucket, ["_bad"])
        .groupBy("dim", "value")
        .agg(F.count("*").alias("rows"), F.sum("_bad").alias("violations"))
    )
    return _with_lift(counts)


def narrow_rows(
    df: DataFrame, bad: DataFrame, dims: Sequence[str] | None = None, *, bucket: str = TIME_BUCKET
) -> DataFrame:
    """The same for violating rows found by any other check."""
    dims = dimensions(df) if dims is None else list(dims)
    both = _by_dimension(df, dims, bucket).withColumn("_bad", F.lit(0)).unionByName(
        _by_dimension(bad, dims, bucket).withColumn("_bad", F.lit(1))
    )
    counts = both.groupBy("dim", "value").agg(
        F.sum(1 - F.col("_bad")).alias("rows"), F.sum("_bad").alias("violations")
    )
    return _with_lift(counts)


def narrow_check(
    catalog, check: Check, dims: Sequence[str] | None = None, *, bucket: str = TIME_BUCKET
) -> DataFrame:
    """Violation rate and lift of a falsified check, per dimension value."""
    df = catalog.frame(check.table)
    if check.kind == "row_predicate":
        return narrow_predicate(df, check.expression, dims, bucket=bucket)
    bad = violating_rows(catalog, check, limit=None)
    return narrow_rows(df, bad, dims, bucket=bucket)


def worst_values(
    catalog, check: Check, columns: Sequence[str] | None = None, *, keep: int = MAX_VALUES, bucket: str = TIME_BUCKET
) -> DataFrame:
    """``(dim, value, rest, rows, violations, rate, lift)`` for columns of any number of values.

    Each column has its ``keep`` values with most violations (ties: the least as text, NULL first), and one row with ``rest``
    and no value for all its other rows. By default these are the columns that :func:`dimensions` leaves out.
    Only the values of violating rows are grouped. The kept ones are ``keep`` a column at most, so they are
    broadcast, and the whole table is then counted without shuffling a value.
    """
    df = catalog.frame(check.table)
    if columns is None:
        few = set(dimensions(df))
        columns = [c for c in dimension_sizes(df) if c not in few]
    if not columns:
        return local_frame(
            df.sparkSession,
            [], "dim string, value string, rest boolean, `rows` bigint, violations bigint, rate double, lift double"
        )
    if check.kind == "row_predicate":
        flagged = df.withColumn("_bad", F.when(violates(check.expression), 1).otherwise(0))
        pairs = _by_dimension(flagged, columns, bucket, ["_bad"]).withColumn("_row", F.lit(1))
        bad = pairs.where("_bad = 1")
    else:
        # Violating rows come from the check once; they are counted beside the table's own rows.
        bad = _by_dimension(violating_rows(catalog, check, limit=None), columns, bucket)
        bad = bad.withColumn("_bad", F.lit(1)).withColumn("_row", F.lit(0))
        whole = _by_dimension(df, columns, bucket).withColumn("_bad", F.lit(0)).withColumn("_row", F.lit(1))
        pairs = whole.unionByName(bad)
    best = Window.partitionBy("dim").orderBy(F.desc("n"), F.asc_nulls_first("value"))
    worst = (
        bad.groupBy("dim", "value").agg(F.count("*").alias("n"))
        .withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= keep)
        .select(F.col("dim").alias("_dim"), F.col("value").alias("_value"))
    )
    worst = F.broadcast(saved(worst)).withColumn("_kept", F.lit(True))
    met = pairs.join(worst, (F.col("dim") == F.col("_dim")) & F.col("value").eqNullSafe(F.col("_value")), "left")
    rest = F.col("_kept").isNull()
    counts = (
        met.withColumn("rest", rest).withColumn("value", F.when(rest, None).otherwise(F.col("value")))
        .groupBy("dim", "value", "rest").agg(F.sum("_row").alias("rows"), F.sum("_bad").alias("violations"))
    )
    return _with_lift(counts)
