"""Row numbers within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_within(
    df: DataFrame, groups: Sequence[str], position: str, name: str, *, width: int = 100_000
) -> DataFrame:
    """Add ``name``: 1, 2, … within each group in the order of ``position``.

    ``position`` is a unique whole number. Rows are numbered inside slices of
    ``width`` positions, then shifted by the sizes of the slices before, so no task
    sorts more than ``width`` rows however large a group is.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(position) / F.lit(width)))
    keys = [*groups, "_slice"]
    before = Window.partitionBy(*groups).orderBy("_slice")
    shifts = (
        sliced.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .withColumn("_shift", F.sum("_n").over(before) - F.col("_n"))
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_shift")
    )
    within = Window.partitionBy(*keys).orderBy(position)
    numbered = sliced.withColumn("_at", F.row_number().over(within))
    on = F.lit(True)
    for i, key in enumerate(keys):
        on = on & numbered[key].eqNullSafe(shifts[f"_k{i}"])
    return numbered.join(shifts, on).select(
        *[numbered[c] for c in df.columns], (F.col("_at") + F.col("_shift")).alias(name)
    )
