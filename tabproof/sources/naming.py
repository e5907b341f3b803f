"""Table names for a manifest of labelled files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabproof.functions.naming import base_table_name, is_safe_table_name
from tabproof.plans.numbering import number_within


def assign_table_names(manifest: DataFrame, label: str = "label", position: str = "position") -> DataFrame:
    """Add ``base``, ``table`` and ``safe`` to a manifest with unique whole positions.

    The first file with a base name keeps it, later ones get ``_2``, ``_3``, … in the
    order of their positions. Any number of files may share one base name.
    """
    based = manifest.withColumn("base", base_table_name(F.col(label)))
    numbered = number_within(based, ["base"], position, "copy")
    table = F.when(F.col("copy") == 1, F.col("base")).otherwise(
        F.concat_ws("_", "base", F.col("copy").cast("string"))
    )
    return (
        numbered.withColumn("table", table)
        .withColumn("safe", is_safe_table_name(F.col("table")))
        .drop("copy")
    )

