"""Distinct counts of many columns in one grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tabproof.session import local_frame


def values_by_id(
    df: DataFrame, columns: Sequence[tuple[int, str]], id_name: str, value_name: str
) -> DataFrame:
    """One row ``(id, value)`` per row and SQL expression: columns turned on their side."""
    pairs = ", ".join(
        f"named_struct('{id_name}', {i}, '{value_name}', {sql})" for i, sql in columns
    )
    return df.selectExpr(f"inline(array({pairs}))")


def exact_distinct(df: DataFrame, columns: Sequence[tuple[int, tuple[str, str]]]) -> DataFrame:
    """Rows ``(id, ndv)``: exact distinct non-null values of each listed column.

    A column is given by two numbers that tell its values apart, see
    :func:`tabproof.functions.text.value_digest`. Several ``count(DISTINCT …)`` in one aggregate
    copy each row once per column, all columns wide. Grouping ``(id, a, b)`` shuffles 20 bytes for
    each distinct value that a task saw, however long its text, so a value that fills a
    third of the rows costs one row per task.
    """
    if not columns:
        return local_frame(df.sparkSession, [], "id int, ndv bigint")
    pairs = ", ".join(f"named_struct('id', {i}, 'a', {a}, 'b', {b})" for i, (a, b) in columns)
    return (
        df.selectExpr(f"inline(array({pairs}))")
        .filter(F.col("a").isNotNull())
        .distinct()
        .groupBy("id")
        .agg(F.count("*").alias("ndv"))
    )
