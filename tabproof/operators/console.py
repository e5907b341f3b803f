"""Ad-hoc SQL over the loaded tables."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
PAGE_ROWS = 50
STARTER_CHECKS = 25


@dataclass(frozen=True)
class Outcome:
    df: DataFrame
    columns: list[str]
    row_count: int
    ms: int


def run_sql(catalog, statement: str) -> Outcome:
    """Run a statement; its rows stay on the cluster, only their number comes back."""
    started = time.monotonic()
    df = catalog.spark.sql(statement)
    count = df.count()
    return Outcome(df, df.columns, count, round((time.monotonic() - started) * 1000))


def page(df: DataFrame, order: Sequence[str | Column], number: int, size: int = PAGE_ROWS) -> DataFrame:
    """One page of a result, with the number of all rows left to ``Outcome``."""
    return df.orderBy(*order).offset(number * size).limit(size)


def starter_checks(runs: DataFrame, limit: int = STARTER_CHECKS) -> DataFrame:
    """The first checks that ran, with the SQL text to start from."""
    return (
        runs.filter(F.col("sql").isNotNull())
        .orderBy("round", "position")
        .limit(limit)
        .select("round", "id", "title", "sql")
    )
