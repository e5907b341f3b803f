"""Run tables: totals, falsified checks, details, data inventory, rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabproof.operators.checks import check_text, is_cross_table, normalize_checks, number_round, tables_touched
from tabproof.operators.evaluate import evaluate_checks
from tabproof.operators.findings import MAX_ROUNDS, assert_safe, known_identifiers, to_findings


def run_round(catalog, wire: DataFrame, round_no: int, runs: DataFrame | None = None) -> DataFrame:
    """Evaluate one round of checks and append it to the earlier rounds' results.

    Rows are keyed by ``(round, id)``. Nothing is stored before its finding is safe.
    """
    if round_no > MAX_ROUNDS:
        raise ValueError(f"Already at the maximum of {MAX_ROUNDS} rounds.")
    checks = number_round(normalize_checks(wire), round_no)
    results = evaluate_checks(catalog, checks)
    # One row per check on both sides.
    done = checks.join(F.broadcast(results), "id", "left")
    assert_safe(to_findings(done, known_identifiers(catalog.columns())))
    return done if runs is None else runs.unionByName(done)


def run_totals(runs: DataFrame) -> DataFrame:
    """One row: rounds, checks, and how many were falsified, held or not run."""
    return runs.agg(
        F.count_distinct("round").alias("rounds"),
        F.count("*").alias("checks"),
        F.count_if(F.col("status") == "falsified").alias("falsified"),
        F.count_if(F.col("status") == "holds").alias("held"),
        F.count_if(F.col("status") == "skipped").alias("not_run"),
        F.coalesce(F.sum("ms"), F.lit(0)).alias("ms"),
    )


def falsified(runs: DataFrame) -> DataFrame:
    """Falsified checks with their shares."""
    return runs.filter(F.col("status") == "falsified").select(
        "round", "id", "title", "violations", "row_count", "pct"
    )


def rounds(runs: DataFrame) -> DataFrame:
    """The distinct rounds, ascending."""
    return runs.select("round").distinct().orderBy("round")


def falsified_by_round(runs: DataFrame) -> DataFrame:
    return runs.groupBy("round").agg(
        F.count_if(F.col("status") == "falsified").alias("falsified")
    )


def check_details(runs: DataFrame) -> DataFrame:
    """One row per check with its verdict, wording and the tables it reads."""
    verdict = (
        F.when(F.col("status") == "holds", F.lit("HOLDS"))
        .when(F.col("status") == "falsified", F.lit("FALSIFIED"))
        .when(F.col("status") == "skipped", F.lit("NOT RUN"))
        .otherwise(F.lit("not tested"))
    )
    return runs.select(
        "round",
        "id",
        verdict.alias("verdict"),
        "title",
        "severity",
        is_cross_table().alias("cross_table"),
        F.array_join(tables_touched(), " · ").alias("tables"),
        "violations",
        "row_count",
        "pct",
        "reason",
        "rationale",
        check_text().alias("check"),
    )


def data_inventory(catalog) -> DataFrame:
    """One row per table: name, source, rows, columns, size, and its columns as text."""
    described = (
        catalog.columns()
        .groupBy("table")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("ordinal", "name", "type"))),
                    lambda c: F.concat(c["name"], F.lit(" ("), c["type"], F.lit(")")),
                ),
                ", ",
            ).alias("column_list")
        )
    )
    return catalog.inventory().join(F.broadcast(described), "table")
