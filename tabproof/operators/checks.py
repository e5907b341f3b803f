"""Checks as rows: their flat form, normalisation, identity and wording."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tabproof.functions.guard import spark_expression
from tabproof.functions.text import quote_name
from tabproof.plans.numbering import number_within
from tabproof.session import local_frame

# Fixed values.
SEVERITIES = ("high", "medium", "low")
KINDS = ("row_predicate", "unique", "references")

CHECK_SCHEMA = (
    "position bigint, title string, rationale string, severity string, kind string, "
    "table string, columns array<string>, expression string, "
    "references_table string, references_columns array<string>"
)


@dataclass(frozen=True)
class Check:
    """One admitted check, as the planner on the driver needs it."""

    id: str
    kind: str
    table: str
    columns: tuple[str, ...] = ()
    expression: str = ""
    references_table: str = ""
    references_columns: tuple[str, ...] = ()

    @classmethod
    def from_row(cls, row: Row) -> Check:
        return cls(
            row["id"],
            row["kind"],
            row["table"],
            tuple(row["columns"] or ()),
            row["expression"] or "",
            row["references_table"] or "",
            tuple(row["references_columns"] or ()),
        )

    def sql(self) -> str:
        """The counting query of this check, to start an ad-hoc look from."""
        if self.kind == "row_predicate":
            expression = spark_expression(self.expression)
            return (
                f"SELECT count(*) AS violations FROM {self.table} "
                f"WHERE NOT coalesce(({expression}), true)"
            )
        if self.kind == "unique":
            keys = ", ".join(quote_name(c) for c in self.columns)
            return (
                "SELECT coalesce(sum(n), 0) AS violations FROM ("
                f"SELECT count(*) AS n FROM {self.table} GROUP BY {keys} HAVING count(*) > 1)"
            )
        present = " AND ".join(f"child.{quote_name(c)} IS NOT NULL" for c in self.columns)
        same = " AND ".join(
            f"parent.{quote_name(p)} = child.{quote_name(c)}"
            for c, p in zip(self.columns, self.references_columns)
        )
        return (
            f"SELECT count(*) AS violations FROM {self.table} AS child WHERE {present} "
            f"AND NOT EXISTS (SELECT 1 FROM {self.references_table} AS parent WHERE {same})"
        )


def checks_frame(spark: SparkSession, checks: Sequence[Mapping]) -> DataFrame:
    """Checks written by hand, as rows in their flat form; unused fields may be left out."""
    empty = dict(
        title="", rationale="", severity="medium", kind="row_predicate", table="", columns=[],
        expression="", references_table="", references_columns=[],
    )
    rows = []
    for i, check in enumerate(checks):
        full = {**empty, **check, "position": i + 1}
        rows.append(tuple(full[f.split()[0]] for f in CHECK_SCHEMA.split(", ")))
    return local_frame(spark, rows, CHECK_SCHEMA)


def normalize_checks(wire: DataFrame) -> DataFrame:
    """Trim the texts, drop malformed checks, give each an id from its position."""
    blank = {c: F.coalesce(F.trim(c), F.lit("")) for c in ("table", "expression", "references_table")}
    columns = F.coalesce("columns", F.array().cast("array<string>"))
    references = F.coalesce("references_columns", F.array().cast("array<string>"))
    usable = (
        F.when(blank["table"] == "", F.lit(False))
        .when(F.col("kind") == "unique", F.size(columns) > 0)
        .when(
            F.col("kind") == "references",
            (blank["references_table"] != "")
            & (F.size(columns) > 0)
            & (F.size(columns) == F.size(references)),
        )
        .when(F.col("kind") == "row_predicate", blank["expression"] != "")
        .otherwise(F.lit(False))
    )
    none = F.array().cast("array<string>")
    kind = F.col("kind")
    return wire.filter(usable).select(
        "position",
        F.concat(F.lit("h"), F.col("position").cast("string")).alias("id"),
        F.trim("title").alias("title"),
        F.trim("rationale").alias("rationale"),
        "severity",
        "kind",
        blank["table"].alias("table"),
        F.when(kind != "row_predicate", columns).otherwise(none).alias("columns"),
        F.when(kind == "row_predicate", blank["expression"]).otherwise("").alias("expression"),
        F.when(kind == "references", blank["references_table"]).otherwise("").alias("references_table"),
        F.when(kind == "references", references).otherwise(none).alias("references_columns"),
    )


def number_round(checks: DataFrame, round_no: int) -> DataFrame:
    """Replace the ids by ``r{round}h{i}``, which stay unique over all rounds."""
    numbered = number_within(checks, [], "position", "_i")
    name = F.format_string("r%dh%d", F.lit(round_no), F.col("_i"))
    return numbered.withColumn("id", name).withColumn("round", F.lit(round_no)).drop("_i")


def tables_touched() -> Column:
    """Every table a check reads."""
    return F.when(
        F.col("kind") == "references", F.array("table", "references_table")
    ).otherwise(F.array("table"))


def is_cross_table() -> Column:
    return (F.col("kind") == "references") & (F.col("table") != F.col("references_table"))


def check_text() -> Column:
    """The check in one line."""
    columns = F.array_join("columns", ", ")
    return (
        F.when(
            F.col("kind") == "unique",
            F.concat(F.lit("UNIQUE ("), columns, F.lit(") in "), F.col("table")),
        )
        .when(
            F.col("kind") == "references",
            F.concat(
                "table",
                F.lit("("),
                columns,
                F.lit(") → "),
                "references_table",
                F.lit("("),
                F.array_join("references_columns", ", "),
                F.lit(")"),
            ),
        )
        .otherwise(F.col("expression"))
    )


def check_key() -> Column:
    """A text that two checks share exactly when they ask the same thing.

    Key columns may come in any order, as long as references pair the same columns.
    """
    pairs = F.array_sort(
        F.transform(
            F.arrays_zip("columns", "references_columns"),
            lambda p: F.concat_ws("=", p["columns"], p["references_columns"]),
        )
    )
    return F.concat_ws(
        "|",
        "kind",
        "table",
        F.when(F.col("kind") == "unique", F.array_join(F.array_sort("columns"), ","))
        .when(F.col("kind") == "references", F.array_join(pairs, ","))
        .otherwise(F.regexp_replace(F.trim("expression"), r"\s+", " ")),
        F.coalesce("references_table", F.lit("")),
    )
