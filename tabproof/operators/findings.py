"""Findings: what a round may pass on. Counts and known names, never engine text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
MAX_NOTE_LENGTH = 120
MAX_TITLE_LENGTH = 300
MAX_ROUNDS = 3
MAX_MENTIONED = 4

# Categories in the order they are tried. Spark's error conditions come
# first, because their names are exact; the patterns after them read message texts.
NOTE_RULES = (
    (r"\[unresolved_column", "unknown column"),
    (r"\[unresolved_routine", "unknown function"),
    (r"\[table_or_view_not_found", "unknown table"),
    (r"\[parse_syntax_error", "syntax error"),
    (r"\[(cast_invalid_input|datatype_mismatch|cast_overflow)", "type mismatch"),
    (r"\[(divide_by_zero|arithmetic_overflow|binary_arithmetic_overflow)", "arithmetic error"),
    (r"statement separator|comment or dollar-quote", "rejected by guard: separator or comment"),
    (r"can read external data", "rejected by guard: file or URL access"),
    (
        r"is not allowed in a row predicate|not allowed\.$",
        "rejected by guard: forbidden keyword or function",
    ),
    (r"unbalanced parentheses", "rejected by guard: unbalanced parentheses"),
    (r"unknown table", "unknown table"),
    (r"unknown column", "unknown column"),
    (r"types differ", "column types differ, so the comparison is not meaningful"),
    (r"column counts differ", "column counts differ"),
    (r"type mismatch", "type mismatch"),
)
OTHER_NOTE = "could not be evaluated"


def known_identifiers(columns: DataFrame) -> list[str]:
    """Every table and column name, from ``Catalog.columns``: one entry per column."""
    names = columns.select(F.explode(F.array("table", "name")).alias("n")).distinct()
    return [r["n"] for r in names.orderBy("n").collect()]


def note_category(reason: Column) -> Column:
    lower = F.lower(reason)
    category = None
    for pattern, name in NOTE_RULES:
        hit = lower.rlike(pattern)
        category = F.when(hit, F.lit(name)) if category is None else category.when(hit, F.lit(name))
    return category.otherwise(F.lit(OTHER_NOTE))


def sanitize_note(reason: Column, known: list[str]) -> Column:
    """A reason reduced to its category and the known names it mentions.

    Error messages quote cell values, so nothing else of the text is kept.
    """
    words = F.regexp_extract_all(reason, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    names = F.array(*[F.lit(k) for k in known]).cast("array<string>")
    mentioned = F.slice(F.array_intersect(words, names), 1, MAX_MENTIONED)
    category = note_category(reason)
    note = F.when(
        F.size(mentioned) > 0,
        F.concat(category, F.lit(" ("), F.array_join(mentioned, ", "), F.lit(")")),
    ).otherwise(category)
    return F.when(reason.isNotNull(), F.substring(note, 1, MAX_NOTE_LENGTH))


def to_findings(results: DataFrame, known: list[str]) -> DataFrame:
    """Checks joined with their results, reduced to what may be passed on.

    Needs the check fields, ``round``, and the result fields; drops SQL and reasons.
    """
    status = F.col("status")
    skipped = status == "skipped"
    return results.select(
        "round",
        "position",
        "id",
        "title",
        "kind",
        "table",
        "columns",
        "expression",
        "references_table",
        "references_columns",
        F.when(skipped, F.lit("not_run")).otherwise(status).alias("outcome"),
        F.when(~skipped, F.col("violations")).alias("violations"),
        F.when(~skipped, F.when(status == "falsified", F.col("pct")).otherwise(F.lit(0.0))).alias("pct"),
        F.when(~skipped, F.col("row_count")).alias("row_count"),
        F.when(skipped, sanitize_note(F.col("reason"), known)).alias("note"),
    )


def finding_leaks(findings: DataFrame) -> DataFrame:
    """Findings whose note may carry engine text: too long, or with a quote in it."""
    return findings.filter(
        (F.length("note") > MAX_NOTE_LENGTH) | F.col("note").rlike("['\"`]")
    )


class FindingsLeakError(ValueError):
    """A finding holds text that may carry a cell value."""


def assert_safe(findings: DataFrame) -> DataFrame:
    leak = finding_leaks(findings).select("id").first()
    if leak is not None:
        raise FindingsLeakError(f"The note of {leak['id']} may carry a value.")
    return findings


def bound_findings(
    findings: DataFrame, max_title: int = MAX_TITLE_LENGTH, max_findings: int | None = None
) -> DataFrame:
    """Findings a round may pass on, with titles cut to ``max_title`` characters.

    With ``max_findings``, the first so many of each round: a limit on what the next round
    reads, not on what was run.
    """
    short = findings.withColumn("title", F.substring("title", 1, max_title))
    if max_findings is None:
        return short
    first = Window.partitionBy("round").orderBy("position")
    ranked = short.withColumn("_rank", F.row_number().over(first))
    return ranked.filter(F.col("_rank") <= max_findings).drop("_rank")


def verdict_line() -> Column:
    """One line of a round's history."""
    # The words and columns of the line.
    pct = F.when(
        F.col("pct").isNotNull(), F.concat(F.lit(" ("), F.format_string("%.2f", "pct"), F.lit("%)"))
    ).otherwise("")
    return (
        F.when(
            F.col("outcome") == "holds",
            F.concat(F.lit("HELD        "), "title", F.lit("  ["), "kind", F.lit("]")),
        )
        .when(
            F.col("outcome") == "not_run",
            F.concat(F.lit("NOT RUN     "), "title", F.lit("  : "), F.coalesce("note", F.lit("unknown"))),
        )
        .otherwise(
            F.concat(
                F.lit("FALSIFIED   "),
                "title",
                F.lit("  : "),
                F.coalesce(F.format_number("violations", 0), F.lit("?")),
                F.lit(" rows"),
                pct,
            )
        )
    )
