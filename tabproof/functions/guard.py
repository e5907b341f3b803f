"""Admission of predicate texts, as column expressions over a table of checks.

A predicate is pasted into plans we build, so it must be one boolean expression
over one table: no statements, no subqueries, nothing that reads a file or a URL
or calls into the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Length limit and the words, prefixes and suffixes refused.
MAX_EXPRESSION_LENGTH = 1000

BANNED_KEYWORDS = (
    "select", "from", "where", "join", "union", "intersect", "except", "with",
    "insert", "update", "delete", "merge", "drop", "create", "alter", "truncate",
    "attach", "detach", "copy", "install", "load", "pragma", "set", "reset",
    "call", "export", "import", "checkpoint", "vacuum", "analyze", "explain",
    "prepare", "execute", "deallocate", "describe", "summarize", "pivot",
    "unpivot", "grant", "revoke", "begin", "commit", "rollback",
)

BANNED_FUNCTIONS = (
    "glob", "getenv", "shell", "system", "query", "query_table", "sniff_csv",
    "sql_auto_complete", "duckdb_settings", "duckdb_extensions", "which_secret",
    "current_setting", "gen_random_uuid_v7",
)

BANNED_PREFIXES = ("read_", "scan_", "parquet_", "iceberg_", "delta_", "postgres_", "sqlite_", "mysql_")
BANNED_SUFFIXES = ("_scan", "_replacement_scan")

MARKERS = ("--", "/*", "*/", "$$")

# Spark functions that reach the JVM, the session or the file being read, or that
# exist to raise an error.
BANNED_SPARK_FUNCTIONS = (
    "reflect", "java_method", "try_reflect", "raise_error", "assert_true",
    "input_file_name", "input_file_block_start", "input_file_block_length",
    "current_user", "session_user", "user", "current_catalog", "current_database", "current_schema",
    "version", "spark_partition_id", "monotonically_increasing_id", "rand", "randn", "random", "uuid",
    "shuffle", "randstr", "uniform",
)

_PREFIXED = "^(" + "|".join(BANNED_PREFIXES) + ")"
_SUFFIXED = "(" + "|".join(BANNED_SUFFIXES) + r")\z"


#: Literals and quoted names, whichever opens first: one scan from left to right, as Spark reads them.
QUOTED = "'[^']*+'|\"[^\"]*+\"|`[^`]*+`"


def inert(expression: Column) -> Column:
    """The expression with quoted text replaced, so only live words are scanned."""
    return F.regexp_replace(expression, QUOTED, " ident ")


def _unbalanced(text: Column) -> Column:
    """True when a parenthesis closes before it opens, or stays open."""
    steps = F.transform(
        F.split(F.regexp_replace(text, "[^()]+", ""), ""),
        lambda c: F.when(c == "(", F.lit(1)).when(c == ")", F.lit(-1)).otherwise(F.lit(0)),
    )
    state = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest")),
        lambda acc, step: F.struct(
            (acc["depth"] + step).alias("depth"),
            F.least(acc["lowest"], acc["depth"] + step).alias("lowest"),
        ),
    )
    return (state["depth"] != 0) | (state["lowest"] < 0)


def _word_reason(token: Column) -> Column:
    return (
        F.when(
            token.isin(*BANNED_KEYWORDS),
            F.concat(F.lit('Keyword "'), token, F.lit('" is not allowed in a row predicate.')),
        )
        .when(
            token.isin(*BANNED_FUNCTIONS, *BANNED_SPARK_FUNCTIONS),
            F.concat(F.lit('Function "'), token, F.lit('" is not allowed.')),
        )
        .when(
            token.rlike(_PREFIXED) | token.rlike(_SUFFIXED),
            F.concat(F.lit('Identifier "'), token, F.lit('" can read external data.')),
        )
    )


def trimmed(expression: Column) -> Column:
    return F.regexp_replace(expression, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+\z", "")


def expression_reason(expression: Column) -> Column:
    """Why an expression is refused, or NULL when it is admitted."""
    text = trimmed(expression)
    # Nothing past the limit is scanned: such a text has been refused already.
    live = inert(F.when(F.length(text) <= MAX_EXPRESSION_LENGTH, text))
    words = F.regexp_extract_all(F.lower(live), F.lit("[a-z_][a-z0-9_]*"), F.lit(0))
    reasons = F.filter(F.transform(words, _word_reason), lambda r: r.isNotNull())

    reason = F.when(text == "", F.lit("Empty expression.")).when(
        F.length(text) > MAX_EXPRESSION_LENGTH,
        F.lit(f"Expression longer than {MAX_EXPRESSION_LENGTH} characters."),
    )
    # Spark ends a literal differently when a backslash stands before the quote,
    # so what looks quoted here might be live there.
    reason = reason.when(
        text.rlike(r"""\\['"`]"""), F.lit("Backslash before a quote is not allowed.")
    )
    reason = reason.when(
        F.contains(live, F.lit(";")), F.lit("Statement separator (;) is not allowed.")
    )
    for marker in MARKERS:
        reason = reason.when(
            F.contains(live, F.lit(marker)),
            F.lit(f"Comment or dollar-quote marker ({marker}) is not allowed."),
        )
    reason = reason.when(live.rlike("""['"`]"""), F.lit("Unclosed quote."))
    return reason.when(_unbalanced(live), F.lit("Unbalanced parentheses.")).otherwise(
        F.try_element_at(reasons, F.lit(1))
    )


def columns_reason(columns: Column, known: Column) -> Column:
    """Why a column list is refused, or NULL. ``known`` holds the table's columns."""
    unknown = F.filter(columns, lambda c: ~F.array_contains(known, c))
    return F.when(F.size(columns) == 0, F.lit("No columns given.")).when(
        F.size(unknown) > 0,
        F.concat(F.lit("Unknown column(s): "), F.array_join(unknown, ", "), F.lit(".")),
    )


_LIVE_CALL = re.compile(r"([A-Za-z_][\w.]*|0q)\s*\(")


def called_names(expression: str) -> set[str]:
    """Lower-case names before a parenthesis, ``0q`` for a quoted one."""

    def stand_in(match: re.Match[str]) -> str:
        return " " if match[0].startswith("'") else " 0q "

    live = re.sub(r"""'[^']*'|"[^"]*"|`[^`]*`""", stand_in, expression)
    return {name.lower() for name in _LIVE_CALL.findall(live)}


_QUOTED = re.compile(r"""'(?:[^']|'')*'|"((?:[^"]|"")*)"|`(?:[^`]|``)*`""")


def spark_expression(expression: str) -> str:
    """An admitted predicate, in the quoting Spark reads by default.

    Double quotes name columns and backslashes in literals stand for themselves,
    whatever the session's parser settings are.
    """

    def requote(match: re.Match[str]) -> str:
        text = match.group(0)
        if text.startswith('"'):
            return "`" + match.group(1).replace('""', '"').replace("`", "``") + "`"
        if text.startswith("`") or "\\" not in text:
            return text
        if "''" in text[1:-1]:
            return text.replace("\\", "\\\\")
        return "r" + text

    return _QUOTED.sub(requote, expression.strip())

