"""Predicate functions Spark has under another name, as session SQL functions.

They are plain SQL bodies that Catalyst inlines, so they cost what their built-in
counterparts cost.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Strftime directives and the matching date_format letters.
_DIRECTIVES = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%d": "dd",
    "%H": "HH",
    "%I": "hh",
    "%M": "mm",
    "%S": "ss",
    "%j": "DDD",
    "%b": "MMM",
    "%B": "MMMM",
    "%a": "EEE",
    "%A": "EEEE",
    "%p": "a",
}


def _strftime_body() -> str:
    """SQL that writes a moment by a pattern, token by token.

    Literal runs are quoted, so their letters are not read as pattern letters, and ``%%`` is a
    percent sign. An unknown directive raises, as guessing would change verdicts.
    """
    letters = " ".join(f"when '{d}' then date_format(moment, '{letter}')" for d, letter in _DIRECTIVES.items())
    tokens = "regexp_extract_all(pattern, r'(?s)%.?|[^%]+', 0)"
    written = (
        f"case when token = '%%' then '%' when not startswith(token, '%') then token else case token {letters} "
        "else raise_error(concat('Unknown directive in strftime: ', token)) end end"
    )
    return f"array_join(transform({tokens}, token -> {written}), '')"


def register_dialect(spark: SparkSession) -> None:
    """Make ``regexp_matches`` and ``strftime`` usable in predicates."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION regexp_matches(text STRING, pattern STRING) "
        "RETURNS BOOLEAN RETURN regexp_like(text, pattern)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION strftime(moment TIMESTAMP_NTZ, pattern STRING) "
        f"RETURNS STRING RETURN if(moment is null, null, {_strftime_body()})"
    )
