"""Column expressions that judge a file from its name, its ends and its size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LARGE_FILE_BYTES = 500 * 1024 * 1024
PARQUET_MAGIC = "PAR1"
EXTENSION_FORMATS = {
    "parquet": "parquet",
    "pq": "parquet",
    "csv": "csv",
    "tsv": "csv",
    "txt": "csv",
    "json": "json",
    "ndjson": "json",
    "jsonl": "json",
}


def format_from_extension(path: Column) -> Column:
    extension = F.lower(F.element_at(F.split(path, r"\."), -1))
    table = F.create_map(*[F.lit(x) for pair in EXTENSION_FORMATS.items() for x in pair])
    return F.try_element_at(table, extension)


def _latin1(data: Column) -> Column:
    """Bytes as text, one character per byte, so byte tests can be patterns."""
    return F.decode(data, "ISO-8859-1")


def sniff_format(head: Column) -> Column:
    """Format of a file from its first bytes; NULL when it is none we read."""
    text = _latin1(head)
    body = F.regexp_replace(text, r"^(?:\s|\xEF\xBB\xBF)+", "")
    first_line = F.regexp_extract(body, r"^([^\r\n]*)", 1)
    return (
        F.when(text.startswith(PARQUET_MAGIC), F.lit("parquet"))
        .when(F.instr(F.substring(text, 1, 512), "\0") > 0, F.lit(None).cast("string"))
        .when(body.rlike(r"^[{\[]"), F.lit("json"))
        .when(first_line.rlike(r"[,;\t|]"), F.lit("csv"))
    )


def file_problem(
    length: Column, head: Column, tail: Column, fmt: Column, expected: Column
) -> Column:
    """What is wrong with a file: empty, short, no_header, no_footer, or NULL."""
    parquet = fmt == "parquet"
    return (
        F.when(length == 0, F.lit("empty"))
        .when(length < expected, F.lit("short"))
        .when(parquet & ~_latin1(head).startswith(PARQUET_MAGIC), F.lit("no_header"))
        .when(
            parquet & ((length < 8) | (_latin1(tail) != PARQUET_MAGIC)),
            F.lit("no_footer"),
        )
    )

