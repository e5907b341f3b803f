"""Readers for the three source formats."""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabproof.functions.text import quote_name
from tabproof.sources.files import file_ends

FORMATS = ("parquet", "csv", "json")
_SEPARATORS = ",;\t|"
_CORRUPT = "_malformed"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class MalformedRows(ValueError):
    """A text source has rows that do not fit its columns."""


def _first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).filter(F.length(F.trim("value")) > 0).first()
    return row["value"].lstrip("\ufeff") if row else ""


def _fields(line: str, sep: str) -> list[str]:
    return next(csv.reader([line], delimiter=sep), [])


def _looks_like_names(fields: list[str]) -> bool:
    """Whether a first line names columns: no field is empty, a number, a date, a boolean or repeated."""
    value = re.compile(r"\s*([+-]?[0-9.,]+([eE][+-]?[0-9]+)?|\d{4}-\d\d-\d\d.*|true|false|null|)\s*", re.IGNORECASE)
    return bool(fields) and len(set(fields)) == len(fields) and not any(value.fullmatch(f) for f in fields)


def _spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether some line has an odd number of quotes, so that a quoted field goes on in the next one."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return spark.read.text(path).filter(quotes % 2 == 1).first() is not None


def read_csv(
    spark: SparkSession,
    path: str,
    *,
    schema: T.StructType | None = None,
    sep: str | None = None,
    header: bool | None = None,
    multi_line: bool | None = None,
    malformed: str = "raise",
) -> DataFrame:
    """CSV; separator, header line, line breaks in quotes and types are found out unless given.

    Without a header line columns are ``column0``, ``column1``, … Inference keeps a column as text when
    one of its numbers starts with a padding zero: reading ``0001`` as 1 would hide a key
    typed differently in two files. Rows with too few or too many fields, or with values that a given schema
    cannot hold, raise :class:`MalformedRows`; ``malformed="keep"`` pads and cuts them instead.
    What is found out costs passes over the files, so give all options for large inputs; files
    with line breaks in quotes cannot be split.
    """
    line = "" if sep and header is not None else _first_line(spark, path)
    sep = sep or max(_SEPARATORS, key=line.count)
    header = _looks_like_names(_fields(line, sep)) if header is None else header
    multi_line = _spans_lines(spark, path) if multi_line is None else multi_line
    options = dict(header=header, sep=sep, quote='"', escape='"', multiLine=multi_line)
    if schema is None:
        schema = spark.read.csv(path, inferSchema=True, **options).schema
        if not header:
            schema = T.StructType([T.StructField(f"column{i}", f.dataType) for i, f in enumerate(schema.fields)])
        numbers = [f.name for f in schema.fields if isinstance(f.dataType, T.NumericType)]
        if numbers:
            texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
            padded = (
                spark.read.csv(path, schema=texts, **options)
                .agg(*[F.max(F.col(quote_name(n)).rlike(r"^[+-]?0\d")).alias(n) for n in numbers])
                .first()
            )
            schema = T.StructType(
                [
                    T.StructField(f.name, T.StringType())
                    if f.name in numbers and padded[f.name]
                    else f
                    for f in schema.fields
                ]
            )
    if malformed == "raise":
        marked = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
        # With pruning, a row would only be parsed as far as the columns asked for.
        reader = spark.read.option("columnPruning", "false")
        checked = reader.csv(path, schema=marked, columnNameOfCorruptRecord=_CORRUPT, **options)
        first = F.col(quote_name(schema.names[0]))
        bad = checked.agg(F.count_if(F.col(_CORRUPT).isNotNull()), F.count(first)).first()[0]
        if bad:
            raise MalformedRows(f"{path}: {bad} row(s) do not fit the {len(schema.fields)} columns.")
    return spark.read.csv(path, schema=schema, **options)


def _without_corrupt(path: str, part: DataFrame) -> DataFrame:
    """A JSON frame whose records have all been found to be JSON."""
    if _CORRUPT not in part.columns:
        return part
    others = [c for c in part.columns if c != _CORRUPT]
    if not others:
        raise MalformedRows(f"{path}: no record is JSON.")
    bad = part.agg(F.count_if(F.col(_CORRUPT).isNotNull()), F.count(quote_name(others[0]))).first()[0]
    if bad:
        raise MalformedRows(f"{path}: {bad} record(s) are not JSON.")
    return part.drop(_CORRUPT)


def read_json(
    spark: SparkSession, path: str, *, schema: T.StructType | None = None, malformed: str = "raise"
) -> DataFrame:
    """JSON lines, arrays of objects and pretty-printed objects, in any mixture of files.

    Each file is read as what its own first bytes are. Records that are not JSON raise
    :class:`MalformedRows`; ``malformed="keep"`` returns them in a column of their own.
    """
    head = F.regexp_replace(F.decode("head", "ISO-8859-1"), r"^(?:\s|\xEF\xBB\xBF)+", "")
    first = F.rtrim(F.regexp_extract(head, r"^([^\r\n]*)", 1))
    # An object whose first line does not end it goes on over several lines.
    pretty = head.startswith("{") & ~first.endswith("}") & head.contains("\n")
    whole = (head.startswith("[") | pretty).alias("whole")
    found = file_ends(spark, path).filter("length > 0").select("path", whole).collect()
    given = None if schema is None else T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    parts = []
    for kind in (False, True):
        files = [r["path"] for r in found if r["whole"] == kind]
        if files:
            reader = spark.read if given is None else spark.read.schema(given)
            parts.append(reader.json(files, multiLine=kind, columnNameOfCorruptRecord=_CORRUPT))
    if not parts:
        return spark.read.json(path) if schema is None else spark.read.schema(schema).json(path)
    if malformed == "raise":
        parts = [_without_corrupt(path, part) for part in parts]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_source(
    spark: SparkSession, path: str, fmt: str, schema: T.StructType | None = None, **options
) -> DataFrame:
    """A source of any format; ``options`` are those of its reader."""
    if fmt == "parquet":
        return read_parquet(spark, path)
    if fmt == "csv":
        return read_csv(spark, path, schema=schema, **options)
    if fmt == "json":
        return read_json(spark, path, schema=schema, **options)
    raise ValueError(f"Unknown format {fmt!r}; expected one of {', '.join(FORMATS)}.")
