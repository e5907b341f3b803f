"""A set of named tables: loading, describing, counting."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabproof.functions.dialect import register_dialect

from tabproof.functions.files import file_problem
from tabproof.functions.naming import base_table_name
from tabproof.functions.types import column_class, type_family
from tabproof.sources.files import detect_formats, file_ends, list_files, size_warnings
from tabproof.sources.readers import MalformedRows, read_source
from tabproof.session import local_frame

TABLES_SCHEMA = "table string, label string, format string, rows bigint, columns int, bytes bigint"
COLUMNS_SCHEMA = (
    "table string, ordinal int, name string, type string, class string, family string"
)


class SourceError(ValueError):
    """A source cannot be loaded; the message names the source and the problem."""


@dataclass(frozen=True)
class Source:
    """Where a table comes from. Format and table name are found out when left out."""

    path: str
    label: str | None = None
    format: str | None = None
    table: str | None = None
    schema: T.StructType | None = None
    #: Of the reader: sep, header, multi_line, malformed.
    options: Mapping[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Table:
    table: str
    label: str
    format: str
    df: DataFrame
    path: str | None = None


@dataclass
class Catalog:
    """Named tables of one session. Each is also a temporary view of that name."""

    spark: SparkSession
    tables: list[Table]
    #: What a load found odd but loadable, in words.
    warnings: list[str] = field(default_factory=list)
    _rows: dict[str, int] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        register_dialect(self.spark)
        for entry in self.tables:
            entry.df.createOrReplaceTempView(entry.table)

    @classmethod
    def from_frames(cls, spark: SparkSession, frames: Mapping[str, DataFrame]) -> Catalog:
        return cls(spark, [Table(n, n, "parquet", df) for n, df in frames.items()])

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str, names: Iterable[str]) -> Catalog:
        """Tables kept as ``folder/<name>.parquet``."""
        tables = []
        for name in names:
            path = f"{folder.rstrip('/')}/{name}.parquet"
            tables.append(Table(name, f"{name}.parquet", "parquet", spark.read.parquet(path), path))
        return cls(spark, tables)

    @property
    def names(self) -> list[str]:
        return [t.table for t in self.tables]

    def frame(self, table: str) -> DataFrame:
        return next(t.df for t in self.tables if t.table == table)

    def persist(self, *names: str) -> Catalog:
        """Keep the named tables (all, by default) in executor storage."""
        for entry in self.tables:
            if not names or entry.table in names:
                entry.df.persist()
        return self

    def close(self) -> None:
        for entry in self.tables:
            entry.df.unpersist()
            self.spark.catalog.dropTempView(entry.table)

    def columns(self) -> DataFrame:
        """One row per column: table, ordinal, name, type, class, family."""
        rows = [
            (t.table, i, f.name, f.dataType.simpleString(), column_class(f.dataType), type_family(f.dataType))
            for t in self.tables
            for i, f in enumerate(t.df.schema.fields)
        ]
        return local_frame(self.spark, rows, COLUMNS_SCHEMA)

    def schemas(self) -> dict[str, T.StructType]:
        return {t.table: t.df.schema for t in self.tables}

    def count_rows(self, names: Iterable[str] | None = None) -> DataFrame:
        """``(table, rows)`` of the named tables, or all, in one job that reads no column."""
        wanted = self.names if names is None else list(names)
        return reduce(
            DataFrame.unionByName,
            [
                self.frame(n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows")
                for n in wanted
            ],
        )

    def row_counts(self, names: Iterable[str] | None = None) -> dict[str, int]:
        """Rows of the named tables, or all; each table is counted once."""
        wanted = self.names if names is None else list(names)
        missing = [n for n in wanted if n not in self._rows]
        if missing:
            self._rows |= {r["table"]: r["rows"] for r in self.count_rows(missing).collect()}
        return {n: self._rows[n] for n in wanted}

    def bytes(self) -> DataFrame:
        """``(table, bytes)``: size of each table's files."""
        sized = [t for t in self.tables if t.path]
        if not sized:
            return local_frame(self.spark, [], "table string, bytes bigint")
        return reduce(
            DataFrame.unionByName,
            [
                list_files(self.spark, t.path)
                .agg(F.sum("length").alias("bytes"))
                .select(F.lit(t.table).alias("table"), "bytes")
                for t in sized
            ],
        )

    def inventory(self) -> DataFrame:
        """One row per table: table, label, format, rows, columns, bytes."""
        listed = local_frame(
            self.spark,
            [(t.table, t.label, t.format, len(t.df.columns)) for t in self.tables],
            "table string, label string, format string, columns int",
        )
        return (
            listed.join(self.count_rows(), "table", "left")
            .join(self.bytes(), "table", "left")
            .select("table", "label", "format", "rows", "columns", "bytes")
        )


def _with_names(spark: SparkSession, sources: Sequence[Source]) -> list[str]:
    """The given table names, or names derived from the labels: the next free one of a base name."""
    labels = [(i, s.table or s.label or s.path.rstrip("/").split("/")[-1]) for i, s in enumerate(sources)]
    based = local_frame(spark, labels, "position bigint, label string").select("position", base_table_name(F.col("label")).alias("base"))
    bases = {r["position"]: r["base"] for r in based.collect()}
    given = [s.table for s in sources if s.table]
    for i, source in enumerate(sources):
        if source.table and (source.table != bases[i] or given.count(source.table) > 1):
            raise SourceError(f"Unsafe or repeated table name: {source.table}")
    taken, out = set(given), []
    for i, source in enumerate(sources):
        name, n = bases[i], 1
        while not source.table and name in taken:
            n += 1
            name = f"{bases[i]}_{n}"
        taken.add(name)
        out.append(name)
    return out


def load_catalog(
    spark: SparkSession, sources: Sequence[Source], *, replaces: Catalog | None = None
) -> Catalog:
    """Load a set of sources as one catalog, or none of them.

    Every file is checked before the first view is made; the views of the catalog it
    ``replaces`` go away only once the new one is complete. Names that contradict the
    contents and very large files are listed in the catalog's ``warnings``.
    """
    names = _with_names(spark, sources)
    checked = [
        detect_formats(file_ends(spark, s.path)).withColumn("source", F.lit(i)).withColumn(
            "format", F.coalesce(F.lit(s.format).cast("string"), "format")
        )
        for i, s in enumerate(sources)
    ]
    problem = file_problem(
        F.col("length"), F.col("head"), F.col("tail"), F.col("format"), F.lit(None).cast("bigint")
    )
    # All files of all sources in one job; one row per source comes back.
    found = (
        size_warnings(reduce(DataFrame.unionByName, checked))
        .groupBy("source")
        .agg(
            F.array_sort(F.collect_set("format")).alias("formats"),
            F.count_if(F.col("format").isNull()).alias("unknown"),
            F.min(problem).alias("problem"),
            F.count_if(F.col("mismatch")).alias("mismatched"),
            F.count_if(F.col("large")).alias("large"),
        )
        .collect()
    )
    state = {r["source"]: r for r in found}
    formats, warnings = [], []
    for i, source in enumerate(sources):
        label = source.label or source.path
        if i not in state or state[i]["problem"]:
            raise SourceError(f"{label}: {PROBLEMS[state[i]['problem'] if i in state else 'missing']}")
        if state[i]["unknown"]:
            raise SourceError(f"{label}: not Parquet, CSV or JSON as far as we can tell.")
        if len(state[i]["formats"]) > 1:
            raise SourceError(f"{label}: files of several formats: {', '.join(state[i]['formats'])}.")
        formats.append(state[i]["formats"][0])
        if state[i]["mismatched"]:
            warnings.append(f"{label}: {state[i]['mismatched']} file(s) are {formats[-1]}, whatever their names say.")
        if state[i]["large"]:
            warnings.append(f"{label}: {state[i]['large']} file(s) of more than 500 MB.")
    tables = []
    for name, fmt, s in zip(names, formats, sources):
        try:
            df = read_source(spark, s.path, fmt, s.schema, **s.options)
        except MalformedRows as error:
            raise SourceError(f"{s.label or s.path}: {error}") from error
        tables.append(Table(name, s.label or s.path.rstrip("/").split("/")[-1], fmt, df, s.path))
    if replaces is not None:
        replaces.close()
    return Catalog(spark, tables, warnings)


PROBLEMS = {
    "empty": "the file is empty.",
    "short": "the file is incomplete: it is shorter than expected.",
    "no_header": "that is not a Parquet file: it has no PAR1 header.",
    "no_footer": "the Parquet file is incomplete: it has a PAR1 header but no footer.",
    "missing": "there is no such file.",
}
