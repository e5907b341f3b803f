"""File audits: formats, completeness and sizes of any number of files."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabproof.functions import files as X
from tabproof.session import local_frame

_HEAD_BYTES = 1024
_TAIL_BYTES = 4


def list_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(path, length)`` of every file. File contents are not read."""
    return spark.read.format("binaryFile").load(paths).select("path", "length")


# Schemes that tasks can open by themselves, and the names they go by there.
_OPENED_IN_TASKS = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def _end_reader(head_bytes: int, tail_bytes: int, schemes: dict[str, str]):
    """The function tasks run. Defined in here, it travels to executors by value, so
    they need not have this package installed."""

    def read_ends(batches):
        from pyarrow import fs

        for batch in batches:
            heads, tails = [], []
            for path, length in zip(batch["path"], batch["length"]):
                scheme, _, rest = path.partition(":")
                rest = "//" + rest if not rest.startswith("//") else rest
                system, name = fs.FileSystem.from_uri(f"{schemes[scheme]}:{rest}")
                with system.open_input_file(name) as file:
                    heads.append(file.read_at(min(head_bytes, length), 0))
                    size = min(tail_bytes, length)
                    tails.append(file.read_at(size, length - size))
            yield batch.assign(head=heads, tail=tails)

    return read_ends


def _ends_by_driver(spark: SparkSession, listed: DataFrame) -> DataFrame:
    """The same through the session's own file systems, which know every scheme Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def ends(row) -> tuple:
        path = jvm.org.apache.hadoop.fs.Path(row["path"])
        stream = path.getFileSystem(conf).open(path)
        try:
            head = stream.readNBytes(min(_HEAD_BYTES, row["length"]))
            stream.seek(max(0, row["length"] - _TAIL_BYTES))
            return row["path"], row["length"], bytearray(head), bytearray(stream.readNBytes(_TAIL_BYTES))
        finally:
            stream.close()

    with ThreadPoolExecutor(16) as pool:
        rows = list(pool.map(ends, listed.collect()))
    return local_frame(spark, rows, "path string, length bigint, head binary, tail binary")


def file_ends(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(path, length, head, tail)``: the first kilobyte and the last four bytes.

    Files are opened at the two places only, so the audit of a file costs the same whatever its
    size: by tasks where the scheme is one they know, else by the driver, some at a time.
    """
    listed = list_files(spark, paths)
    schemes = {r[0] for r in listed.select(F.substring_index("path", ":", 1)).distinct().collect()}
    if not schemes <= _OPENED_IN_TASKS.keys():
        return _ends_by_driver(spark, listed)
    reader = _end_reader(_HEAD_BYTES, _TAIL_BYTES, _OPENED_IN_TASKS)
    return listed.mapInPandas(reader, "path string, length bigint, head binary, tail binary")


def detect_formats(files: DataFrame) -> DataFrame:
    """Add what each file's contents and its name say its format is.

    Contents win; ``mismatch`` marks files whose name says otherwise.
    """
    sniffed = X.sniff_format(F.col("head"))
    declared = X.format_from_extension(F.col("path"))
    return (
        files.withColumn("sniffed", sniffed)
        .withColumn("declared", declared)
        .withColumn("format", F.coalesce("sniffed", "declared"))
        .withColumn("mismatch", F.coalesce(F.col("sniffed") != F.col("declared"), F.lit(False)))
    )


def audit_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add ``problem`` to each file of a manifest ``(path, format, expected_bytes)``.

    A listed file that does not exist is reported as ``missing``.
    """
    joined = manifest.join(files, "path", "left")
    problem = X.file_problem(
        F.col("length"), F.col("head"), F.col("tail"), F.col("format"), F.col("expected_bytes")
    )
    return joined.withColumn(
        "problem", F.when(F.col("length").isNull(), F.lit("missing")).otherwise(problem)
    ).drop("head", "tail")


def size_warnings(files: DataFrame, limit: int = X.LARGE_FILE_BYTES) -> DataFrame:
    """Add ``large`` to listed files: true above ``limit`` bytes, 500 MB if not given. Needs ``length`` only."""
    return files.withColumn("large", F.col("length") > limit)
