"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN_FOLDERS: list[tempfile.TemporaryDirectory] = []

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app_name: str = "tabproof", **settings: str) -> SparkSession:
    """A session with the settings the library is tested under."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def own_folder() -> str:
    """A new folder of the driver's machine that goes when this process ends."""
    _OWN_FOLDERS.append(tempfile.TemporaryDirectory(prefix="tabproof-", ignore_cleanup_errors=True))
    return _OWN_FOLDERS[-1].name


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster shares between its executors.

    A temporary folder of this machine serves only a local session where none is set,
    as in tests.
    """
    root = spark.sparkContext.getConf().get(_CHECKPOINT_DIR) or spark.conf.get(_CHECKPOINT_DIR, "")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"Set {_CHECKPOINT_DIR} to a folder all executors share.")
    if not root:
        root = own_folder()
        spark.conf.set(_CHECKPOINT_DIR, root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it is done: its result is written, so nothing reads them again."""
    before = spark.conf.get(_REMOVE_SHUFFLES, "false")
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_REMOVE_SHUFFLES, before)


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, which cuts its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint()


def local_frame(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """A handful of rows known to the driver, as a frame the optimizer knows the size of."""
    struct = T.StructType.fromDDL(schema)
    records = [dict(zip(struct.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, to_arrow_schema(struct)), struct)
