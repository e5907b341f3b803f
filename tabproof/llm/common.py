"""Reading tables, cutting lineage and joins that stay even under hot keys."""

from __future__ import annotations

import shutil
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabproof.session import own_folder, shared_folder, shuffles_removed

#: A key is hot when it has more than one of this many parts of all rows, so there are fewer hot keys than this.
HOT_SHARE = 1000
#: Rows of a key that any task can take.
FEW_ROWS = 200
#: Keys of a filter that are broadcast at most; some tens of megabytes.
BROADCAST_KEYS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, which cuts its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint()


@contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` written to the shared folder and read from there, until the block ends."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    with shuffles_removed(spark):
        df.select("*").write.parquet(folder)
    try:
        yield spark.read.schema(df.schema).parquet(folder)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def measured(df: DataFrame, *metrics: Column) -> tuple[DataFrame, dict]:
    """:func:`saved`, with aggregates over its rows that the same job gathers."""
    seen = Observation()
    kept = saved(df.observe(seen, *metrics))
    return kept, seen.get


def counted(keyed: DataFrame) -> tuple[DataFrame, int, int]:
    """A saved table of keys with ``n``, the rows each has elsewhere; the sum and the largest of them."""
    kept, got = measured(keyed, F.sum("n").alias("total"), F.max("n").alias("most"))
    return kept, got["total"] or 0, got["most"] or 0


def rows_of(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``rows`` whose ``key`` is among the distinct, non-null ``wanted[key]``.

    The keys are counted; up to ``BROADCAST_KEYS`` are broadcast, more are joined by shuffle.
    """
    wanted, got = measured(wanted.select(key).where(F.col(key).isNotNull()).distinct(), F.count("*").alias("n"))
    return rows.join(F.broadcast(wanted) if got["n"] <= BROADCAST_KEYS else wanted, key, "left_semi")


def shipped(df: DataFrame) -> DataFrame:
    """``df``, once its executors have this package: Python functions in tasks import it."""
    context = df.sparkSession.sparkContext
    package = Path(__file__).resolve().parent.parent
    if package.is_dir() and not getattr(context, "_has_" + package.name, False):
        archive = shutil.make_archive(f"{own_folder()}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(archive)
        setattr(context, "_has_" + package.name, True)
    return df


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, made longer where a column is called so (case aside)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def join_by_key(rows: DataFrame, counts: tuple[DataFrame, int, int], key: str) -> DataFrame:
    """Inner join of ``rows`` with one row per key, from :func:`counted`.

    A key is hot with more than a thousandth of all rows, so fewer than a thousand are: their
    one row each is broadcast, and the rows of ``rows`` that have them stay where they are. All
    other keys are shuffled.
    """
    keyed, total, most = counts
    limit = max(FEW_ROWS, total // HOT_SHARE)
    columns = [*rows.columns, *[c for c in keyed.columns if c != key]]
    if most <= limit:
        return rows.join(keyed, key).select(*columns)
    hot = keyed.where(F.col("n") > limit).collect()
    there = F.coalesce(F.col(key).isin([row[key] for row in hot]), F.lit(False))
    few = rows.sparkSession.createDataFrame(hot, keyed.schema)
    others = rows.where(~there).join(keyed.where(F.col("n") <= limit), key)
    return rows.where(there).join(F.broadcast(few), key).select(*columns).unionByName(others.select(*columns))
