"""All rows whose key is in a counted key set, without one task getting a hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabproof.session import saved

# A key with more than 1/1000 of all wanted rows is hot; there are under 1000 such keys.
_HOT_SHARE = 1000
#: Wanted keys that are broadcast at most; more are met by shuffle.
BROADCAST_KEYS = 1_000_000
#: Tasks that share the rows of a hot key.
_SALTS = 64


def _renamed(keys: DataFrame, names: Sequence[str], *more: str) -> DataFrame:
    """The key columns under names of their own, so a self-join is unambiguous."""
    return keys.select(*[F.col(n).alias(f"_key{i}") for i, n in enumerate(names)], *more)


def _same_keys(names: Sequence[str]) -> Column:
    on = F.lit(True)
    for i, name in enumerate(names):
        on = on & F.col(name).eqNullSafe(F.col(f"_key{i}"))
    return on


def rows_with_keys(
    rows: DataFrame, keys: DataFrame, names: Sequence[str], count: str = "n", broadcast_keys: int | None = None
) -> DataFrame:
    """Rows of ``rows`` whose ``names`` columns, NULLs included, appear in ``keys``.

    ``keys`` holds each key once with the number of its rows in column ``count``; it is computed once, into the shared
    folder. Up to ``BROADCAST_KEYS`` of them are broadcast, and the rows, read once, stay where they are. More
    are shuffled with the rows, read once too: hot keys, few by arithmetic, are broadcast to tag their rows with a
    salt, so that many tasks share them.
    """
    most = BROADCAST_KEYS if broadcast_keys is None else broadcast_keys
    keys = saved(keys.select(*names, count))
    found = keys.agg(F.count("*").alias("keys"), F.sum(count).alias("rows")).first()
    if found["keys"] <= most:
        return rows.join(F.broadcast(_renamed(keys, names)), _same_keys(names), "left_semi")
    limit = max(found["rows"] // _HOT_SHARE, 1)
    every = F.sequence(F.lit(0), F.lit(_SALTS - 1))
    salts = F.when(F.col(count) > limit, every).otherwise(F.array(F.lit(0)))
    wanted = _renamed(keys.withColumn("_salt", F.explode(salts)), names, F.col("_salt").alias("_key_salt"))
    hot = _renamed(keys.where(F.col(count) > limit), names, F.lit(True).alias("_hot"))
    at = F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS))).otherwise(0).cast("int")
    tagged = rows.join(F.broadcast(hot), _same_keys(names), "left").withColumn("_salt", at)
    tagged = tagged.select(*[F.col(f"`{c}`") for c in rows.columns], "_salt")
    on = _same_keys(names) & (F.col("_salt") == F.col("_key_salt"))
    return tagged.join(wanted, on, "left_semi").drop("_salt")


def first_rows_with_keys(
    rows: DataFrame, keys: DataFrame, names: Sequence[str], order: Sequence[Column], limit: int
) -> DataFrame:
    """The first ``limit`` such rows, ordered by key and then by ``order``.

    Every key has at least one row, so the first ``limit`` keys cover the answer and
    are small enough to broadcast: the rows are never shuffled.
    """
    by_key = [F.col(n).asc_nulls_first() for n in names]
    first = F.broadcast(_renamed(keys.select(*names).orderBy(*by_key).limit(limit), names))
    picked = rows.join(first, _same_keys(names), "left_semi")
    return picked.orderBy(*by_key, *order).limit(limit)
