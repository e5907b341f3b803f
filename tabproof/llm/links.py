"""From shared buckets to exact links and their components, without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabproof.llm.common import counted, join_by_key, measured, saved


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``edges(a, b)``; component is the smallest id reachable.

    Each round points all neighbours of a node at its smallest neighbour, until the edges
    are stars around the smallest ids: then no node with a smaller neighbour has others.
    Hubs are joined by broadcast, so the rows of a hub are never gathered.
    """
    edges = edges.where("a <> b").select("a", "b")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        least, got = measured(
            both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"), F.count("*").alias("n")),
            F.sum("n").alias("total"),
            F.max("n").alias("most"),
            F.expr("count_if(n > 1 and least < a)").alias("open"),
        )
        if not got["open"]:
            return least.select(F.col("a").alias("id"), F.col("least").alias("component"))
        moved = join_by_key(both, (least, got["total"], got["most"]), "a")
        edges = saved(
            moved.select(F.col("b").alias("a"), F.col("least").alias("b"))
            .union(least.select("a", F.col("least").alias("b")))
            .where("a <> b")
            .distinct()
        )


#: Words of a parity map: bit i is whether an odd number of tokens fall on it.
MAP_WORDS = 4


def may_link(x: str, y: str, num: int, den: int, words: int = MAP_WORDS) -> Column:
    """Whether two sets can reach the threshold, from their sizes and parity maps.

    Sets that differ in d tokens have maps that differ in d bits at most, and sets that reach
    it differ in a bounded share of their tokens. So this refuses no pair that does.
    """
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    bits = sum(F.bit_count(F.col(f"{x}.p{w}").bitwiseXOR(F.col(f"{y}.p{w}"))) for w in range(words))
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & (bits * (den + num) <= (n + m) * (den - num))


def with_equal_tokens(pairs: DataFrame, sets: DataFrame, num: int, den: int, also: Callable[..., Column] | None = None) -> DataFrame:
    """The pairs ``(a, b)`` whose token sets have ``den * intersection >= num * union``.

    ``sets`` has ``id``, ``n`` (size) and ``tokens`` (distinct). ``also`` may add a cheaper
    condition, from the two sides' rows, that is tested first.
    """
    sides = [sets.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in sets.columns if c != "id"]) for s in "ab"]
    met = pairs.join(sides[0], "a").join(sides[1], "b").where("n_a > 0 and n_b > 0")
    met = met.where(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
    if also is not None:
        met = met.where(also(lambda c: F.col(f"{c}_a"), lambda c: F.col(f"{c}_b")))
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return met.where(common * den >= num * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def linked_components(
    buckets: DataFrame,
    maps: Callable[[DataFrame], DataFrame],
    num: int,
    den: int,
    confirm: Callable[[DataFrame], DataFrame],
    words: int = MAP_WORDS,
) -> DataFrame:
    """``(id, component)`` of all ids linked to another one.

    ``buckets(bucket, id, rank)``: ids that share a bucket may be similar; ``maps`` gives the sizes and
    parity maps ``(id, n, p0 …)`` of some ids; ``confirm`` keeps the pairs ``(a, b)`` that are similar.

    First each member is compared with its bucket's member of highest ``rank``, the most central.
    Most buckets then lie within the centre's component. Members that do not are compared with
    all members of other components that sizes and maps do not rule out. So no pair
    that shares a bucket is left out, and a family costs its size times the members apart from it.
    """
    buckets = saved(buckets)
    top = F.max(F.struct("rank", (-F.col("id")).alias("minus"), "id"))
    centres = counted(
        buckets.groupBy("bucket").agg(top["id"].alias("centre"), F.count("*").alias("n")).where("n > 1")
    )
    star = (
        join_by_key(buckets, centres, "bucket")
        .select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))
        .where("a <> b")
        .distinct()
    )
    first, got = measured(confirm(star), F.count("*").alias("links"))
    found = connected_components(first) if got["links"] else first.select(F.col("a").alias("id"), F.col("b").alias("component"))
    label = F.coalesce("component", "id").alias("label")
    labelled = saved(buckets.join(found, "id", "left").select("bucket", "id", "rank", label))
    mixed = counted(
        labelled.groupBy("bucket")
        .agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.max(F.struct("rank", "label"))["label"].alias("main"), F.count("*").alias("n"))
        .where("_lo < _hi")
        .select("bucket", "main", "n")
    )
    if not mixed[1]:
        return found
    members = join_by_key(labelled.drop("rank"), mixed, "bucket").drop("n")
    members = saved(members.withColumn("is_main", F.col("label") == F.col("main")).drop("main"))
    # An id is in a bounded number of buckets; a pair that shares several is met in the first of them.
    of = members.groupBy("id").agg(F.collect_list("bucket").alias("buckets"))
    members = members.join(saved(of.join(maps(of.select("id")), "id")), "id")
    x, y = members.where("not is_main").alias("x"), members.alias("y")
    on = (
        (F.col("x.bucket") == F.col("y.bucket"))
        & (F.col("x.label") != F.col("y.label"))
        & (F.col("y.is_main") | (F.col("x.id") < F.col("y.id")))
        & may_link("x", "y", num, den, words)
        & (F.array_min(F.array_intersect("x.buckets", "y.buckets")) == F.col("x.bucket"))
    )
    rest = x.join(y, on).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    rest, got = measured(confirm(rest), F.count("*").alias("links"))
    return connected_components(first.union(rest)) if got["links"] else found
