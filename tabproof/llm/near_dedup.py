"""Near-duplicate documents by an inverted join on signature coordinates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabproof.llm.common import counted, join_by_key, rows_of, saved, shipped, unused, whole_text
from tabproof.llm.links import MAP_WORDS, linked_components, with_equal_tokens
from tabproof.llm.shingles import WordHashes, multipliers, parity_words, shingle_set, signature

COORDINATES = 32
MISSED = 1e-5
_SEED = 20_011


def match_threshold(similarity: float, k: int = COORDINATES, missed: float = MISSED) -> int:
    """Most collisions of ``k`` that a pair at ``similarity`` falls short of with probability ``missed`` at most."""
    below = 0.0
    for t in range(k + 1):
        below += math.comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        if below > missed:
            return t
    return k


def _describe(batches: Iterator[pa.RecordBatch], whole: bool, k: int) -> Iterator[pa.RecordBatch]:
    hashes, factors = WordHashes(), multipliers(k, _SEED)
    for batch in batches:
        sizes, digests, lists, maps = [], [], [], []
        for text in batch.column(1).cast(pa.binary()):
            tokens = shingle_set(text.as_py(), hashes)
            sizes.append(len(tokens))
            digests.append(xxhash.xxh3_128_digest(tokens.tobytes()))
            if whole:
                lists.append(tokens.view(np.int64))
                maps.append(parity_words(tokens, MAP_WORDS))
            else:
                lists.append(signature(tokens, factors) if len(tokens) else np.empty(0, np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        values = np.concatenate(lists) if lists else np.empty(0, np.int64)
        columns = {
            "doc_id": batch.column(0),
            "version": batch.column(2),
            "n": pa.array(sizes, pa.int64()),
            "digest": pa.array(digests, pa.binary()),
            "list": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
        }
        if whole:
            columns |= {f"p{w}": pa.array([m[w] for m in maps], pa.int64()) for w in range(MAP_WORDS)}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _described(docs: DataFrame, whole: bool, k: int = COORDINATES) -> DataFrame:
    """``(doc_id, version, n, digest, list)`` per row: digest of the text, set size, 128-bit digest of the set, its coordinates.

    With ``whole`` the list holds its tokens, and the parity words follow.
    """
    more = "".join(f", p{w} long" for w in range(MAP_WORDS)) if whole else ""
    return shipped(docs).select("doc_id", whole_text().alias("text"), F.xxhash64(whole_text()).alias("version")).mapInArrow(
        lambda batches: _describe(batches, whole, k), f"doc_id long, version long, n long, digest binary, list array<long>{more}"
    )


def rare_postings(classes: DataFrame, k: int, threshold: int) -> DataFrame:
    """``(bucket, id, rank)``: each set posted under its ``k - threshold + 1`` rarest coordinates.

    Sets with ``threshold`` common coordinates share one of these. The long lists that the
    rarest leave out are skipped: they are looked at only when collisions are counted.
    ``rank`` sums the lengths of a set's lists, so the set most like its family has most.
    """
    posted = classes.select("id", F.explode("sig").alias("bucket"))
    lengths = counted(posted.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    shared = join_by_key(posted, lengths, "bucket")
    lists = shared.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("n", "bucket"))).alias("lists"), F.sum("n").alias("rank")
    )
    prefix = F.lit(k - threshold + 1) - (F.lit(k) - F.size("lists"))  # coordinates of one set only come first
    return (
        lists.where(prefix > 0)
        .select("id", "rank", F.explode(F.slice("lists", F.lit(1), prefix)).alias("_l"))
        .select(F.col("_l.bucket").alias("bucket"), "id", "rank")
    )


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """:func:`versions_and_components` without the digests of the texts: ``(doc_id, n_shingles, component_id, kept)``."""
    return versions_and_components(docs, **options).drop("version")


def versions_and_components(
    docs: DataFrame, *, num: int = 4, den: int = 5, k: int = COORDINATES, missed: float = MISSED
) -> DataFrame:
    """``(doc_id, version, n_shingles, component_id, kept)`` for every row of ``docs(doc_id, text, …)``.

    Documents are linked when their sets of five-word shingles have
    ``den * intersection >= num * union``; a component's id is the smallest doc_id in it and
    that document is kept.

    1. Documents with equal sets become one class, by the digest of the set.
    2. Each class is posted under the values of its ``k`` MinHash coordinates. Two classes
       at the threshold collide in ``match_threshold`` of them, but for a probability of
       ``missed``; such pairs share one of their rarest coordinates.
    3. Pairs within posting lists, around the list's most central class, count their
       collisions on whole signatures; enough of them lead to an exact check of whole sets.
    4. Members of lists that do not end in the centre's component are compared with all of other
       components, as far as sizes and parity maps of the sets allow a link.

    Null and blank texts have no shingles and are linked with nothing. Rows are told apart
    by their texts: repeated rows give repeated rows, and one doc_id with several texts has
    a row for each. A null doc_id is linked with nothing and kept, with a null component.
    Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    threshold = match_threshold(num / den, k, missed)
    every = saved(_described(docs.select("doc_id", "text"), False, k))
    some = every.where("n > 0 and doc_id is not null")
    classes = saved(
        some.groupBy("digest")
        .agg(F.min("doc_id").alias("doc_id"), F.first("list").alias("sig"), F.count("*").alias("n"))
        .withColumn("id", F.xxhash64("digest"))
    )
    postings = saved(rare_postings(classes.select("id", "sig"), k, threshold))
    wanted = saved(classes.join(postings.select("id").distinct(), "id").select("id", "sig", "doc_id"))
    tokens = _described(rows_of(docs.select("doc_id", "text"), "doc_id", wanted), True)
    tokens = tokens.withColumn("id", F.xxhash64("digest")).withColumnRenamed("list", "tokens").drop("doc_id", "version", "digest")
    sets = saved(tokens.dropDuplicates(["id"]).join(wanted.select("id", "sig"), "id"))
    words = [f"p{w}" for w in range(MAP_WORDS)]

    def collides(a, b):
        hits = F.zip_with(a("sig"), b("sig"), lambda x, y: (x == y).cast("int"))
        return F.aggregate(hits, F.lit(0), lambda s, x: s + x) >= threshold

    def confirm(pairs: DataFrame) -> DataFrame:
        return with_equal_tokens(pairs, sets.drop(*words), num, den, collides)

    found = linked_components(postings, lambda ids: sets.select("id", "n", *words), num, den, confirm)
    named = classes.join(found, "id", "left").select(
        "digest", "n", "doc_id", F.coalesce("component", "id").alias("component")
    )
    named = saved(named)
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = counted(named.join(smallest, "component").select("digest", "n", "component_id"))
    joined = join_by_key(some.select("doc_id", "version", F.col("n").alias("n_shingles"), "digest"), named, "digest")
    alone = every.where("n = 0 or doc_id is null").select(
        "doc_id", "version", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")
    )
    return (
        joined.select("doc_id", "version", "n_shingles", "component_id")
        .unionByName(alone)
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep_one_of_each(docs: DataFrame, *, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` whose document stands for its group of near duplicates.

    Rows are told apart by doc_id and text: of a doc_id with two texts, only the one that is near another
    document's goes. Repeated rows stay or go together. Null and blank texts and rows with a null doc_id stay. Other
    columns come back as they are, whatever their names. An empty table stays empty.
    """
    doc, version = unused(docs.columns, "dropped", "version")
    found = versions_and_components(docs, num=num, den=den).where("not kept")
    dropped = found.select(F.col("doc_id").alias(doc), F.col("version").alias(version)).distinct()
    return docs.join(dropped, (F.col("doc_id") == F.col(doc)) & (F.xxhash64(whole_text()) == F.col(version)), "left_anti")
