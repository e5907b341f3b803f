"""Exact duplicates of whole texts by an extendible-hash index in the shared folder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabproof.llm.common import FEW_ROWS, HOT_SHARE, counted, join_by_key, measured, saved, shipped, whole_text
from tabproof.session import shared_folder

#: Texts that a bucket holds before it is split.
BUCKET_TEXTS = 64
#: Bytes of texts that a task gathers before it hands them on, each once.
WINDOW_BYTES = 16_000_000
#: Bytes of texts behind one owner, about; an owner's index is the most a task holds at once.
OWNER_BYTES = 4_000_000
#: Fewest bits of a key that name its owner.
OWNER_BITS = 10
#: Tasks that share the copies of a hot key before its owner gets one row from each.
SALTS = 16
#: Bits of a directory at most; a bucket that keys alike beyond them overfill stays one.
MAX_BITS = 14
_KEY_BITS = 64
_ENTRY = "key long, text binary, keep_id long, group_size long, keep_rows long"
_INDEX = f"owner long, bucket long, bucket_bits int, place int, {_ENTRY}, text_sha256 string"


class Entry:
    """A text with its largest doc_id (null below all), its rows, and those of that doc_id."""

    __slots__ = ("key", "text", "keep_id", "rows", "keep_rows")

    def __init__(self, key: int, text: bytes, keep_id: int | None, rows: int, keep_rows: int):
        self.key, self.text, self.keep_id, self.rows, self.keep_rows = key, text, keep_id, rows, keep_rows

    def add(self, keep_id: int | None, rows: int, keep_rows: int) -> None:
        self.rows += rows
        if keep_id == self.keep_id:
            self.keep_rows += keep_rows
        elif self.keep_id is None or (keep_id is not None and keep_id > self.keep_id):
            self.keep_id, self.keep_rows = keep_id, keep_rows


class Bucket:
    """Chains of entries by key; all keys share their first ``bits`` bits."""

    __slots__ = ("bits", "chains", "texts")

    def __init__(self, bits: int):
        self.bits, self.chains, self.texts = bits, {}, 0


class ExtendibleIndex:
    """A directory of 2^depth slots over buckets; several slots may name one bucket.

    A bucket over ``capacity`` texts is split by its keys' next bit. One that has a
    slot of its own first makes the directory double. Texts of one key stay in a chain, however
    many they are, and are told apart by their bytes.
    """

    def __init__(self, capacity: int = BUCKET_TEXTS, skipped: int = 0):
        self.capacity, self.skipped = capacity, skipped
        self.depth, self.directory = 0, [Bucket(0)]

    def _bits(self, key: int, count: int) -> int:
        """The ``count`` bits of the key that follow the owner's."""
        return (key >> (_KEY_BITS - self.skipped - count)) & ((1 << count) - 1)

    def add(self, key: int, text: bytes, keep_id: int | None, rows: int = 1, keep_rows: int = 1) -> None:
        bucket = self.directory[self._bits(key, self.depth)]
        chain = bucket.chains.setdefault(key, [])
        for entry in chain:
            if entry.text == text:
                entry.add(keep_id, rows, keep_rows)
                return
        chain.append(Entry(key, text, keep_id, rows, keep_rows))
        bucket.texts += 1
        while bucket.texts > self.capacity and len(bucket.chains) > 1 and bucket.bits < MAX_BITS:
            bucket = self._split(bucket, key)

    def _split(self, bucket: Bucket, key: int) -> Bucket:
        """Two buckets in place of one; the one where ``key`` now belongs."""
        if bucket.bits == self.depth:
            self.directory = [b for b in self.directory for _ in range(2)]
            self.depth += 1
        bits = bucket.bits + 1
        halves = Bucket(bits), Bucket(bits)
        for k, chain in bucket.chains.items():
            half = halves[self._bits(k, bits) & 1]
            half.chains[k] = chain
            half.texts += len(chain)
        width = 1 << (self.depth - bits)
        first = self._bits(key, bucket.bits) << (self.depth - bucket.bits)
        self.directory[first : first + 2 * width] = [halves[0]] * width + [halves[1]] * width
        return halves[self._bits(key, bits) & 1]

    def buckets(self) -> Iterator[tuple[int, Bucket]]:
        """Every bucket once, with the bits its keys share."""
        at = 0
        while at < len(self.directory):
            bucket = self.directory[at]
            yield at >> (self.depth - bucket.bits), bucket
            at += 1 << (self.depth - bucket.bits)


def _unsigned(key: int) -> int:
    return key % (1 << _KEY_BITS)


def _signed(key: int) -> int:
    return key - (1 << _KEY_BITS) if key >> (_KEY_BITS - 1) else key


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_ENTRY_ARROW = [("key", pa.int64()), ("text", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("keep_rows", pa.int64())]
_INDEX_ARROW = [("owner", pa.int64()), ("bucket", pa.int64()), ("bucket_bits", pa.int32()), ("place", pa.int32()), *_ENTRY_ARROW, ("text_sha256", pa.string())]


def _collapse(batches: Iterator[pa.RecordBatch], window_bytes: int) -> Iterator[pa.RecordBatch]:
    """Each text of a window of rows once."""
    schema, held, size = pa.schema(_ENTRY_ARROW), {}, 0

    def rows():
        return _batch([(e.key, e.text, e.keep_id, e.rows, e.keep_rows) for e in held.values()], schema)

    for batch in batches:
        for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            text = text.as_py()
            entry = held.get(text)
            if entry is not None:
                entry.add(doc_id, 1, 1)
                continue
            held[text] = Entry(key, text, doc_id, 1, 1)
            size += len(text)
            if size >= window_bytes:
                yield rows()
                held, size = {}, 0
    if held:
        yield rows()


def _own(batches: Iterator[pa.RecordBatch], owner_bits: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """The finished indexes of owners, from entries sorted by owner and salt."""
    schema, now, index = pa.schema(_INDEX_ARROW), None, None

    def rows():
        owner = now[0]
        for bits, bucket in index.buckets():
            found = [
                (owner, bits, bucket.bits, place, _signed(e.key), e.text, e.keep_id, e.rows, e.keep_rows, hashlib.sha256(e.text).hexdigest())
                for chain in bucket.chains.values()
                for place, e in enumerate(chain)
            ]
            if found:
                yield _batch(found, schema)

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("owner", "salt", "key", "keep_id", "group_size", "keep_rows")]
        for owner, salt, key, keep_id, n, keep_rows, text in zip(*columns, batch.column("text")):
            if (owner, salt) != now:
                if now is not None:
                    yield from rows()
                now, index = (owner, salt), ExtendibleIndex(capacity, owner_bits)
            index.add(_unsigned(key), text.as_py(), keep_id, n, keep_rows)
    if now is not None:
        yield from rows()


def _indexed(entries: DataFrame, salt: Column, owner_bits: int, capacity: int) -> DataFrame:
    owner = F.shiftrightunsigned("key", _KEY_BITS - owner_bits)
    owned = entries.withColumns({"owner": owner, "salt": salt}).repartition("owner", "salt")
    return owned.sortWithinPartitions("owner", "salt").mapInArrow(lambda batches: _own(batches, owner_bits, capacity), _INDEX)


def _written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    folder = f"{shared_folder(df.sparkSession)}/index"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(_INDEX).parquet(folder)


def build_index(
    docs: DataFrame,
    hot: list[int],
    total_bytes: int,
    *,
    previous: DataFrame | None = None,
    capacity: int = BUCKET_TEXTS,
    owner_bytes: int = OWNER_BYTES,
    window_bytes: int = WINDOW_BYTES,
) -> DataFrame:
    """An index of the texts of ``docs(doc_id, text, …)`` in the shared folder: one row per text.

    ``(owner, bucket, bucket_bits, place, key, text, keep_id, group_size, keep_rows, text_sha256)``. The first bits of
    the 64-bit ``key`` name the owner, whose task has the keys of that range to itself; the next
    ``bucket_bits`` are ``bucket``; ``place`` tells texts of one key apart. An owner's texts are about
    ``owner_bytes``, so more data means more owners, not larger ones. ``previous`` is an index to extend.

    Tasks hand on each text of a window once. ``hot`` keys are dealt to ``SALTS`` indexes
    each, whose one row for a text then meet in the owner's.
    """
    owner_bits = max(OWNER_BITS, (total_bytes // owner_bytes).bit_length())
    rows = shipped(docs).select("doc_id", whole_text().alias("text"))
    entries = rows.select("doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text")).mapInArrow(
        lambda batches: _collapse(batches, window_bytes), _ENTRY
    )
    names = [name for name, _ in _ENTRY_ARROW]
    if previous is not None:
        entries = entries.unionByName(previous.select(*names))
    if not hot:
        return _written(_indexed(entries, F.lit(0), owner_bits, capacity))
    is_hot = F.col("key").isin(hot)
    salt = F.when(is_hot, F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(0)
    first = _written(_indexed(entries, salt, owner_bits, capacity))
    met = _written(_indexed(first.where(is_hot).select(*names), F.lit(0), owner_bits, capacity))
    return first.where(~is_hot).unionByName(met)


def exact_duplicates(docs: DataFrame, *, previous: DataFrame | None = None, **index: int) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs(doc_id, text, …)``.

    Rows with identical texts are a group, a null text counting as empty. The row with the largest doc_id stays; a null
    doc_id is below all others. If a group's largest doc_id has several rows, one of them stays and
    the others are not ``kept``. Texts are compared byte by byte in :func:`build_index`; a row then
    finds its group by the SHA-256 of its text. With ``previous``, an index of earlier texts, ``group_size`` counts their
    rows too and ``keep_id`` may be one of theirs. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    text = whole_text()
    members, got = measured(
        docs.select("doc_id", F.xxhash64(text).alias("key"), F.sha2(text, 256).alias("text_sha256"), F.octet_length(text).alias("size")),
        F.sum("size").alias("bytes"),
        F.count("*").alias("rows"),
    )
    limit = max(FEW_ROWS, got["rows"] // HOT_SHARE)
    hot = [row["key"] for row in members.groupBy("key").count().where(F.col("count") > limit).collect()]
    index_rows = build_index(docs, hot, got["bytes"] or 0, previous=previous, **index)
    classes = counted(index_rows.select("text_sha256", "keep_id", F.col("group_size").alias("n"), "keep_rows"))
    row = F.monotonically_increasing_id()
    met = join_by_key(members.select("doc_id", "text_sha256", row.alias("row")), classes, "text_sha256")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    met = saved(met.withColumn("kept", stays))
    several = met.where("kept and keep_rows > 1").groupBy("text_sha256").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    ties = counted(several.where("n > 1"))
    columns = ["doc_id", "keep_id", F.col("n").alias("group_size"), "kept", "text_sha256"]
    if not ties[1]:
        return met.select(*columns)
    tied = join_by_key(met.where("kept and keep_rows > 1").drop("n"), ties, "text_sha256")
    late = counted(tied.where("row <> first").select("row", F.lit(1).alias("n")))[0].select(F.col("row").alias("late"))
    out = met.join(late, F.col("row") == F.col("late"), "left")
    return out.withColumn("kept", F.col("kept") & F.col("late").isNull()).select(*columns)
