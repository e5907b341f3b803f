"""Two tokenizers' tokens of the same bytes, aligned; id pairs counted over the corpus by external spill counting."""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabproof.llm.common import shipped
from tabproof.session import shared_folder

#: Parts that the right-hand ids are dealt to by radix.
RADIX_BITS = 5
#: Characters of groups (some twelve a link) that a task gathers before it sorts records into runs, and documents at most.
WINDOW_CHARS = 18_000_000
WINDOW_DOCS = 1 << 16
#: Different pieces of text that a worker remembers at most.
CACHE_PIECES = 400_000
#: Bytes of compressed runs that one task merges, about.
MERGE_BYTES = 8_000_000
#: Pairs in one row of sums, and totals in one row of a part.
BLOCK_PAIRS = 50_000
#: Pairs of a run that are Python numbers at once.
_SLICE = 2048
_ID_BITS = 16
_PAIR_BITS = 2 * _ID_BITS
#: Characters that are white space to the left tokenizer's pattern (fixed values).
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Numbers of a piece of text.
_SIZES = 5
_BYTE_PIECE = re.compile("<0x[0-9A-F]{2}>")


# ---------------------------------------------------------------- tokens of a piece of text


def side_major(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number per id pair: the radix of ``b`` (its low bits) first, then the rest of ``b``, then ``a``."""
    a, b = a.astype(np.uint32), b.astype(np.uint32)
    radix = b & np.uint32((1 << RADIX_BITS) - 1)
    return (radix << np.uint32(_PAIR_BITS - RADIX_BITS)) | ((b >> np.uint32(RADIX_BITS)) << np.uint32(_ID_BITS)) | a


class Pair:
    """The two tokenizers, and where a text may be cut so that both see the parts as in the whole.

    ``left`` is a byte-level BPE file, ``right`` a piece model that writes blanks as U+2581 and puts one first.
    """

    def __init__(self, left: str, right: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.left = Tokenizer.from_file(left)
        self.left.encode_special_tokens = True
        self.right = sentencepiece.SentencePieceProcessor(model_file=right)
        # The byte-level alphabet: printable bytes are themselves, the others follow from 256 on (fixed values).
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [byte for byte in range(256) if byte not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        left_ids = {i: token for token, i in self.left.get_vocab().items()}
        self.left_bytes = [bytes(map(byte_of.get, left_ids.get(i, ""))) for i in range(max(left_ids) + 1)]
        pieces = [self.right.id_to_piece(i) for i in range(self.right.get_piece_size())]
        self.right_bytes = [self._piece_bytes(p) for p in pieces]
        self.left_size, self.right_size = list(map(len, self.left_bytes)), list(map(len, self.right_bytes))
        self.right_major = side_major(np.zeros(len(pieces)), np.arange(len(pieces))).tolist()
        self.cut = re.compile(self._cuts([p for p in pieces if not _BYTE_PIECE.fullmatch(p)]))

    @staticmethod
    def _piece_bytes(piece: str) -> bytes:
        if _BYTE_PIECE.fullmatch(piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode("utf-8", "surrogatepass")

    @staticmethod
    def _cuts(pieces: list[str]) -> str:
        """The pattern of the parts of a text.

        No token of the left crosses from a black to a white character, or from an ASCII letter to a mark. A piece of the
        right may; where one of its pieces holds such a step, texts are not cut.
        """
        steps = {p[i : i + 2].replace("▁", " ") for p in pieces for i in range(len(p) - 1)}
        white = re.compile(f"[{_WHITE}]")
        kept = {y for x, y in steps if white.match(y) and not (x == y == " ")}
        marks = [c for c in map(chr, range(33, 127)) if not c.isalnum() and not any(x.isalpha() and y == c for x, y in steps)]
        marks = f"(?![{re.escape(''.join(marks))}])" if marks else ""
        other, letters = f"[^A-Za-z{_WHITE}]*+", "[A-Za-z]++"
        joined = f"(?:[{re.escape(''.join(sorted(kept)))}][{_WHITE}]*+[^{_WHITE}]*+)*+" if kept else ""
        return f"(?s:(?=.))[{_WHITE}]*+(?:{other}{letters}{marks})*+{other}(?:{letters})?{joined}"

    def encoded(self, part: str) -> tuple[list[int], list[int]] | None:
        """Ids of both sides for a part as :attr:`cut` gives it; None where they do not spell it."""
        left = self.left.encode(part, add_special_tokens=False).ids
        if part[0] == " " and len(part) > 1:
            right = self.right.encode(part[1:])
        else:  # a line break keeps the blank that it puts first away from the part
            right = self.right.encode("\n" + part)[2:]
        raw = part.encode("utf-8", "surrogatepass")
        if b"".join([self.left_bytes[t] for t in left]) != raw or b"".join([self.right_bytes[t] for t in right]) != raw:
            return None
        return left, right

    def links(self, left: list[int], right: list[int]) -> tuple[list[int], str, int]:
        """Overlapping pairs as side-major numbers, the groups as text, and their number, of two token lists of the same bytes."""
        left_size, right_size, major = self.left_size, self.right_size, self.right_major
        pairs, groups, i, j, from_i, from_j = [], [], 0, 0, 0, 0
        ahead = left_size[left[0]] - right_size[right[0]]
        while True:
            pairs.append(major[right[j]] | left[i])
            if ahead > 0:
                j += 1
                ahead -= right_size[right[j]]
            elif ahead < 0:
                i += 1
                ahead += left_size[left[i]]
            else:
                i, j = i + 1, j + 1
                groups.append(",".join(map(str, left[from_i:i])) + "|" + ",".join(map(str, right[from_j:j])))
                if i == len(left):
                    return pairs, ";".join(groups), len(groups)
                from_i, from_j = i, j
                ahead = left_size[left[i]] - right_size[right[j]]


# ---------------------------------------------------------------- runs


def _shuffled(values: np.ndarray) -> bytes:
    """Bytes of a number array, first bytes first, which compress better."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unshuffled(raw: bytes, kind: np.dtype) -> np.ndarray:
    kind = np.dtype(kind)
    return np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind).ravel()


def pack(*arrays: np.ndarray) -> bytes:
    """Number arrays as one zstd frame: lengths and kinds, then the bytes of each."""
    head = np.array([len(arrays), *[x for a in arrays for x in (len(a), a.itemsize)]], "<i8")
    return zstandard.compress(head.tobytes() + b"".join(_shuffled(np.ascontiguousarray(a)) for a in arrays if len(a)), 3)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    count = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 2 * count, 8).reshape(-1, 2), 8 * (2 * count + 1), []
    for length, width in head.tolist():
        out.append(_unshuffled(raw[at : at + length * width], f"<u{width}") if length else np.empty(0, f"<u{width}"))
        at += length * width
    return out


def sorted_runs(docs: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """``(radix, run)`` of pair-document records: pairs in side-major order, each with its documents.

    A run has the pairs' steps, how many documents each has, and the records' documents and times.
    """
    records = (pairs.astype(np.uint64) << np.uint64(32)) | docs.astype(np.uint64)
    order = np.argsort(records)
    records, times = records[order], times[order]
    if not len(records):
        return
    first = np.flatnonzero(np.concatenate([[True], records[1:] != records[:-1]]))
    times = np.add.reduceat(times, first)
    records = records[first]
    keys, at = (records >> np.uint64(32)).astype(np.uint32), (records & np.uint64(0xFFFFFFFF)).astype(np.uint16)
    edges = np.searchsorted(keys, np.arange(1 << RADIX_BITS, dtype=np.uint64) << np.uint64(_PAIR_BITS - RADIX_BITS))
    for radix, (low, high) in enumerate(zip(edges, [*edges[1:], len(keys)])):
        if low < high:
            pair, starts = np.unique(keys[low:high], return_index=True)
            sizes = np.diff(np.append(starts, high - low)).astype(np.uint32)
            steps = np.diff(pair, prepend=np.uint32(0)).astype(np.uint32)
            yield radix, pack(steps, sizes, at[low:high], times[low:high].astype(np.uint32))


def run_records(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(pairs, sizes, docs, times)`` of a run."""
    steps, sizes, docs, times = unpack(blob)
    return np.cumsum(steps, dtype=np.uint32), sizes.astype(np.int64), docs, times.astype(np.int64)


class Encoder(dict):
    """Pieces of text by number. Each is encoded and linked when it is first met."""

    def __init__(self, left: str, right: str):
        self.pair = Pair(left, right)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.groups: list[str] = []
        self._pairs, self._sizes = array("I"), array("q")

    def __missing__(self, part: str) -> int:
        at = self[part] = len(self.groups)
        found = self.pair.encoded(part)
        if found:
            pairs, groups, count = self.pair.links(*found)
            self._pairs.extend(pairs)
            self._sizes.extend((len(found[0]), len(found[1]), count, len(pairs), 0))
        else:
            groups = ""
            self._sizes.extend((0, 0, 0, 0, 1))
        self.groups.append(groups)
        return at

    def pairs(self) -> np.ndarray:
        """The side-major pairs of all pieces, one piece after the other."""
        return np.array(self._pairs, np.uint32)

    def sizes(self) -> np.ndarray:
        """Per piece: left and right tokens, groups, links, and 1 if it is not spelled."""
        return np.array(self._sizes, np.int64).reshape(-1, _SIZES)

    def numbers(self, text: str) -> list[int]:
        return list(map(self.__getitem__, self.pair.cut.findall(" " + text)))


_ENCODERS: dict[tuple[str, str], Encoder] = {}
_SPILLED = "window long, radix int, at int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, run binary"
_SPILLED_KINDS = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.binary()]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _spill(batches: Iterator[pa.RecordBatch], left: str, right: str, window_chars: int) -> Iterator[pa.RecordBatch]:
    """A row per document, and a row per run of each window."""
    encoder = _ENCODERS.get((left, right))
    if encoder is None:
        encoder = _ENCODERS[left, right] = Encoder(left, right)
    names = [f.split()[0] for f in _SPILLED.split(", ")]
    window, held, chars = TaskContext.get().partitionId() << 32, [], 0

    def closed() -> pa.RecordBatch:
        sizes, pairs = encoder.sizes(), encoder.pairs()
        lengths = [len(numbers) for _, numbers, _ in held]
        part = np.concatenate([numbers for _, numbers, _ in held])
        doc = np.repeat(np.arange(len(held)), lengths)
        sums = np.zeros((len(held), _SIZES), np.int64)
        np.add.at(sums, doc, sizes[part])
        sums[sums[:, 4] > 0] = 0, 0, 0, 0, 1
        rows: list[tuple] = [
            (window, None, at, doc_id, *counts, digest if counts[3] else "", None)
            for at, ((doc_id, _, digest), counts) in enumerate(zip(held, sums[:, :4].tolist()))
        ]
        spelled = sums[doc, 4] == 0
        # Equal parts of a document are spread into their pairs once.
        met, times = np.unique((doc[spelled] << 32) | part[spelled], return_counts=True)
        doc, part = met >> 32, met & 0xFFFFFFFF
        wide = sizes[part, 3]
        ends = np.cumsum(wide)
        inner = np.arange(wide.sum()) + np.repeat((np.cumsum(sizes[:, 3]) - sizes[:, 3])[part] - (ends - wide), wide)
        for radix, run in sorted_runs(np.repeat(doc, wide), pairs[inner], np.repeat(times, wide)):
            rows.append((window, radix, *(None,) * 7, run))
        return _batch(rows, names, _SPILLED_KINDS)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = text.as_py()
            try:
                numbers = encoder.numbers(raw.decode()) if raw else []
            except UnicodeDecodeError:  # neither tokenizer spells such bytes
                numbers = []
            groups = ";".join(map(encoder.groups.__getitem__, numbers))
            held.append((doc_id, np.array(numbers, np.int64), hashlib.sha256(groups.encode()).hexdigest()))
            chars += len(groups)
            full = len(encoder.groups) >= CACHE_PIECES
            if chars >= window_chars or len(held) >= WINDOW_DOCS or full:
                yield closed()
                window, held, chars = window + 1, [], 0
                if full:
                    encoder.forget()
    if held:
        yield closed()


# ---------------------------------------------------------------- counts and what they give back


def _run_counts(blob: bytes) -> Iterator[tuple[int, int]]:
    pairs, sizes, _, times = run_records(blob)
    counts = np.add.reduceat(times, np.cumsum(sizes) - sizes)
    for at in range(0, len(pairs), _SLICE):
        yield from zip(pairs[at : at + _SLICE].tolist(), counts[at : at + _SLICE].tolist())


def merged(sources: list[Iterator[tuple[int, int]]]) -> Iterator[tuple[int, int]]:
    """``(pair, count)`` from sorted sources of such, by a heap over their heads."""
    for pair, counts in groupby(heapq.merge(*sources), itemgetter(0)):
        yield pair, sum(count for _, count in counts)


def _rows_by_key(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


_SUMS = "radix int, salt int, first long, sums binary"
_SUMS_NAMES, _SUMS_KINDS = ["radix", "salt", "first", "sums"], [pa.int32(), pa.int32(), pa.int64(), pa.binary()]


def _sums_batch(radix: int, salt: int, *columns: np.ndarray) -> pa.RecordBatch:
    return _batch([(radix, salt, int(columns[0][0]), pack(*columns))], _SUMS_NAMES, _SUMS_KINDS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of pairs over the runs of each (radix, salt), in blocks."""
    for (radix, salt), rows in groupby(_rows_by_key(batches, "radix", "salt", "run"), itemgetter(0, 1)):
        counts = merged([_run_counts(run) for _, _, run in rows])
        while block := list(islice(counts, BLOCK_PAIRS)):
            pairs, sums = zip(*block)
            yield _sums_batch(radix, salt, np.array(pairs, np.uint32), np.array(sums, np.uint64))


def _block_counts(blocks: list[bytes]) -> Iterator[tuple[int, int]]:
    for block in blocks:
        pairs, sums = unpack(block)
        for at in range(0, len(pairs), _SLICE):
            yield from zip(pairs[at : at + _SLICE].tolist(), sums[at : at + _SLICE].tolist())


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of each radix in side-major order, in blocks: pairs, counts, and whether a count is its right id's largest."""
    for radix, rows in groupby(_rows_by_key(batches, "radix", "salt", "sums"), itemgetter(0)):
        sources = [_block_counts([sums for _, _, sums in same]) for _, same in groupby(rows, itemgetter(1))]
        block: list[tuple[int, int, bool]] = []
        for _, same in groupby(merged(sources), lambda entry: entry[0] >> _ID_BITS):
            entries = list(same)
            most = max(count for _, count in entries)
            block += [(pair, count, count == most) for pair, count in entries]
            if len(block) >= BLOCK_PAIRS:
                yield _totals_batch(radix, block)
                block = []
        if block:
            yield _totals_batch(radix, block)


def _totals_batch(radix: int, block: list[tuple[int, int, bool]]) -> pa.RecordBatch:
    pairs, counts, best = zip(*block)
    return _sums_batch(radix, 0, np.array(pairs, np.uint32), np.array(counts, np.uint64), np.array(best, np.uint8))


def _contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each document gets from the pairs of one radix: totals come first, then the runs."""
    names = ["window", "at", "count_sum", "n_best"]
    known, totals = None, None
    for radix, salt, window, blob in _rows_by_key(batches, "radix", "salt", "window", "blob"):
        if (radix, salt) != known:
            known, totals = (radix, salt), []
        if window is None:
            totals.append(unpack(blob))
            continue
        if isinstance(totals, list):
            totals = tuple(np.concatenate(columns) for columns in zip(*totals))
        pairs, sizes, docs, times = run_records(blob)
        place = np.searchsorted(totals[0], pairs)
        counts, best = totals[1][place].astype(np.int64), totals[2][place].astype(np.int64)
        sums, bests = np.zeros(WINDOW_DOCS, np.int64), np.zeros(WINDOW_DOCS, np.int64)
        np.add.at(sums, docs, np.repeat(counts, sizes) * times)
        np.add.at(bests, docs, np.repeat(best, sizes) * times)
        met = np.flatnonzero(sums)
        arrays = [np.full(len(met), window), met.astype(np.int32), sums[met], bests[met]]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names)


def align_tokens(docs: DataFrame, left: str, right: str, *, window_chars: int = WINDOW_CHARS, merge_bytes: int = MERGE_BYTES) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every row of ``docs(doc_id, text, …)``.

    ``left`` (A) is the path of a byte-level BPE file, ``right`` (B) of a piece model, both readable on every executor. Both
    encode a blank and the text. Bytes where tokens of both end cut them into groups; tokens that share bytes are
    linked; an id pair's count is its number of links in all rows. ``n_best`` are the links whose count is the
    largest of their B id, ``count_sum`` adds the counts of all links.

    1. Tasks encode windows of documents and spill pair-document records as sorted zstd runs, one for
       each radix of the B id, to a table in the shared folder.
    2. Runs of a radix are dealt to tasks by their windows, as many as its bytes ask for, so a B id that is everywhere is
       spread too. Each merges its runs by a heap and counts pairs; the sums of a radix then meet in side-major order,
       where a B id's pairs are side by side, which yields its maximum.
    3. The same runs are read again beside the totals of their radix and stream back what each document gets.

    A null or empty text, or one whose tokens of either side do not spell a blank and the text, has zeros
    and an empty digest. Equal and repeated rows count each by itself; a null doc_id is like any other. Other columns are
    ignored, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = shipped(docs).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    folder = f"{shared_folder(spark)}/spilled"
    rows.mapInArrow(lambda batches: _spill(batches, left, right, window_chars), _SPILLED).write.parquet(folder)
    spilled = spark.read.schema(_SPILLED).parquet(folder)
    found = spilled.where("radix is null").select("window", "at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    runs = spilled.where("radix is not null").select("window", "radix", "run")

    sizes = runs.groupBy("radix").agg(F.sum(F.octet_length("run")).alias("bytes"))
    salts = {r["radix"]: 1 + r["bytes"] // merge_bytes for r in sizes.collect()}  # one row for each radix
    if not salts:
        return _with_shares(found, None)
    many = F.element_at(F.create_map(*[F.lit(x) for pair in salts.items() for x in pair]), F.col("radix"))
    dealt = runs.withColumn("salt", F.pmod(F.xxhash64("window"), many).cast("int"))
    counts = dealt.repartition("radix", "salt").sortWithinPartitions("radix", "salt")
    sums = counts.mapInArrow(_count, _SUMS)
    totals = sums.repartition("radix").sortWithinPartitions("radix", "salt", "first").mapInArrow(_total, _SUMS)
    each = F.explode(F.sequence(F.lit(0), many.cast("int") - 1)).alias("salt")
    heads = totals.select("radix", each, F.lit(None).cast("long").alias("window"), "first", F.col("sums").alias("blob"))
    bodies = dealt.select("radix", "salt", "window", F.lit(0).cast("long").alias("first"), F.col("run").alias("blob"))
    streams = heads.unionByName(bodies).repartition("radix", "salt").sortWithinPartitions("radix", "salt", "window", "first")
    shares = streams.mapInArrow(_contribute, "window long, at int, count_sum long, n_best long")
    return _with_shares(found, shares.groupBy("window", "at").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best")))


def _with_shares(found: DataFrame, shares: DataFrame | None) -> DataFrame:
    zero = F.lit(0).cast("long")
    if shares is None:
        met = found.withColumns({"count_sum": zero, "n_best": zero})
    else:
        met = found.join(shares, ["window", "at"], "left")
    more = [F.coalesce(n, zero).alias(n) for n in ("n_best", "count_sum")]
    return met.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *more, "groups_sha256")
