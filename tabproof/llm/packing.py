"""Documents as token sequences of bounded length, packed by bounded-space best fit."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabproof.llm.common import saved, shipped, whole_text

CAPACITY = 4096
END_ID = 1
#: Pieces that one group packs on its own; a group's last open bins are all that grouping costs.
GROUP_PIECES = 4000
#: Bins a group holds open at once.
OPEN_BINS = 1024
_CACHE_CHUNKS = 700_000


#: Marks, ASCII letters and digits, and the composed letters of Latin-1: their normal form is their lower case.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: How the tokenizer splits such characters, once in lower case.
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


#: Texts that show how a tokenizer treats case, blanks, marks, digits and contractions.
_PROBES = (
    "Hello World  again", " it's 2026, isn't IT?\n\tYES!", "a,b;c... (d) [e] x=1 12345 3.14", "Ünïcödé ÀÉ ß÷× naïve",
    "they'll we've I'M you'd THEY'RE", "#tag @who http://a.b/c?d=e&f", "_snake_case CamelCase UPPER--lower", "1st 2nd 100% $5 <b> \\",
)


class TokenBytes(dict):
    """Ids of a text between two ASCII blanks, as little-endian 32-bit numbers.

    Where the tokenizer drops blanks and none of its steps looks across them (``parted``), the ids of a text
    are the ids of its parts, one after the other; else texts are encoded whole. Where it lower-cases and splits as is done
    here (``plain``), parts of plain characters that no special token can match go to its BPE
    model alone, which is several times as fast. Both are found out on probes when a file is
    loaded. When full, new parts are not kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        latin = [chr(i) for i in (*range(33, 127), *range(0xDF, 0xF7), *range(0xF8, 0x100))]
        self.spelling = {ord(c): spelled.pre_tokenize_str(c)[0][0] for c in latin}
        self.parted = all(self.whole(t) == [i for part in t.split() for i in self.whole(part)] for t in _PROBES)
        self.plain = self.parted and all(self.short(part) == self.whole(part) for t in _PROBES for part in t.split() if self.is_plain(part))

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def short(self, text: str) -> list[int]:
        words = (w.translate(self.spelling) for w in _SPLIT.findall(text.lower()))
        return [token.id for word in words for token in self.tokenizer.model.tokenize(word)]

    @staticmethod
    def is_plain(text: str) -> bool:
        return "<|" not in text and _PLAIN.fullmatch(text) is not None

    def ids(self, text: str) -> list[int]:
        return self.short(text) if self.plain and self.is_plain(text) else self.whole(text)

    def of_text(self, text: bytes) -> bytes:
        if self.parted:
            return b"".join(map(self.__getitem__, text.split()))
        return np.array(self.whole(text.decode("utf-8", "replace")), "<u4").tobytes()

    def __missing__(self, part: bytes) -> bytes:
        value = np.array(self.ids(part.decode("utf-8", "replace")), "<u4").tobytes()
        if len(self) < _CACHE_CHUNKS:
            self[part] = value
        return value


_TOKENS: dict[str, TokenBytes] = {}


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    tokens = _TOKENS.setdefault(path, None) or TokenBytes(path)
    _TOKENS[path] = tokens  # stays with the worker for its next tasks
    end, width = np.array([END_ID], "<u4").tobytes(), 4 * capacity
    for batch in batches:
        out: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            ids = tokens.of_text(text.as_py()) + end
            for piece, at in enumerate(range(0, len(ids), width)):
                part = ids[at : at + width]
                out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
        columns = list(zip(*out)) or [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
        )


def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: ids of each row's text and the end id, cut at ``capacity``.

    Only documents of more than ``capacity`` ids are cut; a null text counts as empty and is
    the end id alone.
    """
    return shipped(docs).select("doc_id", whole_text().alias("text")).mapInArrow(
        lambda batches: _pieces(batches, tokenizer, capacity),
        "doc_id long, piece int, start long, length long, ids_crc32 long",
    )


class BestFit:
    """Online best fit over at most ``open_bins`` bins; the fullest is closed for a new one.

    Bit f of ``free`` says that some open bin has f ids free, so the best bin for a piece
    is the lowest set bit at or above its length.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free, self.bins, self.open, self.next = 0, {}, 0, 0

    def _take(self, room: int) -> int:
        stack = self.bins[room]
        chosen = stack.pop()
        if not stack:
            self.free &= ~(1 << room)
        self.open -= 1
        return chosen

    def put(self, length: int) -> tuple[int, int]:
        """Bin and offset for a piece of ``length`` ids."""
        fitting = self.free >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = self._take(room)
        else:
            if self.open >= self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)
            room, chosen = self.capacity, self.next
            self.next += 1
        left = room - length
        if left:
            self.bins.setdefault(left, []).append(chosen)
            self.free |= 1 << left
            self.open += 1
        return chosen, self.capacity - room


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, open_bins: int) -> Iterator[pa.RecordBatch]:
    group, bins = None, None
    for batch in batches:
        ids, offsets = [], []
        for now, length in zip(batch.column("group").to_pylist(), batch.column("length").to_pylist()):
            if now != group:
                group, bins = now, BestFit(capacity, open_bins)
            place, offset = bins.put(length)
            ids.append((now << 32) + place)
            offsets.append(offset)
        names = [n for n in batch.schema.names if n != "group"]
        columns = [*(batch.column(n) for n in names), pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])


def pack_pieces(
    pieces: DataFrame, *, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, open_bins: int = OPEN_BINS
) -> DataFrame:
    """Add ``sequence_id`` and ``offset``: no two pieces overlap, offsets have no gaps from 0.

    Pieces are dealt by digest to groups of about ``group_pieces`` and come to the packer longest
    first, one group after the other as a stream; a task holds ``open_bins`` bins and no rows.
    ``pieces`` is read twice, so pass a saved table.
    """
    groups = max(1, round(pieces.count() / group_pieces))
    digest = F.xxhash64("doc_id", "piece", "ids_crc32", "length")
    dealt = pieces.withColumn("group", F.pmod(digest, F.lit(groups)).cast("int"))
    ordered = dealt.repartition(groups, "group").sortWithinPartitions(
        "group", F.desc("length"), "doc_id", "piece", "ids_crc32"
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return shipped(ordered).mapInArrow(lambda batches: _pack(batches, capacity, open_bins), schema)


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for every row of ``docs(doc_id, text, …)``.

    ``tokenizer`` is the path of a tokenizer file, readable on every executor. Null and empty
    texts are the end id alone. A repeated row is packed again. A null doc_id is packed
    like any other. Other columns are ignored. An empty table gives no rows. Pieces of one
    length are packed in the order of doc_id, so the result does not depend on partitions.
    """
    return pack_pieces(saved(token_pieces(docs, tokenizer, capacity=capacity)), capacity=capacity)
