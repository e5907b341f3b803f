"""Benchmark items in training documents: a BM25 index of the items, searched by every passage."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabproof.llm.common import saved, shipped, whole_text

K1, B = 1.2, 0.75
#: Share of an item's own BM25 score that a passage must reach.
SCORE = 0.5
QUESTION_OVERLAP, ANSWER_OVERLAP = 0.6, 0.5
#: Share of the word pairs of a whole item that is enough without its answer.
WHOLE_OVERLAP = 0.7
#: A last sentence of fewer words is no answer but a part of the question.
ANSWER_WORDS = 4
#: Items and characters of one index; larger benchmarks are searched index by index.
INDEX_ITEMS, INDEX_CHARS = 50_000, 16_000_000
PASSAGE_WORDS = 128
_POSTING_BLOCK = 64

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def passage_width(words: list[str]) -> int:
    """Words of the passages in which an item is looked for: ``PASSAGE_WORDS``, doubled until the item fits in half."""
    width = PASSAGE_WORDS
    while width < 2 * len(words):
        width *= 2
    return width


class ItemIndex:
    """BM25 postings of word pairs, in blocks that know their highest weight.

    A weight is divided by its item's own score, so a passage that holds a whole item
    scores 1 for it and one threshold serves all items. ``totals`` are the number of all items,
    the word pairs of one on average, and in how many a pair is when there is more than one; without
    them, those of ``items``. Passages have ``width`` words, at least twice those of the longest item.
    """

    def __init__(self, items: list[tuple[int, str]], totals: tuple[int, float, dict[str, int]] | None = None, width: int | None = None):
        self.items = [i for i, _ in items]
        texts = [words_of(t) for _, t in items]
        self.vocabulary: dict[str, int] = {}
        for words in texts:
            for word in words:
                self.vocabulary.setdefault(word, len(self.vocabulary) + 1)
        self.base = len(self.vocabulary) + 1
        pairs = [Counter(self._codes(self.word_ids(words)).tolist()) for words in texts]
        frequency = Counter(code for found in pairs for code in found)
        if totals is None:
            count = len(items)
            mean = sum(sum(p.values()) for p in pairs) / count if count else 1.0
        else:
            count, mean, shared = totals
            names = ["", *self.vocabulary]
            for code in frequency:
                frequency[code] = shared.get(f"{names[code // self.base]} {names[code % self.base]}", 1)
        self.codes = np.array(sorted(frequency), np.int64)
        at = {code: i for i, code in enumerate(self.codes.tolist())}
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for item, found in enumerate(pairs):
            size = sum(found.values())
            weights = {}
            for code, tf in found.items():
                idf = math.log(1 + (count - frequency[code] + 0.5) / (frequency[code] + 0.5))
                weights[at[code]] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
            own = sum(weights.values())
            for term, weight in weights.items():
                postings[term].append((item, weight / own))
        self.postings = []
        for term in range(len(self.codes)):
            listed = postings[term]
            blocks = [listed[i : i + _POSTING_BLOCK] for i in range(0, len(listed), _POSTING_BLOCK)]
            tops = [(b[-1][0], max(w for _, w in b)) for b in blocks]
            self.postings.append((listed, tops))
        self.highest = np.array([max(w for _, w in listed) for listed, _ in self.postings])
        self.width = width or max([PASSAGE_WORDS, *(passage_width(words) for words in texts)])
        self.parts = []
        for _, text in items:
            sentences = [s for s in map(words_of, re.split(r"[.!?\n]+", text)) if s]
            answered = len(sentences) > 1 and len(sentences[-1]) >= ANSWER_WORDS
            question = [w for s in (sentences[:-1] if answered else sentences) for w in s]
            every = [w for s in sentences for w in s]
            self.parts.append((set(zip(question, question[1:])), set(sentences[-1] if answered else []), set(zip(every, every[1:]))))

    def word_ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def _codes(self, ids: np.ndarray) -> np.ndarray:
        return ids[:-1] * self.base + ids[1:] if len(ids) > 1 else np.empty(0, np.int64)

    def terms(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the indexed pairs among ``words``, and the pairs."""
        codes = self._codes(self.word_ids(words))
        if not len(self.codes) or not len(codes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        near = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        places = np.flatnonzero(self.codes[near] == codes)
        return places, near[places]

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items that score ``threshold`` or more for the pairs, by block-max WAND."""
        lists = [self.postings[t] for t in terms]
        tops = [float(self.highest[t]) for t in terms]
        at = [0] * len(lists)
        live = list(range(len(lists)))
        found = []
        while True:
            live = [i for i in live if at[i] < len(lists[i][0])]
            live.sort(key=lambda i: lists[i][0][at[i]][0])
            bound, pivot = 0.0, -1
            for k, i in enumerate(live):
                bound += tops[i]
                if bound >= threshold - 1e-12:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = lists[live[pivot]][0][at[live[pivot]]][0]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][0][at[live[pivot + 1]]][0] == item:
                pivot += 1
            block_bound, block_end = 0.0, None
            for i in live[: pivot + 1]:
                k = at[i] // _POSTING_BLOCK
                blocks = lists[i][1]
                while k < len(blocks) and blocks[k][0] < item:
                    k += 1
                if k < len(blocks):
                    block_bound += blocks[k][1]
                    block_end = blocks[k][0] if block_end is None else min(block_end, blocks[k][0])
            if block_bound >= threshold - 1e-12:
                score, target = 0.0, item + 1
                for i in live[: pivot + 1]:
                    self._seek(lists[i], at, i, item)
                    if at[i] < len(lists[i][0]) and lists[i][0][at[i]][0] == item:
                        score += lists[i][0][at[i]][1]
                if score >= threshold - 1e-12:
                    found.append((item, score))
            else:
                target = block_end + 1
                if pivot + 1 < len(live):
                    target = min(target, lists[live[pivot + 1]][0][at[live[pivot + 1]]][0])
                target = max(target, item + 1)
            for i in live[: pivot + 1]:
                self._seek(lists[i], at, i, target)

    @staticmethod
    def _seek(postings: tuple, at: list[int], i: int, item: int) -> None:
        listed, blocks = postings
        k = at[i] // _POSTING_BLOCK
        while k < len(blocks) and blocks[k][0] < item:
            k += 1
        at[i] = max(at[i], k * _POSTING_BLOCK)
        while at[i] < len(listed) and listed[at[i]][0] < item:
            at[i] += 1

    def overlaps(self, item: int, words: list[str]) -> tuple[float, float, float]:
        """Share of the question's word pairs, of the answer's words and of all word pairs that are among ``words``."""
        question, answer, every = self.parts[item]
        pairs, single = set(zip(words, words[1:])), set(words)
        asked = len(question & pairs) / len(question) if question else 1.0
        told = len(answer & single) / len(answer) if answer else 1.0
        return asked, told, len(every & pairs) / len(every) if every else 0.0

    def matches(self, words: list[str], score: float, question: float, answer: float, whole: float = WHOLE_OVERLAP) -> list[tuple[int, float, float, float, int]]:
        """``(item_id, score, question overlap, answer overlap, first word)`` of the best passage for each item."""
        places, terms = self.terms(words)
        if not len(places) or self.highest[terms].sum() < score:
            return []
        half = self.width // 2
        step = places // half
        bounds = np.bincount(step, self.highest[terms], int(step[-1]) + 2)
        bounds = bounds + np.append(bounds[1:], 0.0)
        best: dict[int, tuple] = {}
        for window in np.flatnonzero(bounds >= score - 1e-12).tolist():
            low, high = np.searchsorted(step, [window, window + 2])
            for item, reached in self.search(sorted(set(terms[low:high].tolist())), score):
                asked, told, held = self.overlaps(item, words[window * half : (window + 2) * half + 1])
                if (held >= whole or asked >= question and told >= answer) and reached > best.get(item, (0.0,))[0]:
                    best[item] = (reached, asked, told, window * half)
        return [(self.items[item], *best[item]) for item in sorted(best)]


class Block:
    """Items of one block, in an index for each width of passages."""

    def __init__(self, items: list[tuple[int, str]], totals: tuple[int, float, dict[str, int]]):
        by_width = defaultdict(list)
        for item in items:
            by_width[passage_width(words_of(item[1]))].append(item)
        self.indexes = [ItemIndex(listed, totals, width) for width, listed in sorted(by_width.items())]

    def matches(self, text: str, *limits: float) -> list[tuple[int, float, float, float, int]]:
        words = words_of(text)
        return [found for index in self.indexes for found in index.matches(words, *limits)]


def _pairs(items: DataFrame) -> DataFrame:
    """``(pair, n)``: the distinct word pairs of every item, with how often it has them."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                found = Counter(f"{a} {b}" for a, b in zip(words, words[1:]))
                columns = [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["pair", "n"])

    return shipped(items).select("text").mapInArrow(counts, "pair string, n long")


def _blocks(benchmark: DataFrame) -> Iterator[tuple[Block, bool]]:
    """Blocks of bounded size over all items, and whether more follow; one at a time is made.

    The number of items, their mean length and the frequencies of pairs are those of all items, counted once.
    """
    items = benchmark.select("item_id", whole_text().alias("text")).where("text <> ''").distinct()
    size = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(math.ceil(size[0] / INDEX_ITEMS), math.ceil(size[1] / INDEX_CHARS))
    if not blocks:
        return
    seen = saved(_pairs(items).groupBy("pair").agg(F.count("*").alias("df"), F.sum("n").alias("n")))
    mean = (seen.agg(F.sum("n")).first()[0] or size[0]) / size[0]
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        wanted = seen.where("df > 1").select("pair", "df")
        if blocks > 1:
            wanted = wanted.join(_pairs(mine).select("pair").distinct(), "pair")
        shared = {r[0]: r[1] for r in wanted.toLocalIterator()}
        listed = [(r[0], r[1]) for r in mine.orderBy("item_id", "text").toLocalIterator()]
        yield Block(listed, (size[0], mean, shared)), block + 1 < blocks


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, score: float = SCORE, question: float = QUESTION_OVERLAP, answer: float = ANSWER_OVERLAP,
    whole: float = WHOLE_OVERLAP,
) -> DataFrame:
    """``(doc_id, item_id, score, question_overlap, answer_overlap, first_word)``, best passage of each pair.

    Every passage of ``docs(doc_id, text, …)`` (half overlapping windows, for each item the first of 128,
    256, … words of at least twice its own) is a query of word pairs to the index of ``benchmark(item_id, text, …)``.
    All items whose BM25 score reaches the share ``score`` of their own are retrieved. They count
    if the passage also holds the share ``question`` of the word pairs before the item's last
    sentence and ``answer`` of the words in it, or the share ``whole`` of all its word pairs. A last
    sentence of fewer than ``ANSWER_WORDS`` words belongs to the question, and an item of one sentence
    has no answer to hold.

    Null and empty texts match nothing, nor do items of fewer than two words. A null
    doc_id or item_id is returned as it is. Repeated documents give repeated rows, repeated items
    count once. Other columns are ignored. An empty table on either side gives no rows.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
    spark = docs.sparkSession
    found = spark.createDataFrame([], schema)
    texts = shipped(docs).select("doc_id", whole_text().alias("text"))
    for block, more in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [
                    (doc_id, *match)
                    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1))
                    for match in shared.value.matches(text.as_py(), score, question, answer, whole)
                ]
                columns = list(zip(*rows)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.int64()]
                names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        matched = texts.mapInArrow(search, schema)
        if more:
            matched = saved(matched)
            shared.destroy()
        found = found.unionByName(matched)
    return found


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, score: float = SCORE, question: float = QUESTION_OVERLAP, answer: float = ANSWER_OVERLAP,
    whole: float = WHOLE_OVERLAP,
) -> DataFrame:
    """The rows of ``docs`` whose text matches no benchmark item as in :func:`contaminated`.

    Each row is judged by its text alone, so repeated rows and null doc_ids make no difference; null and empty texts stay. Other
    columns come back as they are, whatever their names. An empty table stays empty, and without items all rows stay.
    """
    spark, at = docs.sparkSession, docs.columns.index("text")
    for block, more in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [not shared.value.matches(t.as_py() or "", score, question, answer, whole) for t in batch.column(at)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = shipped(docs).mapInArrow(clean, docs.schema)
        if more:
            docs = saved(docs)
            shared.destroy()
    return docs
