"""Document quality by regularised quadratic discriminant analysis of text statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabproof.llm.common import saved, shipped, unused, whole_text

SHRINKAGE = 0.1
KEEP_SCORE = 0.3

_BLANK, _LOWER, _UPPER, _DIGIT, _STOP, _SYMBOL, _BAR, _BANG, _OTHER = range(9)
STATISTICS = (
    "log_chars", "log_words", "upper", "digits", "stops", "symbols", "bars", "bangs", "blank",
    "word_length", "word_spread", "symbol_words", "upper_words", "line_length", "distinct",
)


def _classes() -> np.ndarray:
    """Class of every code point of the basic plane."""
    table = np.full(65_536, _OTHER, np.uint8)
    for point in range(65_536):
        char = chr(point)
        if char.isspace():
            table[point] = _BLANK
        elif char.isupper():
            table[point] = _UPPER
        elif char.isalpha():
            table[point] = _LOWER
        elif char.isdigit():
            table[point] = _DIGIT
    for chars, kind in ((".,;:?'\"()-", _STOP), ("#$%&*@^~=+<>{}[]\\/_", _SYMBOL), ("|", _BAR), ("!", _BANG)):
        table[[ord(c) for c in chars]] = kind
    return table


_TABLE: list[np.ndarray] = []


def statistics(text: str) -> np.ndarray:
    """Transformed statistics of a whole text: logarithms of sizes, square roots of shares."""
    if not _TABLE:
        _TABLE.append(_classes())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _TABLE[0][np.minimum(points, 65_535)]
    n = len(kinds)
    share = np.bincount(kinds, minlength=9) / max(n, 1)
    solid = np.concatenate([[0], (kinds != _BLANK).view(np.int8), [0]])
    turns = np.diff(solid)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    words = len(starts)
    lengths = ends - starts
    marked = np.isin(kinds, (_SYMBOL, _BAR))
    upper = kinds == _UPPER
    if words:
        sums = lambda flags: np.add.reduceat(flags.astype(np.int32), starts)  # noqa: E731  blanks add nothing
        symbol_words = float((sums(marked) > 0).mean())
        upper_words = float((2 * sums(upper) > lengths).mean())
        spread, length = float(lengths.std()), float(lengths.mean())
        first = points[starts] * np.uint32(31) + points[ends - 1] + lengths.astype(np.uint32) * np.uint32(7919)
        distinct = len(np.unique(first)) / words
    else:
        symbol_words = upper_words = spread = length = distinct = 0.0
    lines = 1 + int((points == 10).sum())
    roots = np.sqrt([share[_UPPER], share[_DIGIT], share[_STOP], share[_SYMBOL], share[_BAR], share[_BANG], share[_BLANK]])
    return np.array(
        [
            np.log1p(n), np.log1p(words), *roots, np.log1p(length), np.log1p(spread), np.sqrt(symbol_words),
            np.sqrt(upper_words), np.log1p(n / lines), np.sqrt(distinct),
        ]
    )


def document_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, stats)`` for every row of ``docs(doc_id, text, …)``; a null text counts as empty."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(text.as_py()) for text in batch.column(1)]
            flat = pa.array(np.concatenate(rows) if rows else np.empty(0))
            stats = pa.FixedSizeListArray.from_arrays(flat, len(STATISTICS)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), stats], ["doc_id", "stats"])

    return shipped(docs).select("doc_id", whole_text().alias("text")).mapInArrow(measure, "doc_id long, stats array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussian classes; the Cholesky factors of their covariances are kept, inverted."""

    means: np.ndarray
    whiteners: np.ndarray
    offsets: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrinkage: float) -> Discriminant:
        """From each class's count, sum and sum of outer products.

        A class covariance is drawn towards the pooled one, and that towards its diagonal.
        A class without examples takes the pooled mean, so it says nothing.
        """
        n, d = counts.sum(), sums.shape[1]
        if not n:
            return cls(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2))
        pooled_mean = sums.sum(0) / n
        means = np.array([s / c if c else pooled_mean for s, c in zip(sums, counts)])
        scatter = np.array([q - c * np.outer(m, m) for q, c, m in zip(squares, counts, means)])
        pooled = scatter.sum(0) / n
        pooled = (1 - shrinkage) * pooled + shrinkage * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
        whiteners, offsets = [], []
        for c, s in zip(counts, scatter):
            weight = c / (c + 10 * d)
            own = (1 - shrinkage) * s / max(c, 1) + shrinkage * np.diag(np.diag(s)) / max(c, 1) + 1e-6 * np.eye(d)
            factor = np.linalg.cholesky(weight * own + (1 - weight) * pooled)
            whiteners.append(np.linalg.inv(factor))
            offsets.append(np.log((c + 1) / (n + 2)) - np.log(np.diag(factor)).sum())
        return cls(means, np.array(whiteners), np.array(offsets))

    def scores(self, stats: np.ndarray) -> np.ndarray:
        """Probability of class 1 from the difference of the two log densities."""
        logs = [
            o - 0.5 * (((stats - m) @ w.T) ** 2).sum(1) for m, w, o in zip(self.means, self.whiteners, self.offsets)
        ]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def _moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    d = len(STATISTICS)
    for frame in frames:
        stats, label = np.array(frame["stats"].tolist()).reshape(-1, d), frame["label"].to_numpy()
        for kind in (0, 1):
            own = stats[label == kind]
            values = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
            yield pd.DataFrame({"label": kind, "at": np.arange(len(values)), "value": values})


def fit_discriminant(stats: DataFrame, labels: DataFrame, *, shrinkage: float = SHRINKAGE) -> Discriminant:
    """Fit on all rows of ``stats(doc_id, stats)`` that ``labels(doc_id, label)`` marks 0 or 1.

    Counts and moments are summed by Spark; some hundred numbers reach the driver.
    """
    d = len(STATISTICS)
    marked = labels.where("label in (0, 1) and doc_id is not null").select("doc_id", F.col("label").cast("int").alias("label"))
    parts = shipped(stats).join(marked, "doc_id").select("label", "stats").mapInPandas(_moments, "label int, at int, value double")
    flat = np.zeros((2, 1 + d + d * d))
    for row in parts.groupBy("label", "at").agg(F.sum("value").alias("value")).collect():
        flat[row["label"], row["at"]] = row["value"]
    return Discriminant.fit(flat[:, 0], flat[:, 1 : d + 1], flat[:, d + 1 :].reshape(2, d, d), shrinkage)


def score_statistics(stats: DataFrame, model: Discriminant) -> DataFrame:
    """``(doc_id, score)`` for every row of ``stats``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(values))], ["doc_id", "score"])

    return shipped(stats).select("doc_id", "stats").mapInArrow(score, "doc_id long, score double")


def held_out(column: str, parts: int, part: int):
    """Whether a document is kept from learning: crc32 of its id as text, modulo ``parts``, is ``part``."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts == part, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, *, shrinkage: float = SHRINKAGE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs(doc_id, text, …)``.

    Learns from the rows of ``labels(doc_id, quality, …)`` whose doc_id is not held out and
    scores whole texts from their statistics alone. Null and empty texts are scored like any
    text without characters. Labels that are null or neither 0 nor 1, or of unknown
    documents, teach nothing; without any label all scores are 0.5. Repeated rows give repeated
    rows. A null doc_id is scored and not held out. Other columns of ``docs`` are never read.
    """
    stats = saved(document_statistics(docs))
    known = labels.select("doc_id", F.col("quality").alias("label")).where(~held_out("doc_id", 5, 0))
    scored = score_statistics(stats, fit_discriminant(stats, known, shrinkage=shrinkage))
    return scored.select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is predicted to be of quality 1.

    Rows with one doc_id, repeated ones too, stay or go together: they stay if any of them is good. Rows with a
    null doc_id, which cannot be told apart, stay. Null and empty texts are scored as in :func:`quality_scores`. Without
    any label all stay. Other columns come back as they are, whatever their names. An empty table stays empty.
    """
    name = unused(docs.columns, "bad")[0]
    scored = quality_scores(docs, labels).where("doc_id is not null")
    bad = scored.groupBy(F.col("doc_id").alias(name)).agg(F.max("predicted").alias("_p")).where("_p = 0").select(name)
    return docs.join(bad, F.col("doc_id") == F.col(name), "left_anti")
