"""Toxicity by non-negative positive-unlabelled learning over words and word beginnings."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabproof.llm.common import shipped, whole_text
from tabproof.llm.quality import held_out

#: Bounds of what the classifier is fitted on: confirmed toxic documents, unlabelled ones, features.
POSITIVES, UNLABELLED, FEATURES = 3000, 9000, 512
STEPS, RATE = 400, 0.05
TOXIC_SCORE = 0.7

_WORD = re.compile(r"[^\W\d_]+")
_CACHE_WORDS = 300_000


def word_features(word: str) -> list[str]:
    """The word, and its first four to six letters if it has more."""
    return [word, *(f"{word[:k]}~" for k in (4, 5, 6) if len(word) > k)]


def text_features(text: str) -> set[str]:
    return {f for word in set(_WORD.findall(text.lower())) for f in word_features(word)}


@dataclass(frozen=True)
class ToxicModel:
    """Logistic model over the presence of ``names``."""

    names: tuple[str, ...]
    weights: np.ndarray
    bias: float

    def scorer(self):
        index = {name: i for i, name in enumerate(self.names)}

        class Known(dict):
            def __missing__(known, word: str) -> tuple[int, ...]:  # noqa: N805
                if len(known) >= _CACHE_WORDS:
                    known.clear()
                known[word] = found = tuple(index[f] for f in word_features(word) if f in index)
                return found

        known = Known()

        def score(text: str) -> float:
            hits: set[int] = set()
            for found in map(known.__getitem__, set(_WORD.findall(text.lower()))):
                if found:
                    hits.update(found)
            z = self.bias + float(self.weights[sorted(hits)].sum())
            return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

        return score


def fit_nnpu(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = STEPS, rate: float = RATE
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk of the logistic loss.

    Risk: ``prior * E_P[l(z)] + max(0, E_U[l(-z)] - prior * E_P[l(-z)])``. While the second part is
    below zero, which only over-fitting can make it, the step goes the other way on it.
    """
    d, decay = positive.shape[1], 0.5 / len(unlabelled)
    theta, first, second = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    theta[d] = np.log(prior / (1 - prior))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for step in range(1, steps + 1):
        zp, zu = (x @ theta[:d].astype(np.float32) + theta[d] for x in (positive, unlabelled))
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = -prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
        sign = 1.0 if risk >= 0 else -1.0
        gp = sign * gp - (prior * sigmoid(-zp) / len(zp) if sign > 0 else 0)
        gu = sign * gu
        gradient = np.append(positive.T @ gp.astype(np.float32) + unlabelled.T @ gu.astype(np.float32), gp.sum() + gu.sum())
        gradient[:d] += decay * theta[:d]
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:d], float(theta[d])


def _sample(docs: DataFrame, toxic: DataFrame, positives: int, unlabelled: int) -> DataFrame:
    """``(text, positive)`` of the rows to learn from: those of smallest digest of their ids, on each side.

    An id with several rows teaches its least text, so there are no more rows than ids.
    """
    order = F.xxhash64("doc_id")
    confirmed = toxic.where("toxic = 1").select("doc_id").distinct().orderBy(order, "doc_id").limit(positives)
    others = docs.where(~held_out("doc_id", 3, 1)).select("doc_id").where("doc_id is not null")
    others = others.distinct().orderBy(order, "doc_id").limit(unlabelled)
    wanted = confirmed.select("doc_id", F.lit(True).alias("positive")).unionByName(
        others.select("doc_id", F.lit(False).alias("positive"))
    )
    rows = shipped(docs).select("doc_id", whole_text().alias("text")).join(F.broadcast(wanted), "doc_id")
    return rows.groupBy("doc_id", "positive").agg(F.min("text").alias("text")).select("text", "positive")


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, *, positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES
) -> ToxicModel:
    """Fit on at most ``positives`` confirmed toxic and ``unlabelled`` other documents, held-out ids left out.

    The class prior is the toxic share of all labelled rows that are not held out. The features are the
    ``features`` words and word beginnings that speak most for the confirmed side: in one of a hundred of its
    documents and three at least, and three quarters of the way, on a logarithmic scale, from as frequent on both sides to
    as much more frequent as what only toxic documents have. Without
    toxic or without other rows the model has no features and scores everything 0.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out("doc_id", 3, 1))
    share = known.agg(F.avg("toxic")).first()[0]
    if not share:
        return ToxicModel((), np.zeros(0), -500.0)
    prior = min(max(float(share), 0.01), 0.9)
    sample = _sample(docs, known, positives, unlabelled)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for text, positive in zip(batch.column(0), batch.column(1).to_pylist()):
                for feature in text_features(text.as_py()):
                    found[feature][positive] += 1
            columns = [pa.array(found.keys(), pa.string())]
            columns += [pa.array([n[side] for n in found.values()], pa.int64()) for side in (1, 0)]
            yield pa.RecordBatch.from_arrays(columns, ["feature", "p", "u"])

    sides = {row["positive"]: row["n"] for row in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    if len(sides) < 2:
        return ToxicModel((), np.zeros(0), -500.0)
    counts = sample.mapInArrow(count, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    ratio = F.log((F.col("p") + 0.5) / sides[True]) - F.log((F.col("u") + 0.5) / sides[False])
    least = max(3, sides[True] // 100)
    chosen = counts.where(F.col("p") >= least).where(ratio > 0.75 * float(np.log(1 / prior))).orderBy(F.desc(F.round(F.col("p") * ratio, 6)), "feature").limit(features)
    names = tuple(row["feature"] for row in chosen.collect())
    index = {name: i for i, name in enumerate(names)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(index[f] for f in text_features(t.as_py()) if f in index) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["positive", "at"])

    rows = sample.mapInArrow(encode, "positive boolean, at array<int>").collect()
    dense = np.zeros((len(rows), len(names)), np.float32)
    for i, row in enumerate(rows):
        dense[i, row["at"]] = 1
    positive = np.array([row["positive"] for row in rows], bool)
    weights, bias = fit_nnpu(dense[positive], dense[~positive], prior)
    return ToxicModel(names, weights, bias)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs(doc_id, text, …)``.

    The model of :func:`fit_toxicity` reads the words of the whole text. Null and empty texts score what a
    text without any telling word scores. Labels that are null, neither 0 nor 1, or of unknown
    documents teach nothing, and an id with several rows teaches one text; without a toxic label all scores are 0. Repeated rows give
    repeated rows. A null doc_id is scored and not held out. Other columns of ``docs`` are never
    read. An empty table gives no rows.
    """
    model = fit_toxicity(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            scores = pa.array([of(t.as_py()) for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["doc_id", "score"])

    scored = docs.select("doc_id", whole_text().alias("text")).mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted")
    )
