"""Personal data: exact base patterns, and a character BiLSTM-CRF that adds spans they miss."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabproof.llm.common import shipped, whole_text

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside; first and further characters of each kind
WINDOW, STRIDE, MARGIN = 96, 48, 32
#: Windows to learn from, at most; half of them hold a labelled span if there are enough.
TRAIN_WINDOWS = 2000
HIDDEN, EPOCHS, BATCH, RATE = 20, 6, 50, 0.02
#: Least mean probability of a span's tags.
CONFIDENCE = 0.9
_DECODE = 256

_TRIGGER = re.compile(r"[0-9@]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, found from each @ so that long words cost their length once."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def _luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by kind, then start: leftmost non-overlapping matches that pass their test."""
    if not _TRIGGER.search(text):
        return []
    spans = [("email", *found) for found in _emails(text)]
    for m in _IP.finditer(text):
        numbers = [part.lstrip("0") or "0" for part in m[0].split(".")]  # any number of zeros may lead
        if all(len(number) <= 3 and int(number) <= 255 for number in numbers):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and _luhn(digits):
            spans.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def windows(text: str) -> list[tuple[int, str]]:
    """Overlapping windows over every place within ``MARGIN`` of a digit or an @, which all kinds contain."""
    regions: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        start, end = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if regions and start <= regions[-1][1]:
            regions[-1][1] = end
        else:
            regions.append([start, end])
    return [
        (at, text[at : min(at + WINDOW, end)])
        for start, end in regions
        for at in range(start, max(start + 1, end - (WINDOW - STRIDE)), STRIDE)
    ]


def char_ids(text: str) -> np.ndarray:
    """Printable ASCII by character; line end, other letters and all else in three classes; 0 pads."""
    ids = np.zeros(WINDOW, np.int64)
    for i, c in enumerate(text):
        point = ord(c)
        ids[i] = point - 31 if 32 <= point < 127 else 96 if c == "\n" else 97 if c.isalpha() else 98
    return ids


_CHARS = 99


def _tags(at: int, length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    tags = np.zeros(WINDOW, np.int64)
    for kind, start, end in spans:
        low, high = max(start, at), min(end, at + length)
        if low < high:
            tag = 1 + 2 * KINDS.index(kind)
            tags[low - at : high - at] = tag + 1
            if start >= at:
                tags[start - at] = tag
    return tags


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class Tagger:
    """Two LSTMs, one reading from each side, and a linear-chain CRF over their states.

    Inputs are characters, so each gate's input weights are a table by character.
    """

    def __init__(self, hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {
            "input": rng.normal(0, 0.1, (2, _CHARS, 4 * hidden)),
            "state": rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, 4 * hidden)),
            "out": rng.normal(0, 0.1, (2, hidden, TAGS)),
            "bias": np.zeros(TAGS),
            "move": np.zeros((TAGS, TAGS)),
        }
        self.p["input"][:, :, hidden : 2 * hidden] += 1.0
        self.barred = np.zeros((TAGS, TAGS))  # a further character follows only its own kind
        for tag in range(2, TAGS, 2):
            self.barred[:, tag] = -1e4
            self.barred[[tag - 1, tag], tag] = 0

    def _read(self, ids: np.ndarray) -> tuple[np.ndarray, list]:
        n, steps, h = len(ids), ids.shape[1], self.hidden
        state, cell, kept = np.zeros((2, n, h)), np.zeros((2, n, h)), []
        both = np.empty((2, n, steps, h))
        for t in range(steps):
            left, right = ids[:, t], ids[:, steps - 1 - t]
            z = np.stack([self.p["input"][0, left], self.p["input"][1, right]]) + state @ self.p["state"]
            gates = 1 / (1 + np.exp(-z[..., : 3 * h]))
            i, f, o = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :]
            g = np.tanh(z[..., 3 * h :])
            previous, before = state, cell
            cell = f * cell + i * g
            curved = np.tanh(cell)
            state = o * curved
            kept.append((previous, before, i, f, o, g, curved))
            both[0, :, t], both[1, :, steps - 1 - t] = state[0], state[1]
        return both, kept

    def emissions(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        both, kept = self._read(ids)
        return both[0] @ self.p["out"][0] + both[1] @ self.p["out"][1] + self.p["bias"], both, kept

    def _forward_backward(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        move = self.p["move"] + self.barred
        n, steps, _ = e.shape
        ahead, back = np.empty_like(e), np.zeros_like(e)
        ahead[:, 0] = e[:, 0]
        for t in range(1, steps):
            ahead[:, t] = e[:, t] + _sum_exp(ahead[:, t - 1, :, None] + move, 1)
        for t in range(steps - 2, -1, -1):
            back[:, t] = _sum_exp(move + (e[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        return ahead, back, _sum_exp(ahead[:, -1], 1)

    def marginals(self, e: np.ndarray) -> np.ndarray:
        ahead, back, total = self._forward_backward(e)
        return np.exp(ahead + back - total[:, None, None])

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-likelihood of ``tags``."""
        n, steps = ids.shape
        h = self.hidden
        e, both, kept = self.emissions(ids)
        ahead, back, total = self._forward_backward(e)
        de = np.exp(ahead + back - total[:, None, None])
        rows, places = np.arange(n)[:, None], np.arange(steps)
        de[rows, places, tags] -= 1
        move = self.p["move"] + self.barred
        pairs = np.exp(
            ahead[:, :-1, :, None] + move + (e[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]
        ).sum((0, 1))
        np.add.at(pairs, (tags[:, :-1], tags[:, 1:]), -1)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["move"] = np.where(self.barred < 0, 0, pairs)
        grads["bias"] = de.sum((0, 1))
        for d in (0, 1):
            grads["out"][d] = np.tensordot(both[d], de, ((0, 1), (0, 1)))
        into = np.stack([de @ self.p["out"][0].T, de @ self.p["out"][1].T])
        ds, dc = np.zeros((2, n, h)), np.zeros((2, n, h))
        for t in range(steps - 1, -1, -1):
            previous, before, i, f, o, g, curved = kept[t]
            ds = ds + np.stack([into[0, :, t], into[1, :, steps - 1 - t]])
            dc = dc + ds * o * (1 - curved**2)
            dz = np.concatenate(
                [dc * g * i * (1 - i), dc * before * f * (1 - f), ds * curved * o * (1 - o), dc * i * (1 - g**2)], -1
            )
            grads["state"] += previous.transpose(0, 2, 1) @ dz
            np.add.at(grads["input"][0], ids[:, t], dz[0])
            np.add.at(grads["input"][1], ids[:, steps - 1 - t], dz[1])
            ds, dc = dz @ self.p["state"].transpose(0, 2, 1), dc * f
        return {k: v / n for k, v in grads.items()}

    def fit(self, ids: np.ndarray, tags: np.ndarray, *, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE) -> None:
        rng = np.random.default_rng(5)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(ids))
            for at in range(0, len(ids), batch):
                step += 1
                mine = order[at : at + batch]
                for k, g in self.gradients(ids[mine], tags[mine]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    now = rate / (1 + epoch)
                    self.p[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of each window, and the probability of each of them."""
        e, _, _ = self.emissions(ids)
        move = self.p["move"] + self.barred
        n, steps, _ = e.shape
        best, came = e[:, 0], []
        for t in range(1, steps):
            options = best[:, :, None] + move
            came.append(options.argmax(1))
            best = options.max(1) + e[:, t]
        tags = np.empty((n, steps), np.int64)
        tags[:, -1] = best.argmax(1)
        for t in range(steps - 2, -1, -1):
            tags[:, t] = came[t][np.arange(n), tags[:, t + 1]]
        sure = np.take_along_axis(self.marginals(e), tags[..., None], 2)[..., 0]
        return tags, sure


def reconciled(found: list[tuple[int, int, np.ndarray, np.ndarray]]) -> list[tuple[str, int, int, float]]:
    """Spans of a document from its windows' ``(start, length, tags, probabilities)``.

    Where windows overlap, the one in which a place lies farther from the edge decides.
    A span is a run of tags of one kind, so one that crosses windows is one span.
    """
    places: dict[int, tuple[int, int, float]] = {}
    for at, length, tags, sure in found:
        for i in range(length):
            depth = min(i, length - 1 - i)
            if depth > places.get(at + i, (-1,))[0]:
                places[at + i] = (depth, int(tags[i]), float(sure[i]))
    spans, run = [], None
    for place in sorted(places):
        _, tag, sure = places[place]
        kind = (tag - 1) // 2 if tag else -1
        if run and (place != run[2] or kind != run[0] or tag % 2):
            spans.append(run)
            run = None
        if kind >= 0:
            run = [kind, place, place + 1, sure, 1] if run is None else [kind, run[1], place + 1, run[3] + sure, run[4] + 1]
    if run:
        spans.append(run)
    return [(KINDS[k], start, end, total / n) for k, start, end, total, n in spans]


def added_spans(text: str, base: list[tuple[str, int, int]], found: list) -> list[tuple[str, int, int]]:
    """The model's spans that are sure enough, hold six characters and a digit or @, and touch no base span."""
    added = []
    for kind, start, end, sure in reconciled(found):
        while start < end and text[start].isspace():
            start += 1
        while start < end and text[end - 1].isspace():
            end -= 1
        free = all(end <= s or e <= start for _, s, e in base)
        if free and end - start >= 6 and sure >= CONFIDENCE and _TRIGGER.search(text, start, end):
            added.append((kind, start, end))
    return added


def fit_tagger(docs: DataFrame, *, limit: int = TRAIN_WINDOWS) -> Tagger | None:
    """Fit on at most ``limit`` windows, labelled by the base patterns; None without any labelled span.

    The windows are those of smallest digest, half of them with a span and half without.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, tags, marked = [], [], []
            for text in batch.column(0):
                text = text.as_py()
                spans = base_spans(text)
                for at, part in windows(text):
                    mine = _tags(at, len(part), [s for s in spans if s[1] < at + WINDOW and s[2] > at])
                    chars.append(char_ids(part).astype(np.uint8).tobytes())
                    tags.append(mine.astype(np.uint8).tobytes())
                    marked.append(bool(mine.any()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(chars, pa.binary()), pa.array(tags, pa.binary()), pa.array(marked, pa.bool_())],
                ["chars", "tags", "marked"],
            )

    texts = shipped(docs).select(whole_text().alias("text")).where(F.col("text").rlike("[0-9@]"))
    labelled = texts.mapInArrow(label, "chars binary, tags binary, marked boolean").distinct()
    ordered = [labelled.where(side).orderBy(F.xxhash64("chars"), "chars").limit(limit // 2) for side in ("marked", "not marked")]
    rows = ordered[0].unionByName(ordered[1]).collect()
    if not any(row["marked"] for row in rows):
        return None
    tagger = Tagger()
    as_ids = lambda name: np.array([np.frombuffer(row[name], np.uint8) for row in rows]).astype(np.int64)
    tagger.fit(as_ids("chars"), as_ids("tags"))
    return tagger


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)`` for every row of ``docs(doc_id, text, …)``.

    Base spans are exact. The tagger, fitted on windows that the base patterns label, reads all
    windows around digits and @ of the whole text and adds spans that touch no base span. ``spans``
    lists both by kind and start, in code points, end exclusive.

    Null and empty texts hold none. Without any base span in the table nothing is learnt and
    nothing added. Repeated rows give repeated rows, a null doc_id stays null, other columns
    are ignored, and an empty table gives no rows.
    """
    tagger = fit_tagger(docs)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text.as_py() for text in batch.column(1)]
            bases = [base_spans(text) for text in texts]
            added: dict[int, list] = {}
            waiting: list[tuple[int, int, str]] = []
            partial: dict[int, list] = {}

            def decode(upto: int | None) -> None:
                while waiting and (upto is None or len(waiting) >= upto):
                    mine, waiting[:_DECODE] = waiting[:_DECODE], []
                    tags, sure = tagger.decode(np.array([char_ids(part) for _, _, part in mine]))
                    for (row, at, part), t, s in zip(mine, tags, sure):
                        if t[: len(part)].any() or row in partial:
                            partial.setdefault(row, []).append((at, len(part), t, s))

            if tagger is not None:
                for row, text in enumerate(texts):
                    waiting.extend((row, at, part) for at, part in windows(text))
                    decode(_DECODE)
                decode(None)
            for row, found in partial.items():
                added[row] = added_spans(texts[row], bases[row], found)
            columns = [batch.column(0)]
            for kind in KINDS:
                columns.append(pa.array([sum(s[0] == kind for s in base) for base in bases], pa.int64()))
            columns.append(pa.array([hashlib.sha256(_listed(base).encode()).hexdigest() for base in bases], pa.string()))
            everything = [
                sorted(base + added.get(row, []), key=lambda s: (KINDS.index(s[0]), s[1])) for row, base in enumerate(bases)
            ]
            columns.append(pa.array([_listed(spans) for spans in everything], pa.string()))
            columns.append(pa.array([len(added.get(row, [])) for row in range(len(bases))], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
            )

    counts = ", ".join(f"n_{kind} long" for kind in KINDS)
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(
        find, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long"
    )
