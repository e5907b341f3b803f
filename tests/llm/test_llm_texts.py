"""Chat formatting, personal data, toxicity, quality, licences, decontamination and packing."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabproof.llm import chat, decontam, licenses, packing, pii, quality, toxicity

from .conftest import words

DATA = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- chat

ROLES = st.one_of(st.sampled_from(["system", "user", "assistant", "tool", "", "[/ROLE]"]), st.text(max_size=6))
PARTS = st.sampled_from(["<s>", "</s>", "[INST]", " [/INST]", "<<SYS>>\n", "\n<</SYS>>", "[ROLE]", "[/END]", "\\", "\\\\", " ", "a", "<", "[", "é😀"])
TEXTS = st.one_of(st.lists(PARTS, max_size=8).map("".join), st.text(max_size=30))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ROLES, TEXTS), max_size=6))
def test_a_formatted_conversation_reads_back(turns):
    template = chat.Template()
    segments = [s for role, text in turns for s in template.segments(role, text)]
    assert list(template.read("".join(t for t, _ in segments))) == turns
    assert "".join(template.unescape(t) for t, loss in segments if loss) == "".join(t for r, t in turns if r == "assistant")


CHAT_SCHEMA = "conv_id long, turn long, role string, text string, segments int, valid string, position int"


def test_conversations_of_odd_rows(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo </s> \\"), (1, 2, "user", None),
        (2, 1, "assistant", "first"), (2, 2, "assistant", "second"),
        (3, 0, "system", ""), (3, 1, "user", "q"), (3, 2, "assistant", "a" * 100_000),
        (None, None, None, None), (None, 0, "user", "x"), (4, 0, "user", "tie"), (4, 0, "user", "tie"),
    ]
    df = spark.createDataFrame([(*r, 1, "v", 2) for r in rows], CHAT_SCHEMA)
    formatted = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.read_conversations(formatted).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, r in got.items():
        mine = sorted((x for x in rows if x[0] == conv), key=lambda x: (-1 if x[1] is None else x[1], x[2] or "", x[3] or ""))
        turns = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine)
        loss = "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert r["n_turns"] == len(mine)
        assert r["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    written = Counter()
    for r in formatted.collect():
        written[r["conv_id"]] += sum(len(s["text"]) for s in r["segments"])
    assert {c: r["formatted_chars"] for c, r in got.items()} == dict(written)
    assert {c: (r["valid"], r["complete"]) for c, r in got.items()} == {
        1: (True, False), 2: (False, False), 3: (True, True), 4: (False, False), None: (False, False),
    }
    empty = spark.createDataFrame([], CHAT_SCHEMA)
    assert chat.read_conversations(chat.format_conversations(empty)).collect() == []


# ---------------------------------------------------------------- personal data


def plain_spans(text):
    """The base patterns as they are stated."""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        if 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


SCRAPS = st.sampled_from(
    ["a", "b.c", "@", "x@y.zz", "@@", ".", "-", "1", "25", "255", "256", "0001", " ", "+", "(", ")", "4111111111111111", "5500 0000 0000 0004", "+1 (523) 555-1055", "1.2.3.4", "é", "\n", "%", "0" * 15]
)


@settings(max_examples=800, deadline=None)
@given(st.lists(SCRAPS, max_size=14).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_long_words_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+1 " * 100_000, "1." * 100_000):
        pii.base_spans(text)


def test_gradients_are_those_of_differences():
    rng = np.random.default_rng(0)
    tagger = pii.Tagger(hidden=3)
    ids, tags = rng.integers(0, pii._CHARS, (2, 5)), np.array([[0, 1, 2, 2, 0], [3, 4, 0, 0, 7]])

    def loss():
        e, _, _ = tagger.emissions(ids)
        move = tagger.p["move"] + tagger.barred
        ahead, _, total = tagger._forward_backward(e)
        path = sum(e[i, t, tags[i, t]] for i in range(2) for t in range(5))
        path += sum(move[tags[i, t], tags[i, t + 1]] for i in range(2) for t in range(4))
        return (total.sum() - path) / 2

    grads = tagger.gradients(ids, tags)
    for name, value in tagger.p.items():
        flat = value.reshape(-1)
        for at in rng.choice(flat.size, min(12, flat.size), replace=False):
            if name == "move" and tagger.barred.reshape(-1)[at] < 0:
                continue
            old = flat[at]
            flat[at] = old + 1e-5
            up = loss()
            flat[at] = old - 1e-5
            down = loss()
            flat[at] = old
            assert grads[name].reshape(-1)[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_windows_cover_every_digit_and_overlap():
    rng = random.Random(1)
    text = "".join(rng.choice("ab 1@.") if rng.random() < 0.2 else "z" for _ in range(5000))
    covered = set()
    for at, part in pii.windows(text):
        assert len(part) <= pii.WINDOW and text[at : at + len(part)] == part
        covered.update(range(at, at + len(part)))
    assert all(i in covered for i, c in enumerate(text) if c in "1@")


def test_spans_across_windows_are_one():
    tags = np.zeros(pii.WINDOW, np.int64)
    one, two = tags.copy(), tags.copy()
    one[90:96] = [1, 2, 2, 2, 2, 2]
    two[42:60] = [1, *[2] * 17]
    sure = np.ones(pii.WINDOW)
    assert pii.reconciled([(0, 96, one, sure), (48, 96, two, sure)]) == [("email", 90, 108, 1.0)]


def test_the_tagger_learns_and_adds_what_the_patterns_miss(frame):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        number = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        mail = f"{words(rng, 1)}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com"
        extra = rng.choice([number, mail, f"version {rng.randrange(9)}.", words(rng, 3)])
        rows.append((i, f"{words(rng, 12)} {extra} {words(rng, 12)}"))
    rows.append((9000, f"{words(rng, 12)} 1 (523) 555-1055 {words(rng, 12)}"))
    tagger = pii.fit_tagger(frame(rows))
    right = total = 0
    for _, text in rows[:900]:
        for at, part in pii.windows(text):
            tags, _ = tagger.decode(np.array([pii.char_ids(part)]))
            gold = pii._tags(at, len(part), pii.base_spans(text))
            right, total = right + (tags[0] == gold).sum(), total + len(gold)
    assert right / total > 0.98
    got = {r["doc_id"]: r for r in pii.personal_data(frame(rows)).collect()}
    for i, text in rows:
        base = pii.base_spans(text)
        listed = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(listed)
        assert len(listed) == len(base) + got[i]["n_added"]
        assert got[i]["base_sha256"] == hashlib.sha256(pii._listed(base).encode()).hexdigest()


def test_personal_data_of_odd_rows(frame, odd_rows):
    got = pii.personal_data(frame(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert pii.personal_data(frame([])).collect() == []
    assert {r["base_sha256"] for r in got if r["doc_id"] in (1, 2)} == {hashlib.sha256(b"").hexdigest()}


# ---------------------------------------------------------------- toxicity and quality


@pytest.fixture(scope="module")
def toxic_rows():
    rng, rows, labels = random.Random(6), [], []
    for i in range(1200):
        bad = rng.random() < 0.15
        text = words(rng, rng.randrange(20, 120)).split(" ")
        if bad:
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(["grobian", "Lumpen" + "abcdef"[rng.randrange(6)], "fiend!"]))
        rows.append((i, " ".join(text)))
        if rng.random() < 0.6:
            labels.append((i, int(bad), 1))
    return rows, labels


LABELS = "doc_id long, toxic int, quality int"


def test_toxicity_on_held_out_rows(spark, frame, toxic_rows):
    rows, labels = toxic_rows
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(frame(rows), spark.createDataFrame(labels, LABELS)).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.7)
    told = [(bad, got[i]["predicted"]) for i, bad, _ in labels if got[i]["held_out"]]
    assert sum(b == p for b, p in told) / len(told) > 0.95


def test_toxicity_learns_nothing_from_held_out_labels(spark, frame, toxic_rows):
    rows, labels = toxic_rows
    other = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t, q) for i, t, q in labels]
    one, two = (
        {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(frame(rows), spark.createDataFrame(x, LABELS)).collect()}
        for x in (labels, other)
    )
    assert one == two


def test_toxicity_of_odd_rows(spark, frame, odd_rows):
    odd = spark.createDataFrame([(4, 1, 1), (6, 0, 0), (7, None, None), (999, 1, 1), (None, 1, 1)], LABELS)
    for labels in (odd, spark.createDataFrame([], LABELS)):
        got = toxicity.toxicity_scores(frame(odd_rows), labels).collect()
        assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
        assert len(quality.quality_scores(frame(odd_rows), labels).collect()) == len(odd_rows)
    assert toxicity.toxicity_scores(frame([]), odd).collect() == [] == quality.quality_scores(frame([]), odd).collect()


def test_an_id_of_many_rows_teaches_one_text(spark, frame):
    rows = [(1, f"text {i}") for i in range(500)] + [(3, "other"), (4, "fourth")]
    toxic = spark.createDataFrame([(1, 1, 0), (4, 0, 0)], LABELS)
    ids = [i for i in (1, 3, 4) if zlib.crc32(str(i).encode()) % 3 != 1]
    got = toxicity._sample(frame(rows), toxic, 10, 10).collect()
    assert sorted(r["text"] for r in got if r["positive"]) == ["text 0"]
    assert len([r for r in got if not r["positive"]]) == len(ids)


def test_the_risk_stays_non_negative():
    rng = np.random.default_rng(1)
    positive = (rng.random((60, 80)) < 0.1).astype(np.float32)
    unlabelled = (rng.random((300, 80)) < 0.1).astype(np.float32)
    positive[:, 0], unlabelled[:, 0] = 1, rng.random(300) < 0.2
    weights, bias = toxicity.fit_nnpu(positive, unlabelled, 0.2)
    zp, zu = positive @ weights + bias, unlabelled @ weights + bias
    assert np.logaddexp(0, zu).mean() - 0.2 * np.logaddexp(0, zp).mean() > -0.02
    assert weights[0] == weights.max()


def test_discriminant_is_the_difference_of_log_densities():
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, (400, 3)), rng.normal(1.5, [0.5, 1, 2], (300, 3))
    counts, sums = np.array([400.0, 300.0]), np.array([a.sum(0), b.sum(0)])
    model = quality.Discriminant.fit(counts, sums, np.array([a.T @ a, b.T @ b]), 0.0)
    x = rng.normal(0.7, 1, (20, 3))
    logs = []
    pooled = sum((z - z.mean(0)).T @ (z - z.mean(0)) for z in (a, b)) / 700 + 1e-6 * np.eye(3)
    for z, n in ((a, 400), (b, 300)):
        weight = n / (n + 30)
        cov = weight * (np.cov(z.T, bias=True) + 1e-6 * np.eye(3)) + (1 - weight) * pooled
        d = x - z.mean(0)
        logs.append(np.log((n + 1) / 702) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (d @ np.linalg.inv(cov) * d).sum(1))
    assert model.scores(x) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])))


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["quality"] == r["predicted"] for r in got) / len(got) > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0.5 * docs.count() < kept.count() < docs.count()


# ---------------------------------------------------------------- licences


def test_licences_in_all_units(frame):
    mit = licenses.KNOWN["MIT"][3]
    rows = [
        (1, f"Copyright (c) 2020 A. Holder\n{mit.upper()}"),
        (2, f"intro line\n\n© 2021 Somebody\n{mit.replace('sublicense', 'sub-licence')}\n\nend"),
        (3, "words\nreleased under the MIT licence\nwords"),
        (4, "released under the MIT licence, almost"),
        (5, "This work is licenced under CC BY 4.0"), (5, "This work is licenced under CC BY 4.0"),
        (6, None), (7, ""), (8, " \n"), (None, "ISC license"),
    ]
    got = sorted((tuple(r) for r in licenses.license_mentions(frame(rows)).collect()), key=str)
    assert got == [
        (1, "MIT", True, 1, 0),
        (2, "MIT", False, 1, 0),
        (3, "MIT", False, 0, 1),
        (5, "CC-BY-4.0", True, 2, 2),
        (None, "ISC", True, 1, 1),
    ]
    assert licenses.license_mentions(frame([])).collect() == []


# ---------------------------------------------------------------- decontamination


@pytest.fixture(scope="module")
def items():
    rng = random.Random(9)
    return [(i, f"{words(rng, rng.randrange(8, 60), 500)}. {words(rng, rng.randrange(1, 8), 500)}.") for i in range(300)]


def test_wand_finds_all_items_above_the_threshold(items):
    rng = random.Random(10)
    index = decontam.ItemIndex(items)
    for _ in range(150):
        own = rng.choice(items)[1].split(" ")
        text = " ".join([words(rng, 30, 500), *own[: rng.randrange(len(own))], words(rng, 30, 500), *rng.choice(items)[1].split(" ")[3:20]])
        _, terms = index.terms(decontam.words_of(text))
        terms = sorted(set(terms.tolist()))
        scores = defaultdict(float)
        for term in terms:
            for item, weight in index.postings[term][0]:
                scores[item] += weight
        for threshold in (0.05, 0.3, 0.6):
            expected = {i: s for i, s in scores.items() if s >= threshold}
            found = dict(index.search(terms, threshold))
            assert found.keys() == expected.keys()
            assert all(found[i] == pytest.approx(expected[i]) for i in found)


def test_planted_items_are_found_and_clean_documents_stay(spark, frame, items):
    rng = random.Random(11)
    rows, expected = [], set()
    for i in range(120):
        text = words(rng, rng.randrange(0, 700), 500)
        if i % 3 == 0:
            item, passage = rng.choice(items)
            at = text.find(" ", rng.randrange(len(text) + 1))
            text = f"{text[:at]} {passage.upper()} {text[at:]}"
            expected.add((i, item))
        rows.append((i, text))
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in [*items, items[0], (None, "alone"), (7000, None), (7001, "")]], "item_id long, text string, doc_id int")
    got = decontam.contaminated(frame(rows), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == expected
    assert all(r["score"] > 0.99 and r["question_overlap"] == r["answer_overlap"] == 1 for r in got)
    clean = decontam.decontaminate(frame(rows), benchmark)
    assert clean.columns == frame(rows).columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in expected}


def test_copies_without_their_last_sentence_are_found(spark, frame):
    rng = random.Random(12)
    asked = [words(rng, 40, 500) for _ in range(20)]
    items = [(i, f"{q}. {'Er' if i % 2 else words(rng, 10, 500)}.") for i, q in enumerate(asked)]
    rows = [(i, f"{words(rng, 50, 500)} {q} {words(rng, 50, 500)}") for i, q in enumerate(asked)]
    rows += [(100 + i, f"{words(rng, 50, 500)} {q[: len(q) // 3]} {words(rng, 50, 500)}") for i, q in enumerate(asked)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame(rows), benchmark).collect()}
    assert got == {(i, i) for i in range(20)}
    assert {r["doc_id"] for r in decontam.decontaminate(frame(rows), benchmark).collect()} == set(range(100, 120))


def test_indexes_of_bounded_size_find_the_same(spark, frame, items, monkeypatch):
    docs, benchmark = frame(items[:40]), spark.createDataFrame(items, "item_id long, text string")
    whole = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, benchmark).collect()}
    monkeypatch.setattr(decontam, "INDEX_ITEMS", 70)
    parts = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, benchmark).collect()}
    assert whole == parts == {(i, i) for i, _ in items[:40]}


def test_results_depend_on_neither_blocks_nor_other_items(spark, frame, items, monkeypatch):
    rng = random.Random(13)
    cut = [(i, t.rsplit(" ", rng.randrange(1, 8))[0]) for i, t in items[:60]]
    listed = items[:60]
    benchmark = spark.createDataFrame(listed, "item_id long, text string")

    def rows(items):
        return sorted(map(tuple, decontam.contaminated(frame(cut), items).collect()))

    whole, left = rows(benchmark), decontam.decontaminate(frame(cut), benchmark).count()
    monkeypatch.setattr(decontam, "INDEX_ITEMS", 20)
    parts = rows(benchmark)
    assert [(r[0], r[1], r[5]) for r in parts] == [(r[0], r[1], r[5]) for r in whole]
    assert [x for r in parts for x in r[2:5]] == pytest.approx([x for r in whole for x in r[2:5]])
    assert decontam.decontaminate(frame(cut), benchmark).count() == left
    short = decontam.words_of(items[0][1])
    strewn = " ".join(f"{a} {b} {words(rng, 60, 500).replace('w', 'v')}" for a, b in zip(short, short[1:]))
    long_item = [(5000, words(rng, 6000, 5000).replace("w", "u"))]
    both = spark.createDataFrame([*listed, *long_item], "item_id long, text string")
    assert decontam.contaminated(frame([(1, strewn)]), both).collect() == []
    assert [r["item_id"] for r in decontam.contaminated(frame(long_item), both).collect()] == [5000]


def test_decontamination_of_odd_rows(spark, frame, odd_rows, items):
    benchmark = spark.createDataFrame([*items, (900, "no name but text")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame(odd_rows), benchmark).collect()] == [(None, 900)]
    assert decontam.decontaminate(frame(odd_rows), benchmark).count() == len(odd_rows) - 1
    nothing = benchmark.where("false")
    assert decontam.contaminated(frame(odd_rows), nothing).collect() == [] == decontam.contaminated(frame([]), benchmark).collect()
    assert decontam.decontaminate(frame(odd_rows), nothing).count() == len(odd_rows)


# ---------------------------------------------------------------- packing


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.integers(1, 6))
def test_best_fit_against_a_plain_search(lengths, open_bins):
    fast, bins, order = packing.BestFit(50, open_bins), {}, 0
    for length in lengths:
        bin_id, offset = fast.put(length)
        fitting = [(free, b) for b, free in bins.items() if free >= length]
        if fitting:
            best = min(free for free, _ in fitting)
            assert bins[bin_id] == best and offset == 50 - best
        else:
            if len(bins) >= open_bins:
                least = min(bins.values())
                gone = [b for b in bins if bins[b] == least]
                assert any(b not in {x for s in fast.bins.values() for x in s} for b in gone)
                bins = {b: f for b, f in bins.items() if b in {x for s in fast.bins.values() for x in s}}
            assert bin_id == order and offset == 0
            order += 1
            bins[bin_id] = 50
        bins[bin_id] -= length
        if not bins[bin_id]:
            del bins[bin_id]


def checked_packing(rows, got, tokenizer, capacity):
    def ids(text):
        return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]

    expected = Counter()
    for i, text in rows:
        mine = ids(text)
        for piece, at in enumerate(range(0, len(mine), capacity)):
            part = mine[at : at + capacity]
            expected[(i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r["length"] for r in got)


def test_packing_of_documents(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    n, total = checked_packing(rows, packing.pack_documents(docs, TOKENIZER).collect(), Tokenizer.from_file(TOKENIZER), 4096)
    assert n <= 1.01 * total / 4096 + 1


def test_packing_of_odd_rows(frame, odd_rows):
    from tokenizers import Tokenizer

    rows = [*odd_rows, (20, "<|endoftext|> it's <|startoftext|> I'M x<|y"), (21, "ΑΣ İ ẞ × ÷ µ ª ½"), (2**60 + 1, "large id")]
    got = packing.pack_documents(frame(rows), TOKENIZER, capacity=100).collect()
    checked_packing(rows, got, Tokenizer.from_file(TOKENIZER), 100)
    assert packing.pack_documents(frame([]), TOKENIZER).collect() == []


TEXT = st.text(st.one_of(st.sampled_from(" \n\t'sSdDtTlLaeéÉßñ.,!<|>0١½Σςİ"), st.characters(exclude_categories=("Cs",))), max_size=40)


@settings(max_examples=500, deadline=None)
@given(TEXT)
def test_parts_have_the_tokenizers_ids(text):
    if not hasattr(test_parts_have_the_tokenizers_ids, "tokens"):
        test_parts_have_the_tokenizers_ids.tokens = packing.TokenBytes(TOKENIZER)
    tokens = test_parts_have_the_tokenizers_ids.tokens
    joined = b"".join(map(tokens.__getitem__, text.encode().split()))
    assert joined == np.array(tokens.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


# ---------------------------------------------------------------- oracles


@pytest.mark.parametrize("name", ["op5_chat_format", "op6_near_dedup", "op8_license_scan"])
def test_queries_agree_with_their_sql(spark, name):
    import duckdb

    from tabproof.llm.queries import ORACLES, QUERIES

    small = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    want = db.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    ours = QUERIES[name](spark, small)
    assert sorted(ours.columns) == sorted(columns)
    assert sorted(map(tuple, ours.select(*[F.col(c) for c in columns]).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_an_address_with_very_many_zeros_is_no_trouble():
    text = "0" * 6000 + "1.2.3.4 and " + "9" * 6000 + ".1.1.1"
    assert [s for s in pii.base_spans(text) if s[0] == "ip"] == [("ip", 0, 6007)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_packing_uses_the_ids_of_its_tokenizer(frame, name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    texts = ["Hello World", " two  blanks\n", "It's 12, Ünïcödé!", None, "", "tail  "]
    whole = Tokenizer.from_file(path)
    got = {r["doc_id"]: r["ids_crc32"] for r in packing.token_pieces(frame(list(enumerate(texts))), path).collect()}
    for i, text in enumerate(texts):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        assert got[i] == zlib.crc32(np.array(ids, "<u4").tobytes())
