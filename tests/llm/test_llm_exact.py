"""The extendible-hash index and exact duplicates."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabproof.llm import exact_dedup
from tabproof.llm.exact_dedup import ExtendibleIndex, exact_duplicates

KEYS = st.one_of(st.integers(0, 2**64 - 1), st.integers(0, 7), st.integers(2**64 - 5, 2**64 - 1), st.integers(0, 40).map(lambda i: i << 58))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(KEYS, st.sampled_from([b"", b"a", b"b"]), st.one_of(st.none(), st.integers(-3, 9))), max_size=80), st.integers(0, 6))
def test_the_index_holds_what_was_added(added, skipped):
    index, want = ExtendibleIndex(capacity=2, skipped=skipped), {}
    for key, text, doc_id in added:
        index.add(key, text, doc_id)
        want.setdefault((key, text), []).append(doc_id)
    found = {}
    assert len(index.directory) == 1 << index.depth
    for bits, bucket in index.buckets():
        assert bucket.texts == sum(map(len, bucket.chains.values()))
        assert bucket.texts <= 2 or len(bucket.chains) == 1 or bucket.bits == exact_dedup.MAX_BITS
        for key, chain in bucket.chains.items():
            assert index._bits(key, bucket.bits) == bits
            assert index.directory[index._bits(key, index.depth)] is bucket
            for entry in chain:
                assert entry.key == key and (key, entry.text) not in found
                found[key, entry.text] = entry.keep_id, entry.rows, entry.keep_rows

    def summed(ids):
        top = max(ids, key=lambda i: (i is not None, i))
        return top, len(ids), ids.count(top)

    assert found == {k: summed(v) for k, v in want.items()}


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is not None, i if i is not None else 0), reverse=True)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), at == 0, digest) for at, i in enumerate(ids)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_odd_rows(frame, odd_rows):
    assert rows_of(exact_duplicates(frame(odd_rows))) == brute(odd_rows)


def test_an_empty_table(frame):
    df = exact_duplicates(frame([]))
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and not df.collect()


def test_hot_texts_over_many_tasks_and_tiny_windows(frame, spark):
    rng = random.Random(5)
    texts = ["hot one " * 20, "hot two", None, *[f"text {i}" for i in range(300)]]
    rows = [(i, texts[rng.randrange(3) if rng.random() < 0.7 else rng.randrange(len(texts))]) for i in range(4000)]
    df = frame(rows).repartition(9)
    assert rows_of(exact_duplicates(df, window_bytes=200, owner_bytes=500, capacity=2)) == brute(rows)


def test_texts_of_one_key_are_told_apart_by_their_bytes(frame, monkeypatch):
    rows = [(i, f"t{i % 7}") for i in range(50)]
    monkeypatch.setattr(F, "xxhash64", lambda *_: F.lit(-5).cast("long"))
    assert rows_of(exact_duplicates(frame(rows), capacity=2)) == brute(rows)


def test_an_index_is_extended(frame):
    first, second = [(1, "a"), (2, "b"), (3, "a")], [(10, "a"), (0, "b"), (11, "c"), (12, "c")]
    old = exact_dedup.build_index(frame(first), [], 10)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_duplicates(frame(second), previous=old).collect()}
    assert got == {10: (10, 3, True), 0: (2, 2, False), 11: (12, 2, False), 12: (12, 2, True)}


def test_buckets_stay_within_their_bits(frame):
    rows = [(i, f"text {i}") for i in range(3000)]
    index = exact_dedup.build_index(frame(rows), [], 1, capacity=2).collect()
    assert len(index) == 3000
    held = {}
    for r in index:
        key = r["key"] % 2**64
        assert r["owner"] == key >> 54
        assert r["bucket"] == (key >> (54 - r["bucket_bits"])) & ((1 << r["bucket_bits"]) - 1)
        held[r["owner"], r["bucket_bits"], r["bucket"]] = held.get((r["owner"], r["bucket_bits"], r["bucket"]), 0) + 1
    assert max(held.values()) <= 2 and len({b for _, b, _ in held}) > 2


@pytest.mark.parametrize("rows", [[(None, None)], [(None, "x"), (None, "x"), (4, "x")]])
def test_null_ids(frame, rows):
    assert rows_of(exact_duplicates(frame(rows))) == brute(rows)
