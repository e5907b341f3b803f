"""Cross-tokenizer alignment against whole encodings and plain counters."""

import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabproof.llm import alignment
from tabproof.llm.alignment import Pair, align_tokens

DATA = "/root/testdata/sf0.001"
LEFT, RIGHT = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [
    "a", "b", "'s", "n't", " ", "  ", "\n", "\r", "\r\n", "{\r\n", "\t", ";", "});", "!", "é", "漢", "😀", "\x1c", "\xa0", "　", "\x85", "▁",
    "<s>", "<|endoftext|>", "0", "12", "the ", " of", "\x00", "<0x0A>", "//", ",", ".", "word", " ", "﻿",
]


@pytest.fixture(scope="module")
def pair():
    return Pair(LEFT, RIGHT)


class Whole:
    """Both tokenizers on whole texts, bytes of tokens spelled out once more."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(LEFT), sentencepiece.SentencePieceProcessor(model_file=RIGHT)
        self.a.encode_special_tokens = True
        spelled = {}
        odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        for b in range(256):
            spelled[chr(256 + odd.index(b)) if b in odd else chr(b)] = b
        self.spelled = spelled

    def bytes_b(self, token):
        piece = self.b.id_to_piece(token)
        return bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("▁", " ").encode()

    def tokens(self, text):
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        spell = [bytes(self.spelled[c] for c in self.a.id_to_token(t)) for t in a], [self.bytes_b(t) for t in b]
        if any(b"".join(s) != (" " + text).encode() for s in spell):
            return None
        return a, b, *spell

    def links(self, text):
        """(a, b) of all overlapping occurrences, and the groups' text."""
        found = self.tokens(text)
        if found is None:
            return None
        a, b, bytes_a, bytes_b = found
        spans = []
        for spelled in (bytes_a, bytes_b):
            at, mine = 0, []
            for raw in spelled:
                mine.append((at, at + len(raw)))
                at += len(raw)
            spans.append(mine)
        ends_b, pairs = [e for _, e in spans[1]], []
        for x, (start, end) in zip(a, spans[0]):
            at = bisect.bisect_right(ends_b, start)
            while at < len(b) and spans[1][at][0] < end:
                pairs.append((x, b[at]))
                at += 1
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        inside = [[[] for _ in cuts], [[] for _ in cuts]]
        for side, ids, mine in zip(inside, (a, b), spans):
            for token, (start, _) in zip(ids, mine):
                side[bisect.bisect_right(cuts, start)].append(token)
        groups = ["|".join(",".join(map(str, ids)) for ids in pair) for pair in zip(*inside)]
        return len(a), len(b), groups, pairs


WHOLE = Whole()


def brute(rows):
    links = [WHOLE.links(text) for _, text in rows]
    counts = Counter(p for found in links if found for p in found[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for (doc_id, _), found in zip(rows, links):
        if found is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, pairs = found
        best, total = sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs)
        out.append((doc_id, n_a, n_b, len(groups), len(pairs), best, total, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PARTS), min_size=1, max_size=14).map("".join), st.text(min_size=1, max_size=30)))
def test_parts_are_encoded_as_in_the_whole(pair, text):
    parts = pair.cut.findall(" " + text)
    assert "".join(parts) == " " + text and all(parts)
    found = [pair.encoded(p) for p in parts]
    whole = WHOLE.tokens(text)
    if whole is None:
        assert None in found
        return
    assert [sum(side, []) for side in zip(*found)] == [whole[0], whole[1]]
    pairs, groups = [], []
    for left, right in found:
        got = pair.links(left, right)
        pairs += got[0]
        groups += got[1].split(";")
    n_a, n_b, want, links = WHOLE.links(text)
    assert groups == want
    assert Counter(pairs) == Counter(alignment.side_major(*np.array(links).T).tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50_000), st.integers(0, 31_999), st.integers(0, 9), st.integers(1, 4)), min_size=1, max_size=200))
def test_runs_give_back_their_records(records):
    a, b, docs, times = np.array(records).T
    got = Counter()
    for radix, run in alignment.sorted_runs(docs, alignment.side_major(a, b), times):
        pairs, sizes, at, n = alignment.run_records(run)
        assert (np.diff(pairs.astype(np.int64)) > 0).all()
        for pair, doc, many in zip(np.repeat(pairs, sizes).tolist(), at.tolist(), n.tolist()):
            assert pair >> (32 - alignment.RADIX_BITS) == radix
            got[pair, doc] += many
    want = Counter()
    for pair, doc, many in zip(alignment.side_major(a, b).tolist(), docs.tolist(), times.tolist()):
        want[pair, doc] += many
    assert got == want


def test_odd_rows(frame, odd_rows):
    rows = [*odd_rows, (20, "▁ is not a blank"), (21, "<s> <|endoftext|> [INST]"), (22, "a\r\nb;\r\n  c"), (23, "x" * 30_000)]
    assert rows_of(align_tokens(frame(rows), LEFT, RIGHT)) == brute(rows)


def test_documents_over_many_windows_and_salts(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(i, t if t is None or len(t) < 6000 else t[:6000]) for i, t in rows]
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, window int, run string").repartition(3)
    assert rows_of(align_tokens(df, LEFT, RIGHT, window_chars=60_000, merge_bytes=3000)) == brute(rows)


def test_one_pair_everywhere(frame):
    rows = [(i, "the the the" if i % 3 else f"only {i} the") for i in range(900)]
    assert rows_of(align_tokens(frame(rows).repartition(6), LEFT, RIGHT, window_chars=2000, merge_bytes=500)) == brute(rows)


def test_a_full_cache_forgets(frame, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(20))) for i in range(60)]
    monkeypatch.setattr(alignment, "CACHE_PIECES", 30)
    assert rows_of(align_tokens(frame(rows), LEFT, RIGHT)) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None), (None, "")]])
def test_no_tokens_at_all(frame, rows):
    assert rows_of(align_tokens(frame(rows), LEFT, RIGHT)) == [(i, 0, 0, 0, 0, 0, 0, "") for i, _ in sorted(rows, key=lambda r: str(r[0]))]
