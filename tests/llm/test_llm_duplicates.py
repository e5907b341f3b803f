"""Near-duplicate documents, fuzzy lines and fingerprints against brute force."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabproof.llm import fingerprints, line_dedup, links, near_dedup
from tabproof.llm.shingles import WordHashes, multipliers, parity_words, shingle_set, signature

from .conftest import words


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingles(text, width=5):
    parts = (text or "").encode().lower().split()
    if not parts:
        return frozenset()
    return frozenset(tuple(parts[i : i + width]) for i in range(max(1, len(parts) - width + 1)))


def edited(rng, text, share):
    parts = text.split(" ")
    for _ in range(int(len(parts) * share)):
        parts[rng.randrange(len(parts))] = f"z{rng.randrange(10**6)}"
    return " ".join(parts)


@pytest.fixture(scope="module")
def families():
    """Bases with copies that are changed a little, much, and in chains; one family is a third of all."""
    rng, rows = random.Random(5), []
    for size in (1, 2, 5, 9, 60):
        base = words(rng, 120, 3000)
        rows += [edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.05])) for _ in range(size)]
    chain = words(rng, 200, 3000)
    for _ in range(8):
        chain = edited(rng, chain, 0.012)
        rows.append(chain)
    passage = words(rng, 60, 3000)
    rows += [f"{words(rng, 80, 3000)} {passage} {words(rng, 80, 3000)}" for _ in range(40)]
    rows += [words(rng, 90, 3000) for _ in range(30)]
    rng.shuffle(rows)
    return [(1000 - 3 * i, text) for i, text in enumerate(rows)]


def brute_components(rows, num, den):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    edges = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    ]
    return roots(ids, edges), sets


@pytest.mark.parametrize(("num", "den"), [(85, 100), (4, 5)])
def test_components_are_those_of_all_pairs(frame, families, num, den):
    expected, sets = brute_components(families, num, den)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(frame(families), num=num, den=den).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == expected
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (i == expected[i]) for i, r in got.items())


def test_near_duplicates_of_odd_rows(frame, odd_rows):
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(frame(odd_rows)).collect() if r["doc_id"] is not None)
    by = defaultdict(list)
    for i, *rest in got:
        by[i].append(tuple(rest))
    assert by[1] == by[2] == by[3] == [(0, by[1][0][1], True)] or all(by[i] == [(0, i, True)] for i in (1, 2, 3))
    assert by[4] == [(1, 4, True)] and by[5] == [(1, 4, False)] * 2
    assert by[8][0][1:] == (7, False) and by[7][0][1:] == (7, True)
    assert len(by[9]) == 2 and all(r[1:] == (9, True) for r in by[9])
    unnamed = near_dedup.near_duplicates(frame(odd_rows)).where("doc_id is null").collect()
    assert sorted((r["n_shingles"], r["component_id"], r["kept"]) for r in unnamed) == [(0, None, True), (1, None, True)]
    kept = near_dedup.keep_one_of_each(frame(odd_rows))
    assert kept.columns == frame(odd_rows).columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [-3, 1, 2, 3, 4, 6, 7, 9, 9, 10]


def test_near_duplicates_of_nothing(frame):
    assert near_dedup.near_duplicates(frame([])).collect() == []


def test_signatures_estimate_similarity():
    rng = random.Random(2)
    base = words(rng, 400, 10**6)
    other = edited(rng, base, 0.03)
    hashes, factors = WordHashes(), multipliers(512, 1)
    a, b = (shingle_set(t.encode(), hashes) for t in (base, other))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((signature(a, factors) == signature(b, factors)).mean() - true) < 0.06


def test_match_threshold_misses_as_seldom_as_told():
    t = near_dedup.match_threshold(0.85, 32, 1e-5)
    below = sum(math.comb(32, i) * 0.85**i * 0.15 ** (32 - i) for i in range(t))
    assert below <= 1e-5 < below + math.comb(32, t) * 0.85**t * 0.15 ** (32 - t)


def test_components_of_a_path_a_star_and_a_circle(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(5000, i) for i in range(5001, 5400)]
    circle = [(9000 + i, 9000 + (i + 1) % 12) for i in range(12)]
    edges = path + star + circle
    got = {r["id"]: r["component"] for r in links.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == roots({n for e in edges for n in e}, edges)
    assert links.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def normal(line):
    return line.lower().strip(" \t\r")


def line_set(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


def test_lines_against_brute_force(spark, frame):
    rng = random.Random(8)
    bases = [words(rng, 25, 3000) for _ in range(12)]
    rows = []
    for i in range(60):
        lines = [rng.choice(bases) for _ in range(2)] + [words(rng, 20, 3000)]
        lines[0] = lines[0].replace("x ", "x, ", 1) if rng.random() < 0.5 else lines[0].upper()
        if rng.random() < 0.3:
            lines.append(f"{rng.choice(bases)} q{rng.randrange(100)}")
        rows.append((100 - i, "\n".join(lines)))
    distinct = sorted({normal(line) for _, t in rows for line in t.split("\n")})
    sets = [line_set(line) for line in distinct]
    edges = [
        (a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    ]
    component = dict(zip(distinct, roots(range(len(distinct)), edges).values()))
    home = {}
    for i, t in sorted(rows):
        for line in t.split("\n"):
            home.setdefault(component[normal(line)], i)
    expected = {}
    for i, t in rows:
        seen, dropped = set(), []
        for pos, line in enumerate(t.split("\n")):
            c = component[normal(line)]
            if home[c] != i or c in seen:
                dropped.append(pos)
            seen.add(c)
        expected[i] = dropped
    got = {r["doc_id"]: r for r in line_dedup.line_report(frame(rows)).collect()}
    wrong = [i for i in expected if got[i]["dropped"] != expected[i]]
    assert not wrong
    clean = {r["doc_id"]: r["text"] for r in line_dedup.without_duplicate_lines(frame(rows)).collect()}
    texts = dict(rows)
    for i, dropped in expected.items():
        left = [line for pos, line in enumerate(texts[i].split("\n")) if pos not in dropped]
        assert clean.get(i) == ("\n".join(left) if left else None)


def brute_dropped(rows):
    """The positions that every document loses when all pairs of lines are compared."""
    distinct = sorted({normal(line) for _, t in rows for line in t.split("\n")} - {""})
    sets = [line_set(line) for line in distinct]
    edges = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    component = dict(zip(distinct, roots(range(len(distinct)), edges).values()))
    seen, dropped = set(), {}
    for i, t in sorted(rows):
        lines = [(pos, component[normal(line)]) for pos, line in enumerate(t.split("\n")) if normal(line)]
        dropped[i] = [pos for pos, c in lines if c in seen or seen.add(c)]
    return dropped


def test_lines_of_60_to_90_characters_and_repetitive_lines(frame):
    rng = random.Random(21)
    lines = []
    for size in range(60, 91):
        for _ in range(4):
            line = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=size))
            lines += [line, line[:-4]]
    for pattern in ("-", "=", "*", "#", "_", "~", ".", "+", "ab", "-=", ". ."):
        lines += [pattern * 80, pattern * 81]
    rng.shuffle(lines)
    rows = list(enumerate(lines))
    got = {r["doc_id"]: r["dropped"] for r in line_dedup.line_report(frame(rows)).collect()}
    assert got == brute_dropped(rows)


def test_no_pair_of_lines_at_the_threshold_is_missed(frame):
    rng = random.Random(22)
    rows = []
    for i in range(300):
        line = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=107))
        rows += [(2 * i, line), (2 * i + 1, line[:-20])]
    got = {r["doc_id"]: r["dropped"] for r in line_dedup.line_report(frame(rows)).collect()}
    assert got == brute_dropped(rows) and sum(map(len, got.values())) == 300
    for similarity in (0.5, 0.8, 0.9):
        n = line_dedup.band_count(similarity)
        assert (1 - similarity**line_dedup.BAND_ROWS) ** n <= line_dedup.MISSED < (1 - similarity**line_dedup.BAND_ROWS) ** (n - 1)


def test_few_pairs_of_long_lines_below_the_threshold_are_checked_in_full(frame, monkeypatch):
    rng = random.Random(23)
    base = words(rng, 250, 3000).split(" ")
    rows = []
    for i in range(60):  # each with 18 of 250 words changed: pairs are at about 0.65, too long for maps of 256 bits
        line = list(base)
        for at in rng.sample(range(250), 18):
            line[at] = f"w{rng.randrange(3000)}y"
        rows += [(2 * i, " ".join(line)), (2 * i + 1, " ".join(line[:-4]))]
    sets = {i: line_set(line) for i, line in rows}
    far = sum(5 * len(sets[a] & sets[b]) < 4 * len(sets[a] | sets[b]) for a in sets for b in range(a))
    checked = []

    def counting(buckets, maps, num, den, confirm, *more):
        def counted(pairs):
            checked.append(pairs.distinct().count())
            return confirm(pairs)

        return links.linked_components(buckets, maps, num, den, counted, *more)

    monkeypatch.setattr(line_dedup, "linked_components", counting)
    got = {r["doc_id"]: r["dropped"] for r in line_dedup.line_report(frame(rows)).collect()}
    assert got == brute_dropped(rows) and sum(map(len, got.values())) >= 60
    assert far > 5000 and checked[1] < far / 20


@pytest.mark.parametrize("limit", [0, 100, 1_000_000])
def test_lines_too_long_for_an_array_are_linked_by_rows(frame, monkeypatch, limit):
    rng = random.Random(24)
    rows = []
    for size in (3, 8, 9, 23, 24, 25, 60, 99, 100, 101, 130, 200):
        line = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz é漢😀", k=size))
        rows += [line, line + "z", line[: -(-size * 19 // 20)], line[: size // 2], line[:5] * size, line + line[:30]]
    rows = list(enumerate(rows))
    monkeypatch.setattr(line_dedup, "LONG_LINE", limit)
    got = {r["doc_id"]: r["dropped"] for r in line_dedup.line_report(frame(rows)).collect()}
    assert got == brute_dropped(rows) and sum(map(len, got.values())) > 10


def test_texts_are_cut_into_lines_once(frame, monkeypatch):
    rng = random.Random(25)
    lines = [words(rng, 20, 300) for _ in range(30)]
    rows = [(i, "\n".join([rng.choice(lines), words(rng, 20, 300), rng.choice(lines) + " end", " \t"])) for i in range(20)]
    cut, plain = [], line_dedup.document_lines

    def counted(docs):
        cut.append(docs)
        return plain(docs)

    monkeypatch.setattr(line_dedup, "document_lines", counted)
    got = {r["doc_id"]: r["dropped"] for r in line_dedup.line_report(frame(rows)).collect()}
    assert got == brute_dropped(rows) and any(got.values()) and len(cut) == 1


def test_maps_of_lines_summed_part_by_part(spark):
    rng = random.Random(26)
    sets = {i: [rng.randrange(-(2**63), 2**63) for _ in range(size)] for i, size in enumerate((1, 2, 40, 500))}
    tokens = spark.createDataFrame([(i, t) for i, ts in sets.items() for t in ts], "id long, token long")
    got = {r["id"]: (r["n"], [r[f"p{w}"] for w in range(line_dedup.LINE_MAP_WORDS)]) for r in line_dedup.line_maps(tokens).collect()}
    for i, ts in sets.items():
        assert got[i] == (len(ts), parity_words(np.array(ts, np.int64).view(np.uint64), line_dedup.LINE_MAP_WORDS))


def test_lines_with_carriage_returns_and_tabs(frame):
    rows = [
        (1, "short\r\n\r\n\t\r\nbody of the first text\r"), (2, "\tshort\n\t\n\r\n \t\r\nbody of the second text\r\n"),
        (3, "\r\n\t\n"), (4, "\r"), (5, "\t"), (6, "Short \r\nits own\t"),
    ]
    got = {r["doc_id"]: r["dropped"] for r in line_dedup.line_report(frame(rows)).collect()}
    assert got == brute_dropped(rows) == {1: [], 2: [0], 3: [], 4: [], 5: [], 6: [0]}


def test_lines_of_odd_rows(frame, odd_rows):
    got = line_dedup.line_report(frame(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_lines"] == by[2]["n_lines"] == 1 and by[1]["dropped"] == by[2]["dropped"] == []
    assert by[5]["dropped"] == [0] and by[5]["kept_in"] == [4]
    assert by[7]["dropped"] == [] and len(by[8]["dropped"]) == 150
    assert by[10]["n_lines"] == 4 and by[10]["n_kept"] == 4
    left = line_dedup.without_duplicate_lines(frame(odd_rows))
    assert left.columns == frame(odd_rows).columns
    ids = sorted(r["doc_id"] for r in left.where("doc_id is not null").collect())
    assert ids == [-3, 1, 2, 3, 4, 6, 7, 9, 9, 10] and left.where("doc_id is null").count() == 2
    assert left.where("doc_id = 1").first()["text"] is None
    assert line_dedup.line_report(frame([])).collect() == [] == line_dedup.without_duplicate_lines(frame([])).collect()


def pieces(text):
    found = set()
    for i, line in enumerate(text.split("\n")):
        cuts = [*fingerprints.CUTS, None] if i < fingerprints.CUT_LINES else [0, None]
        found |= {line[a:b] for a, b in zip(cuts, cuts[1:]) if line[a:b]}
    return found


def alike(a, b):
    a, b = pieces(a), pieces(b)
    differ = len(a ^ b)
    return 1.0 if not a and not b else (len(a) + len(b) - differ) / (len(a) + len(b) + differ)


def test_fingerprints_against_brute_force(frame):
    rng = random.Random(4)
    texts = ["\n".join(words(rng, rng.randrange(1, 80), 900) for _ in range(rng.choice([1, 2, 5, 40]))) for _ in range(40)]
    texts += [texts[3], texts[5] + "\nend", "", "é😀" * 50, "x"]
    ids = sorted(rng.sample(range(-5000, 200_000), len(texts)))
    rows = list(zip(ids, texts))
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_report(frame(rng.sample(rows, len(rows)))).collect()}
    prints = {}
    for at, (i, text) in enumerate(rows):
        after = texts[(at + 1) % len(texts)]
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(alike(text, new)) and r["near_next"] == pytest.approx(alike(text, after))
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert len(set(prints.values())) == len(prints)


def test_texts_of_many_lines_take_linear_time(spark):
    one = [f"line {i} of the first" for i in range(6000)]
    other = one[:4500] + [f"line {i} of the second" for i in range(1500)]
    df = spark.createDataFrame([(1, "\n".join(one)), (2, "\n".join(other))], "doc_id long, text string")
    got = {r["doc_id"]: r["near_next"] for r in fingerprints.fingerprint_report(df).collect()}
    assert got[1] == got[2] == pytest.approx(alike("\n".join(one), "\n".join(other)))


def test_fingerprints_of_odd_rows(frame, odd_rows):
    got = fingerprints.fingerprint_report(frame(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_chars"] == 0 and by[1]["fingerprint"] == by[2]["fingerprint"] and by[1]["near_next"] == 1.0
    assert by[10]["edited_sha256"] == hashlib.sha256(
        (lambda t, n: t[: len(t) - len(t) // 2] + n[: len(t) // 2])(dict(odd_rows)[10], "below zero").encode()
    ).hexdigest()
    assert fingerprints.fingerprint_report(frame([])).collect() == []
    one = fingerprints.fingerprint_report(frame([(4, "alone")])).first()
    assert one["near_next"] == 1.0


def test_peeling_recovers_the_difference(spark):
    rows = [([1, 2, 3, 4], [3, 4, 5]), (list(range(100, 160)), list(range(150, 200))), ([], []), ([7], [7])]
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    df = df.select(*[F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in "ab"])
    tables = [fingerprints.table_of(F.col(c), F.lit(fingerprints.CELLS).cast("bigint")) for c in "ab"]
    got = df.select(fingerprints.differing(F.col("a"), F.col("b"), *tables).alias("n")).collect()
    assert [r["n"] for r in got] == [len(set(a) ^ set(b)) for a, b in rows]


CLASHING = "doc_id long, text string, dropped int, version string, bad long, lost_in int, _version int, _dropped long, _bad int, _v int, _d int"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, 1, "v", 2, 3, 4, 5, 6, 7, 8) for i, t in rows], CLASHING)


def test_stages_leave_clashing_columns_alone(spark):
    from tabproof.llm.decontam import decontaminate
    from tabproof.llm.line_dedup import without_duplicate_lines
    from tabproof.llm.near_dedup import keep_one_of_each
    from tabproof.llm.quality import keep_good

    long_line = " ".join(f"word{i}" for i in range(40))
    rows = [(1, long_line), (2, f"{long_line}\nand more of its own here"), (3, None), (None, "no name"), (4, ""), (4, "")]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([], "item_id long, text string")
    stages = [without_duplicate_lines, keep_one_of_each, lambda d: keep_good(d, labels), lambda d: decontaminate(d, items)]
    for stage in stages:
        out = stage(clashing(spark, rows))
        assert out.columns == clashing(spark, []).columns
        got = out.collect()
        assert {tuple(r)[2:] for r in got} == {(1, "v", 2, 3, 4, 5, 6, 7, 8)}
        assert stage(clashing(spark, [])).collect() == []
    texts = {r["doc_id"]: r["text"] for r in without_duplicate_lines(clashing(spark, rows)).collect()}
    assert texts[1] == long_line and texts[2] == "and more of its own here" and texts[3] is None


def test_one_of_two_texts_of_a_document_goes(spark):
    from tabproof.llm.near_dedup import keep_one_of_each

    x, y = (" ".join(f"{c}{i}" for i in range(30)) for c in "xy")
    left = keep_one_of_each(clashing(spark, [(1, x), (2, x), (2, y), (3, None), (None, x)])).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in left), key=str) == sorted([(1, x), (2, y), (3, None), (None, x)], key=str)
