"""Conversation repair: the search against all edit scripts, the jobs against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabproof.llm import repair
from tabproof.llm.repair import Costs, cheapest_edits

DATA = "/root/testdata/sf0.01"
PATTERN = re.compile("(s?(ua)+)?")


def brute(rows):
    """Cost, letters and turns over all scripts whose outcome fits the pattern; rows are (role, text, fault)."""
    best = None
    for kinds in itertools.product(*[["D"] if fault in ("blank", "duplicate") else ["K", "U", "A", "D"] for _, _, fault in rows]):
        cost, kept = 0, []
        for (role, text, fault), kind in zip(rows, kinds):
            cost += {"K": 0, "D": 2}.get(kind, 1) + (5 if fault == "truncated" and kind != "D" else 0)
            name = {"K": role, "U": "user", "A": "assistant"}.get(kind)
            kept.append((name, text, "R" if kind in "UA" else kind))
        # Turns are added between, before and after: up to two in a row are ever of use.
        for counts in itertools.product(range(3), repeat=len(rows) + 1):
            total = cost + 5 * sum(counts)
            if best is not None and total > best[0]:
                continue
            for roles in itertools.product(["user", "assistant"], repeat=sum(counts)):
                added, turns, letters = iter(roles), [], ""
                for place, count in enumerate(counts):
                    for _ in range(count):
                        turns.append((next(added), ""))
                        letters += "I"
                    if place < len(rows):
                        name, text, letter = kept[place]
                        letters += letter
                        if name is not None:
                            turns.append((name, text))
                if PATTERN.fullmatch("".join(r[:1] or "?" for r, _ in turns)) and (best is None or (total, letters) < best[:2]):
                    best = total, letters, turns
    return best


def code(role, fault):
    return 4 * {"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + (1 if fault == "truncated" else 2 if fault else 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.just("t"), st.sampled_from([None, None, None, "truncated", "blank"])), max_size=3))
def test_the_search_against_all_scripts(rows):
    assert cheapest_edits(bytes(code(r, f) for r, _, f in rows)) == brute(rows)[:2]


def by_table(codes, costs):
    """Plain dynamic programme from the end, with whole strings."""
    lattice = repair.Lattice(codes, costs)
    best = {4 * len(codes): (0, ""), 4 * len(codes) + 3: (0, "")}
    for i in range(len(codes), -1, -1):
        for _ in range(4):  # insertions stay in the row
            for state in range(4):
                node = 4 * i + state
                options = [(more + best[to][0], letter + best[to][1]) for letter, more, to in lattice.forward(node) if to in best]
                if options and (node not in best or min(options) < best[node]):
                    best[node] = min(options)
    return best[0]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([4 * i + f for i in range(4) for f in range(3)]), max_size=40), st.sampled_from([Costs(), Costs(0, 0, 0, 1, 0), Costs(1, 1, 1, 1, 1), Costs(0, 2, 2, 1, 3)]))
def test_the_search_against_a_table(codes, costs):
    assert cheapest_edits(bytes(codes), costs) == by_table(bytes(codes), costs)


def test_a_long_conversation():
    rng = random.Random(2)
    codes = bytes(rng.choice([4, 8, 4, 8, 0, 12, 5, 9, 6]) for _ in range(20_000))
    cost, letters = cheapest_edits(codes)
    assert len(letters.replace("I", "")) == len(codes) and cost > 0


def in_python(rows, damage):
    """The whole report in plain Python from (conv_id, turn, role, text)."""
    convs, out = {r[0] for r in rows}, {}
    after = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20 if damage else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv in convs:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, marked = set(), []
        for _, _, role, text in mine:
            black = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            fault = "blank" if not black else "duplicate" if (role, text) in seen else None if black[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {r[1] for r in mine} - {None}
        cost, letters = by_table(bytes(code(r, f) for r, _, f in marked), Costs())
        state, at, done = 0, 0, []
        for letter in letters:
            if letter == "I":
                state = (2, 2, 3, 2)[state]
                done.append(({2: "user", 3: "assistant"}[state], ""))
                continue
            role, text, _ = marked[at]
            at += 1
            if letter != "D":
                state = (2, 2, 3, 2)[state] if letter == "R" else {"s": 1, "u": 2, "a": 3}[role[0]]
                done.append(({2: "user", 3: "assistant"}[state] if letter == "R" else role, text))
        count = lambda f: sum(x == f for _, _, x in marked)
        illegal = sum((a[:1], b[:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for (a, _, _), (b, _, _) in itertools.pairwise(marked))
        out[conv] = {
            "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "blank": count("blank"), "duplicate": count("duplicate"),
            "truncated": count("truncated"), "illegal": illegal, "cost": cost, "audit": letters,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest(),
        }
    return out


def reported(df):
    rows = [r.asDict() for r in df.collect()]
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r.pop("conv_id"): r for r in rows}


SCHEMA = "conv_id long, turn long, role string, text string, audit string, _at int, copies string, key int, n int"


def odd_conversations():
    rng = random.Random(4)
    rows = [
        (1, 0, "user", "hi."), (1, 1, "assistant", "yo."), (1, 1, "assistant", "yo."), (1, None, None, None), (1, None, "system", "s!"),
        (2, 5, "tool", "x."), (2, 9, "", "no end"), (2, 9, "assistant", "tie?"), (2, 9, "user", "tie?"),
        (None, 0, "user", "who?"), (None, 1, "assistant", "me. "), (None, 3, "user", " \n\t "), (3, None, None, None),
        (4, 0, "user", "long " * 100_000 + "."), (4, 1, "assistant", "ünï 漢字 😀."), (4, 2, "user", "a:b\nc."),
    ]
    words = ["one.", "two?", "three", "", " ", "four!", "five.\n"]
    rows += [(10 + i % 40, rng.choice([None, *range(8)]), rng.choice(["system", "user", "assistant", "tool", None, "User"]), rng.choice([*words, None])) for i in range(400)]
    return rows


@pytest.mark.parametrize("damage", [True, False])
def test_odd_rows(spark, damage):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], SCHEMA)
    after = repair.damaged(df) if damage else df
    if damage:
        assert reported(repair.repair_report(df, after)) == in_python(rows, True)
    else:
        assert reported(repair.repair_report(df, after)) == in_python(rows, False)


def test_an_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repair.repair_report(df, repair.damaged(df)).collect() == []


def test_a_conversation_with_most_rows(spark):
    rng = random.Random(8)
    rows = [(7 if i % 3 else i, i, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", "c?", f"text {i}."])) for i in range(3000)]
    df = spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], SCHEMA)
    got, want = reported(repair.repair_report(df, df)), in_python([r for r in rows if r[0] != 7], False)
    assert {k: v for k, v in got.items() if k != 7} == want
    assert got[7] == in_python([r for r in rows if r[0] == 7], False)[7]


def test_the_query_on_its_table(spark):
    from tabproof.llm.queries import op12_conversation_repair

    table = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert reported(op12_conversation_repair(spark, DATA)) == in_python([tuple(r) for r in table.collect()], True)


def test_repaired_turns_fit_the_pattern(spark):
    df = spark.read.parquet(f"{DATA}/conversations.parquet")
    _, turns = repair.repair_conversations(repair.damaged(df))
    by = {}
    for r in turns.collect():
        by.setdefault(r["conv_id"], {})[r["position"]] = r["role"][:1]
    for roles in by.values():
        assert sorted(roles) == list(range(len(roles)))
        assert PATTERN.fullmatch("".join(roles[i] for i in range(len(roles))))
