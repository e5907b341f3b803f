"""Conversations with faulty turns, repaired by the cheapest edits: a two-sided Dijkstra search over the edit lattice."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabproof.llm.common import counted, join_by_key, saved, shipped

_BLANK = r"[\x20\x09-\x0D]"
#: Faults of a row, the first that holds.
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
#: What has been written so far, as states of the pattern ``(s?(ua)+)?``.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a role's initial leads to, and the states that it may follow.
_NEXT = {"s": (SYSTEM, (EMPTY,)), "u": (USER, (EMPTY, SYSTEM, ASSISTANT)), "a": (ASSISTANT, (USER,))}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The state that an added or renamed turn leads to.
_TURN = (USER, USER, ASSISTANT, USER)
_BEFORE = tuple(tuple(s for s in range(4) if _TURN[s] == to) for to in range(4))


@dataclass(frozen=True)
class Costs:
    """What edits cost; ``broken`` is added for a truncated row that is not deleted. ``insert`` is above 0."""

    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    broken: int = 5


class Lattice:
    """Edits of rows given as ``(initial, fault)`` codes.

    A node ``4 * i + state`` stands for i rows read and what is written so far. K keeps a row, R gives it the role that
    fits, D deletes it and I writes an empty turn of the role that fits. So the letters alone
    tell the edits, and no node has two edges of one letter.
    """

    def __init__(self, rows: bytes | bytearray, costs: Costs):
        self.rows, self.costs, self.n = rows, costs, len(rows)

    def forward(self, node: int) -> Iterator[tuple[str, int, int]]:
        """``(letter, cost, node)`` of the edges that leave a node, by letter."""
        i, state = divmod(node, 4)
        costs = self.costs
        if i < self.n:
            yield "D", costs.delete, node + 4
        yield "I", costs.insert, 4 * i + _TURN[state]
        if i < self.n:
            initial, fault = divmod(self.rows[i], 4)
            if fault < 2:
                more = costs.broken * fault
                if initial < 3 and state in _NEXT["sua"[initial]][1]:
                    yield "K", costs.keep + more, 4 * i + 4 + initial + 1
                yield "R", costs.rerole + more, 4 * i + 4 + _TURN[state]

    def backward(self, node: int) -> Iterator[tuple[str, int, int]]:
        """``(letter, cost, node)`` of the edges that reach a node."""
        i, state = divmod(node, 4)
        costs = self.costs
        for before in _BEFORE[state]:
            yield "I", costs.insert, 4 * i + before
        if i:
            yield "D", costs.delete, node - 4
            initial, fault = divmod(self.rows[i - 1], 4)
            if fault < 2:
                more = costs.broken * fault
                if state and initial == state - 1:
                    for before in _NEXT["sua"[initial]][1]:
                        yield "K", costs.keep + more, 4 * i - 4 + before
                for before in _BEFORE[state]:
                    yield "R", costs.rerole + more, 4 * i - 4 + before


def cheapest_edits(rows: bytes | bytearray, costs: Costs = Costs()) -> tuple[int, str]:
    """Cost and letters of the cheapest edits; among equals the letters that are ASCII-least.

    A row's code is 4 * (0, 1, 2 for the initials s, u, a; 3 for others) + (0 good, 1 truncated, 2 to be deleted).

    Two heaps grow from the start and from the accepting ends, the nearer one first. The first meeting bounds
    the cost; the search goes on until the two fronts together exceed it, so that every path of that cost
    has an edge between settled nodes of both sides. The nodes that lead to such edges are
    then marked backwards, and one walk takes the least letter at every node: forward and reverse parts
    joined give the least whole, as no cheapest path's letters are the start of another's.
    """
    lattice, n = Lattice(rows, costs), len(rows)
    start, ends = 0, (4 * n, 4 * n + ASSISTANT)
    near: tuple[dict[int, int], dict[int, int]] = ({start: 0}, dict.fromkeys(ends, 0))
    settled: tuple[dict[int, int], dict[int, int]] = ({}, {})
    heaps = [(0, start)], [(0, end) for end in ends]
    edges = lattice.forward, lattice.backward
    best = 0 if start in near[1] else None
    while heaps[0] and heaps[1]:
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best:
            break
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        here, there, done, heap = near[side], near[1 - side], settled[side], heaps[side]
        cost, node = heapq.heappop(heap)
        if node in done:
            continue
        done[node] = cost
        for _, more, other in edges[side](node):
            total = cost + more
            if total < here.get(other, total + 1):
                here[other] = total
                heapq.heappush(heap, (total, other))
            if other in there and (best is None or total + there[other] < best):
                best = total + there[other]
    ahead, behind = settled

    def crosses(cost: int, more: int, other: int) -> bool:
        return other in behind and cost + more + behind[other] == best

    # Of two nodes on one path the later has read more rows, or as many at a higher cost (an insertion).
    leads: set[int] = set()
    for node in sorted(ahead, key=lambda v: (v // 4, ahead[v]), reverse=True):
        cost = ahead[node]
        if node in ends and cost == best:
            leads.add(node)
            continue
        for _, more, other in lattice.forward(node):
            if crosses(cost, more, other) or (other in leads and ahead[other] == cost + more):
                leads.add(node)
                break
    letters, node, cost = [], start, 0
    while not (node in ends and cost == best):
        for letter, more, other in lattice.forward(node):
            if crosses(cost, more, other) or (other in leads and ahead[other] == cost + more):
                letters.append(letter)
                node, cost = other, cost + more
                break
        else:
            raise AssertionError("no cheapest path from here")
    return best, "".join(letters)


def _spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame, every: int = 20) -> DataFrame:
    """``(conv_id, turn, role, text)`` with planted faults, by ``crc32('conv_id:turn') % every``.

    0 drops the row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats the row, 4 makes
    its role user. Null values count as one space, in the digest too; conv_id and turn themselves stay null.
    """
    kind = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn")).cast("binary")) % every
    rows = conversations.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("_kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def faults(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies, blank, truncated, late)``: equal rows once, with their number.

    ``late``: the conversation has the same role and text at an earlier turn (null turns come first). Where
    ``late`` is false, all copies but one are duplicates.
    """
    word, last = rf"\A{_BLANK}*\z", rf"[.!?]{_BLANK}*\z"
    once = saved(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")))
    once = once.withColumn("key", F.sha2(F.to_json(F.struct("conv_id", "role", F.sha2("text", 256).alias("t"))), 256))
    # A null turn is before all others: has_null tells, and min ignores it.
    firsts = counted(
        once.groupBy("key").agg(F.min("turn").alias("first"), F.bool_or(F.col("turn").isNull()).alias("has_null"), F.count("*").alias("n"))
    )
    late = F.col("turn").isNotNull() & (F.col("has_null") | (F.col("turn") > F.col("first")))
    met = join_by_key(once, firsts, "key")
    return met.select(
        "conv_id", "turn", "role", "text", "copies",
        F.col("text").rlike(word).alias("blank"), (~F.col("text").rlike(last)).alias("truncated"), late.alias("late"),
    )


_INITIALS = {"s": 0, "u": 1, "a": 2}
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


class _Seen:
    """A conversation as its rows come in order: one byte a row, and counts."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.before = conv_id, bytearray(), None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.last = None

    def add(self, turn, initial, copies, blank, truncated, late):
        if turn is not None and turn != self.last:
            self.turns, self.last, self.most = self.turns + 1, turn, turn
            self.least = turn if self.least is None else self.least
        code = 4 * _INITIALS.get(initial, 3)
        for copy in range(copies):
            repeated = late or copy > 0
            fault = BLANK if blank else DUPLICATE if repeated else TRUNCATED if truncated else None
            self.blank += fault == BLANK
            self.duplicate += fault == DUPLICATE
            self.truncated += fault == TRUNCATED
            self.illegal += self.before is not None and (self.before, initial) not in _LEGAL
            self.before = initial
            self.rows.append(code + (1 if fault == TRUNCATED else 2 if fault else 0))

    def row(self, costs):
        cost, audit = cheapest_edits(self.rows, costs)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit)


_LONGS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_AUDIT = ", ".join(["conv_id long", *[f"{n} long" for n in _LONGS], "audit string"])


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def audits(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` per conversation of :func:`faults`.

    Texts are not needed here but for the order of rows with one turn and role. A task holds a few bytes
    a row of one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds, seen = ["conv_id", *_LONGS, "audit"], [*[pa.int64()] * 7, pa.string()], None
        for batch in batches:
            done = []
            for conv_id, *row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if seen is None or seen.conv_id != conv_id:
                    if seen is not None:
                        done.append(seen.row(costs))
                    seen = _Seen(conv_id)
                seen.add(*row)
            yield _batch(done, names, kinds)
        if seen is not None:
            yield _batch([seen.row(costs)], names, kinds)

    ordered = shipped(rows).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    initial = F.substring("role", 1, 1)
    return ordered.select("conv_id", "turn", initial, "copies", "blank", "truncated", "late").mapInArrow(run, _AUDIT)


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``(conv_id, position, role, text, edit)``: the conversations of :func:`faults` after the edits of :func:`audits`.

    A conversation's audit comes before its rows in one sorted stream, so a task holds the audit and a row at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "position", "role", "text", "edit"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        audit, at, state, position = "", 0, EMPTY, 0
        for batch in batches:
            out: list[tuple] = []

            def insert(conv_id):
                nonlocal at, state, position
                while at < len(audit) and audit[at] == "I":
                    state = _TURN[state]
                    out.append((conv_id, position, _NAMES[state], "", "I"))
                    at, position = at + 1, position + 1

            for conv_id, edits, role, text, copies in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if edits is not None:
                    audit, at, state, position = edits, 0, EMPTY, 0
                    insert(conv_id)
                    continue
                for _ in range(copies):
                    letter = audit[at]
                    at += 1
                    if letter != "D":
                        state = _TURN[state] if letter == "R" else _NEXT[role[:1]][0]
                        out.append((conv_id, position, _NAMES[state] if letter == "R" else role, text, letter))
                        position += 1
                    insert(conv_id)
            yield _batch(out, names, kinds)

    none = F.lit(None)
    heads = found.select("conv_id", F.lit(0).alias("_at"), none.cast("long").alias("turn"), none.cast("string").alias("role"),
                         none.cast("string").alias("text"), none.cast("long").alias("copies"), "audit")
    bodies = rows.select("conv_id", F.lit(1).alias("_at"), "turn", "role", "text", "copies", none.cast("string").alias("audit"))
    ordered = shipped(heads.unionByName(bodies)).repartition("conv_id").sortWithinPartitions("conv_id", "_at", "turn", "role", "text")
    return ordered.select("conv_id", "audit", "role", "text", "copies").mapInArrow(
        run, "conv_id long, position long, role string, text string, edit string"
    )


def _digests(turns: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)``: of ``role:text`` of the turns as they come, joined by newlines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds, now, digest = ["conv_id", "repaired_sha256"], [pa.int64(), pa.string()], (), None
        for batch in batches:
            done = []
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (conv_id,) != now:
                    if now:
                        done.append((now[0], digest.hexdigest()))
                    now, digest = (conv_id,), hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield _batch(done, names, kinds)
        if now:
            yield _batch([(now[0], digest.hexdigest())], names, kinds)

    return turns.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair_conversations(conversations: DataFrame, costs: Costs = Costs()) -> tuple[DataFrame, DataFrame]:
    """Audits and repaired turns of ``conversations(conv_id, turn, role, text, …)``; see :func:`audits`, :func:`repaired_turns`.

    Rows are taken by turn (null first), then role and text, so ties and repeated rows have one order. A null role or
    text counts as one space. Rows with a null conv_id are one conversation. A conversation without a cheaper way out ends
    empty. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    given = conversations.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text"))
    rows = saved(faults(given))
    found = saved(audits(rows, costs))
    return found, repaired_turns(rows, found)


def repair_report(conversations: DataFrame, after: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` for every conv_id of ``conversations``.

    ``after`` are the rows to repair, such as :func:`damaged` ones. A conversation of which no row is left has zeros, an
    empty audit and the digest of an empty text. See :func:`repair_conversations` for nulls, ties and odd tables.
    """
    found, turns = repair_conversations(after, costs)
    digests = _digests(turns).select(F.col("conv_id").alias("_d"), "repaired_sha256")
    every = conversations.select(F.col("conv_id").alias("_c")).distinct()
    joined = every.join(found, F.col("_c").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    joined = joined.join(digests, F.col("_c").eqNullSafe(F.col("_d")), "left")
    return joined.select(
        F.col("_c").alias("conv_id"),
        *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in _LONGS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
