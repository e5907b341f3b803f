"""Conversations as training text: a state machine over roles and a declarative template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabproof.llm.common import shipped


@dataclass(frozen=True)
class Turn:
    """How turns of a role are written: text between ``before`` and ``after``, trained on or not."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks of the roles, which role may follow which, and what must not appear inside texts.

    No ``before`` is the start of another one; every ``after`` ends in a control string. In texts,
    an escape goes before each control string and each escape, so texts come back exactly.
    """

    turns: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("<<SYS>>\n", "\n<</SYS>>"),
            "user": Turn("<s>[INST] ", " [/INST]"),
            "assistant": Turn(" ", " </s>", loss=True),
        }
    )
    #: Any other role, which is written as escaped text itself.
    other: Turn = Turn("[ROLE]", "[/END]")
    after_role: str = "[/ROLE]"
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    last: tuple[str, ...] = ("assistant",)
    control: tuple[str, ...] = (
        "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/END]",
    )

    def escape(self, text: str) -> str:
        return re.sub("|".join(map(re.escape, ("\\", *self.control))), lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The turn as ``(text, loss)`` segments."""
        turn = self.turns.get(role)
        if turn is None:
            head = self.other.before + self.escape(role) + self.after_role
            return [(head, False), (self.escape(text), self.other.loss), (self.other.after, False)]
        return [(turn.before, False), (self.escape(text), turn.loss), (turn.after, False)]

    def read(self, written: str) -> Iterator[tuple[str, str]]:
        """The ``(role, text)`` turns of a formatted conversation."""
        marks = re.compile(r"\\.|" + "|".join(map(re.escape, self.control)), re.DOTALL)

        def until(ending: str, start: int) -> tuple[str, int]:
            found = next(m for m in marks.finditer(written, start) if m[0][0] != "\\")
            end = found.end()
            if end - len(ending) < start or not written.endswith(ending, start, end):
                raise ValueError(f"no {ending!r} where a turn ends")
            return self.unescape(written[start : end - len(ending)]), end

        at = 0
        while at < len(written):
            role, turn = next(((r, t) for r, t in self.turns.items() if written.startswith(t.before, at)), ("", self.other))
            at += len(turn.before)
            if turn is self.other:
                role, at = until(self.after_role, at)
            text, at = until(turn.after, at)
            yield role, text

    def allows(self, before: str, role: str) -> bool:
        return role in self.follows.get(before, ())


def format_conversations(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """``(conv_id, position, role, segments, valid)`` for every row of ``conversations(conv_id, turn, role, text, …)``.

    ``segments`` are ``(text, loss)``; their texts, joined in the order of ``position``, are the
    formatted conversation. ``valid`` says whether the role may follow the one before.
    Turns are ordered by ``turn`` (null first), then role and text, so ties and repeated rows
    have one order. A null role or text counts as empty; unknown roles are written as such and are never
    valid. Rows with a null conv_id are one conversation. Other columns are ignored. An empty
    table gives no rows.

    A conversation's rows are sorted into one stream; a task holds one turn of it, however
    many it has.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, before, position = (), "", 0
        for batch in batches:
            positions, segments, valid = [], [], []
            ids, roles, texts = (batch.column(i).to_pylist() for i in range(3))
            for conv, role, text in zip(ids, roles, texts):
                if (conv,) != current:
                    current, before, position = (conv,), "", 0
                positions.append(position)
                segments.append([{"text": t, "loss": loss} for t, loss in template.segments(role, text)])
                valid.append(template.allows(before, role))
                before, position = role, position + 1
            kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(positions, pa.int64()), batch.column(1), pa.array(segments, kind), pa.array(valid, pa.bool_())],
                ["conv_id", "position", "role", "segments", "valid"],
            )

    turns = shipped(conversations).select(
        "conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn"
    )
    streams = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return streams.select("conv_id", "role", "text").mapInArrow(
        write, "conv_id long, position long, role string, segments array<struct<text:string,loss:boolean>>, valid boolean"
    )


def read_conversations(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, what :func:`format_conversations` wrote, read back from its segments.

    ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, complete)``: digests
    of role, newline, text, newline per turn and of all unescaped text under the loss mask.
    ``formatted`` comes as written: a conversation's rows together and in order. ``complete`` is
    valid and ended by a role that may be last.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "complete"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]

    class Read:
        def __init__(self, conv):
            self.conv, self.n, self.turns, self.loss = conv, 0, hashlib.sha256(), hashlib.sha256()
            self.loss_chars, self.chars, self.valid, self.role = 0, 0, True, ""

        def add(self, segments, valid):
            written = "".join(s["text"] for s in segments)
            for role, text in template.read(written):
                self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                self.n, self.role = self.n + 1, role
            for segment in segments:
                if segment["loss"]:
                    text = template.unescape(segment["text"])
                    self.loss.update(text.encode("utf-8", "surrogatepass"))
                    self.loss_chars += len(text)
            self.chars += len(written)
            self.valid &= valid

        def row(self):
            complete = self.valid and self.role in template.last
            return (self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid, complete)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            done = []
            for conv, segments, valid in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if state is None or state.conv != conv:
                    if state is not None:
                        done.append(state.row())
                    state = Read(conv)
                state.add(segments, valid)
            yield batch_of(done)
        if state is not None:
            yield batch_of([state.row()])

    return formatted.select("conv_id", "segments", "valid").mapInArrow(
        read,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, valid boolean, complete boolean",
    )
