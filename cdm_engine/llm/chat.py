"""Chat formatting by a finite-state machine over roles and a declarative template (operator 2).

A ``Template`` says, for each role, which control strings open and close a turn and whether its text
counts for the loss, and which role may follow which. Formatting yields one row per turn: segments
(text, loss flag) for the opening mark, the text and the closing mark. Control strings inside texts
(and names of unknown roles) are escaped reversibly: a backslash goes behind the first character of
whatever reads as a control string, or as one that is already escaped. Control strings hold their first
character nowhere else, so none can arise across the edges of segments.

Conversations are sorted within a task and stream through it row by row; what is held is one turn,
whatever a conversation's length.

Defined cases: null text and null role are empty; turns with equal numbers are ordered by role, then
text; null turns come first; null conv_ids are one conversation; unknown roles are marked with their
name; a wrong turn order is reported (``valid``, ``first_violation``) and formatted all the same; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import tidied


@dataclass(frozen=True)
class Turn:
    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Turn]
    #: Opens and closes a turn of any other role; its name stands between ``other.opening`` and ``named``.
    other: Turn
    named: str
    #: States of the machine: the roles that may come next; "" is the start.
    follows: dict[str, tuple[str, ...]]
    #: Roles that may end a conversation.
    ends: tuple[str, ...] = field(default=())

    def controls(self) -> list[str]:
        marks = [m for t in (*self.roles.values(), self.other) for m in (t.opening, t.closing)] + [self.named]
        return sorted({m.strip() for m in marks if m.strip()}, key=lambda m: (-len(m), m))

    def escaping(self) -> tuple[str, str]:
        """(pattern of what is escaped, pattern of what is escaped already); both have two groups."""
        found = self.controls()
        for m in found:
            if m[0] in m[1:] or "\\" in m:
                raise ValueError(f"a control string holds its first character once and no backslash: {m!r}")
        body = "|".join(f"{re.escape(m[0])}\\\\*{re.escape(m[1:])}" for m in found)
        return f"(?={body})(.)", body


#: The template of the registered query.
INSTRUCT = Template(
    roles={
        "system": Turn("[SYS] ", " [/SYS]\n"),
        "user": Turn("[INST] ", " [/INST]\n"),
        "assistant": Turn("<s> ", " </s>\n", loss=True),
    },
    other=Turn("[ROLE] ", " [/TURN]\n"),
    named=" [/ROLE] ",
    follows={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("assistant",),
)


class Formatter:
    def __init__(self, template: Template):
        self.template = template
        ahead, body = template.escaping()
        self._ahead = re.compile(ahead, re.S)
        self._escaped = re.compile(body, re.S)
        self.marks = {role: t for role, t in template.roles.items()}
        self._openings = sorted([(t.opening, role) for role, t in template.roles.items()] + [(template.other.opening, None)], key=lambda x: -len(x[0]))

    def escape(self, text: str) -> str:
        return self._ahead.sub(r"\1\\", text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        turn = self.template.roles.get(role)
        if turn is None:
            turn = self.template.other
            opening = f"{turn.opening}{self.escape(role)}{self.template.named}"
        else:
            opening = turn.opening
        return [(opening, False), (self.escape(text), turn.loss), (turn.closing, False)]

    def read(self, text: str, at: int = 0) -> tuple[str, str, int]:
        """(role, text, end) of the turn that starts at a place of formatted text."""
        opening, role = next(((o, r) for o, r in self._openings if text.startswith(o, at)), (None, None))
        if opening is None:
            raise ValueError("no turn starts here")
        at += len(opening)
        turn = self.template.roles.get(role, self.template.other)
        if role is None:
            end = text.index(self.template.named, at)
            role, at = self.unescape(text[at:end]), end + len(self.template.named)
        end = text.index(turn.closing, at)
        return role, self.unescape(text[at:end]), end + len(turn.closing)


class Machine:
    """Checks the order of turns."""

    def __init__(self, template: Template):
        self.template, self.state, self.turns, self.violation = template, "", 0, None

    def step(self, role: str) -> None:
        if self.violation is None and role not in self.template.follows.get(self.state, ()):
            self.violation = self.turns
        self.state, self.turns = role, self.turns + 1

    def end(self) -> None:
        if self.violation is None and self.template.ends and self.state not in self.template.ends:
            self.violation = self.turns


def _ordered(turns: DataFrame) -> DataFrame:
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


SEGMENTS = "array<struct<text: string, loss: boolean>>"


def format_turns(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """(conv_id, turn, place, segments, broken): one row per turn, ordered within each task; ``broken`` says
    that the turn may not follow the one before it. A conversation's formatted text is its segments' texts, in order."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fmt, machine, current = Formatter(template), Machine(template), object()
        kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
        for batch in batches:
            place, segments, broken = [], [], []
            for conv, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != current:
                    machine, current = Machine(template), conv
                place.append(machine.turns)
                machine.step(role)
                broken.append(machine.violation == machine.turns - 1)
                segments.append([{"text": t, "loss": x} for t, x in fmt.segments(role, text)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(place, pa.int64()), pa.array(segments, kind), pa.array(broken, pa.bool_())], names=["conv_id", "turn", "place", "segments", "broken"])

    return _ordered(turns).mapInArrow(run, f"conv_id long, turn long, place long, segments {SEGMENTS}, broken boolean")


class _Digest:
    """What one conversation's formatted text says when it is read back."""

    def __init__(self, fmt: Formatter, conv):
        self.fmt, self.conv, self.machine, self.rest = fmt, conv, Machine(fmt.template), ""
        self.turns, self.loss, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0

    def add(self, segments: list[dict]) -> None:
        text = "".join(s["text"] for s in segments)
        masked = "".join(self.fmt.unescape(s["text"]) for s in segments if s["loss"])
        self.loss.update(masked.encode())
        self.loss_chars += len(masked)
        self.chars += len(text)
        at = 0
        while at < len(text):
            role, said, at = self.fmt.read(text, at)
            self.machine.step(role)
            self.turns.update(f"{role}\n{said}\n".encode())

    def row(self) -> tuple:
        self.machine.end()
        m = self.machine
        return self.conv, m.turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, m.violation is None, -1 if m.violation is None else m.violation


def read_back(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation, read from the rows of ``format_turns`` as they come. first_violation: the
    turn that may not stand where it does (the number of turns, if the end is wrong), else -1."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "first_violation"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64()]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fmt, now = Formatter(template), None
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            done = []
            for conv, segments in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(fmt, conv)
                now.add(segments)
            if done:
                yield out(done)
        if now is not None:
            yield out([now.row()])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, first_violation long")
