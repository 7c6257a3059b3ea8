"""Chat formatting: a finite-state machine over roles and a declarative template.

The template gives, for each role, the text before and after a turn and which parts are under the loss. Its control strings
cannot be forged: where a turn's text would spell one, an escape character goes in after the string's first character,
and reading removes it again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import importable, partitions

#: role -> (before, after, whether the text is under the loss). Any other role is written out in `other`.
@dataclass(frozen=True)
class Template:
    roles: dict = field(default_factory=lambda: {"system": ("<s><<SYS>>", "<</SYS>>", False), "user": ("<s>[INST]", "[/INST]", False), "assistant": ("<s>[OUT]", "</s>", True)})
    other: tuple = ("<s><<ROLE>>", "<</ROLE>>", "</s>")
    escape: str = "␛"
    #: state -> {role: next state}; a turn that has no edge makes the conversation invalid from there on.
    edges: dict = field(default_factory=lambda: {"start": {"system": "ready", "user": "asked"}, "ready": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})

    @property
    def controls(self) -> list[str]:
        return sorted({x for before, after, _ in self.roles.values() for x in (before, after)} | set(self.other) | {"<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "<<SYS>>", "<</SYS>>"})

    def guard(self) -> re.Pattern:
        return re.compile(f"({'|'.join(re.escape(x[0]) + '(?=' + re.escape(x[1:]) + ')' for x in self.controls)}|{self.escape})")


def _escaped(text: str, guard: re.Pattern, escape: str) -> str:
    """The escape character itself becomes escape + 0; the first character c of a control string, c + escape + 1."""
    return guard.sub(lambda m: escape + "0" if m[0] == escape else f"{m[0]}{escape}1", text)


def _plain(text: str, escape: str) -> str:
    return re.sub(f"{escape}([01])", lambda m: escape if m[1] == "0" else "", text)


def _ordered(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """A conversation's turns one after another in one task, streamed: it may be longer than memory."""
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.repartition(partitions(df.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chat(df: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Segments in order: conv_id, segment (from 0), text, loss, and valid: whether the machine has accepted every turn so far.

    Rows are taken by turn (nulls first), equal turns by role, then text. A null text or role counts as empty; roles that
    the template doesn't know are written out and make the conversation invalid, but nothing is left out. A null conv_id is a conversation
    of its own. Other columns are not read; an empty table gives an empty one. Turns are streamed: a task holds one batch, whatever a
    conversation's length.
    """
    template = template or Template()
    importable(df.sparkSession)
    rows = _ordered(df, conv_col, turn_col, role_col, text_col)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guard, at, state, k = template.guard(), object(), "start", 0
        for batch in batches:
            convs, ks, texts, losses, valids = [], [], [], [], []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != at:
                    at, state, k = conv, "start", 0
                state = template.edges.get(state, {}).get(role, "bad")
                body = _escaped(text, guard, template.escape)
                if role in template.roles:
                    before, after, loss = template.roles[role]
                else:
                    (a, b, after), loss = template.other, False
                    before = a + _escaped(role, guard, template.escape) + b
                for part, on in ((before, False), (body, loss), (after, False)):
                    convs.append(conv)
                    ks.append(k)
                    texts.append(part)
                    losses.append(on)
                    valids.append(state != "bad")
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array(convs, batch.schema.field("conv_id").type), pa.array(ks, pa.int64()), pa.array(texts, pa.string()), pa.array(losses), pa.array(valids)], names=["conv_id", "segment", "text", "loss", "valid"])

    return rows.mapInArrow(run, f"conv_id {kind}, segment bigint, text string, loss boolean, valid boolean")


@lru_cache(8)
def _marks(controls: tuple[str, ...]) -> tuple[re.Pattern, int]:
    """Any control string, the longest that fits; and the length of the longest."""
    return re.compile("|".join(re.escape(x) for x in sorted(controls, key=len, reverse=True))), max(map(len, controls))


class _Reader:
    """Parses a conversation's formatted text, given in any pieces, by the control strings in it alone: a turn opens with its role's, and
    what follows is its text up to its closing one. A control string anywhere else is an error. What is held is one turn."""

    def __init__(self, template: Template):
        self.template = template
        self.opens = {before: (role, after) for role, (before, after, _) in template.roles.items()}
        self.marks, self.longest = _marks(tuple(template.controls))
        self.n, self.chars, self.loss_chars, self.valid = 0, 0, 0, True
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.role: str | None = None
        self.close, self.held = "", ""

    def read(self, text: str, last: bool = False) -> None:
        self.chars += len(text)
        text, at = self.held + text, 0
        while mark := self.marks.search(text, at):
            if not last and mark.start() + self.longest > len(text):
                break  # it may be the beginning of a longer one
            self._taken(text[at : mark.start()], mark[0])
            at = mark.end()
        self.held = text[at:]
        if last and (self.held or self.role is not None):
            raise ValueError(f"the text ends inside a turn: {self.held[:80]!r}")

    def _taken(self, before: str, mark: str) -> None:
        other, mid, end = self.template.other
        plain = _plain(before, self.template.escape)
        if self.role is None:
            if before or (mark != other and mark not in self.opens):
                raise ValueError(f"{before[:80] + mark!r} between turns")
            self.role, self.close = ("", mid) if mark == other else self.opens[mark]
            if mark == other:
                return
        elif mark != self.close:
            raise ValueError(f"{mark!r} inside a turn that ends in {self.close!r}")
        elif mark == mid:
            self.role, self.close = plain, end
        else:
            self.turns.update(f"{plain}\n".encode())
            self.role = None
            return
        self.n += 1
        self.turns.update(f"{self.role}\n".encode())

    def masked(self, text: str) -> None:
        """A piece of the text that is under the loss."""
        plain = _plain(text, self.template.escape)
        self.loss.update(plain.encode())
        self.loss_chars += len(plain)


def read_chat(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """What the formatted text says, parsed back from the joined segments by the template's control strings alone: a row for each
    conversation.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline for each turn), loss_chars and loss_sha256 (text under the loss mask,
    unescaped), formatted_chars, valid (the role machine's verdict on all turns). Streamed like format_chat: a task holds a batch and
    a turn. Text that is not what the template makes is an error. Segments of a null conv_id are one conversation; an empty table
    gives an empty one.
    """
    template = template or Template()
    importable(segments.sparkSession)
    rows = segments.select("conv_id", "segment", "text", "loss", "valid").repartition(partitions(segments.sparkSession), "conv_id").sortWithinPartitions("conv_id", "segment")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, one = None, None
        out: list[tuple] = []

        def closed() -> tuple:
            one.read("", last=True)
            return (at, one.n, one.turns.hexdigest(), one.loss_chars, one.loss.hexdigest(), one.chars, one.valid)

        def flush(kind_: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            types = (kind_, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])

        for batch in batches:
            kind_ = batch.schema.field("conv_id").type
            for conv, text, loss, valid in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "valid")), strict=True):
                if one is None or conv != at:
                    if one is not None:
                        out.append(closed())
                    at, one = conv, _Reader(template)
                one.read(text)
                one.valid &= valid
                if loss:
                    one.masked(text)
            if out:
                yield flush(kind_)
        if one is not None:
            out.append(closed())
            yield flush(kind_)

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean")
