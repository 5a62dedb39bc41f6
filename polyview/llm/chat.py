"""Chat formatting by a declarative template and a finite-state machine over roles.

A template names the marks around each turn, the roles that may follow one
another, and the roles that count for the loss.  The output is segments: pieces
of text with a loss flag, whose concatenation is the training text.  Control
strings inside a turn are escaped with a backslash, so the text can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = ""
SCHEMA = "conv_id long, seg long, turn_no long, kind string, role string, text string, loss boolean, valid boolean"


@dataclass(frozen=True)
class Template:
    """heads: the mark before a turn, by role; a role without one takes ``other``, its own name,
    and ``other_end``.  follows: the roles allowed after each role, from ``START`` on."""

    heads: dict[str, str] = field(default_factory=lambda: {
        "system": "### System:", "user": "### User:", "assistant": "### Assistant:"})
    other: str = "### Role:"
    other_end: str = "</role>"
    end: str = "</turn>"
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {
        START: frozenset({"system", "user"}), "system": frozenset({"user"}),
        "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})
    loss_roles: frozenset[str] = frozenset({"assistant"})
    before: str = " "
    after: str = "\n"

    @property
    def controls(self) -> list[str]:
        return [*self.heads.values(), self.other, self.other_end, self.end]

    def _pattern(self) -> str:
        return "|".join(re.escape(c) for c in sorted(self.controls, key=len, reverse=True))

    def escaper(self) -> re.Pattern[str]:
        return re.compile(rf"\\|{self._pattern()}")

    def reader(self) -> re.Pattern[str]:
        """Matches an escaped backslash or control string (group 1), or a bare control string (group 2)."""
        return re.compile(rf"\\(\\|{self._pattern()})|({self._pattern()})")


DEFAULT = Template()


class Formatter:
    """Turns of one conversation to segments; holds the machine's state and nothing else."""

    def __init__(self, template: Template):
        self.template, self.escaper = template, template.escaper()
        self.state, self.turn, self.seg, self.valid = START, 0, 0, True

    def escape(self, text: str) -> str:
        return self.escaper.sub(r"\\\g<0>", text)

    def segments(self, role: str, text: str) -> Iterator[tuple]:
        t = self.template
        self.valid &= role in t.follows.get(self.state, ())
        self.state = role
        head = t.heads[role] if role in t.heads else f"{t.other}{t.before}{self.escape(role)}{t.other_end}"
        for kind, part in (("head", head + t.before), ("text", self.escape(text)), ("end", t.end + t.after)):
            yield self.seg, self.turn, kind, role, part, kind == "text" and role in t.loss_roles, self.valid
            self.seg += 1
        self.turn += 1


class Reader:
    """Reads turns back from formatted text that comes in any portions."""

    def __init__(self, template: Template):
        self.template, self.pattern = template, template.reader()
        self.roles = {mark: role for role, mark in template.heads.items()}
        self.longest = max(map(len, template.controls)) + 2
        self.rest, self.role, self.parts, self.names = "", None, [], None

    def feed(self, text: str, last: bool = False) -> Iterator[tuple[str, str]]:
        """The turns that are complete; a control string may lie across two portions."""
        text, at = self.rest + text, 0
        stop = len(text) if last else max(0, len(text) - self.longest)
        for hit in self.pattern.finditer(text):
            if hit.start() < at:
                continue
            if hit.start() >= stop:
                break
            yield from self._take(text[at:hit.start()], hit)
            at = hit.end()
            if hit[2]:
                at += len(self.template.after if hit[2] == self.template.end else self.template.before)
        keep = max(at, stop)
        if self.role is not None or self.names is not None:
            self.parts.append(text[at:keep])
        self.rest = text[keep:]

    def _take(self, plain: str, hit: re.Match[str]) -> Iterator[tuple[str, str]]:
        t = self.template
        if hit[1]:
            self.parts += [plain, hit[1]]
        elif hit[2] == t.end:
            yield self.role, "".join([*self.parts, plain])
            self.role, self.parts = None, []
        elif hit[2] == t.other:
            self.names, self.parts = True, []
        elif hit[2] == t.other_end:
            self.role, self.parts, self.names = "".join([*self.parts, plain]), [], None
        else:
            self.role, self.parts = self.roles[hit[2]], []


def unescape(template: Template, text: str) -> str:
    return template.reader().sub(lambda m: m[1] or m[2], text)


def _ordered(turns: DataFrame) -> DataFrame:
    """Whole conversations per task, in order of turn; rows stream through, none are gathered."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Segments of every conversation: conv_id, seg, turn_no, kind (head, text, end), role, text, loss, valid.

    Takes conv_id, turn, role, text; other columns are ignored.  Turns are ordered by
    (turn, role, text), nulls first; repeated rows are turns of their own.  Null roles and
    texts are empty strings; null conversation ids are one conversation.  Turns that break
    the role order are kept; ``valid`` is false from there on.  A task streams over its
    conversations in order and holds one Arrow batch.
    """

    def run(batches):
        own, formatter = None, None
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if formatter is None or conv != own:
                    own, formatter = conv, Formatter(template)
                rows += [(conv, *s) for s in formatter.segments(role, text)]
            if rows:
                yield _batch(rows, SEGMENTS)

    return _ordered(turns).mapInArrow(run, SCHEMA)


SEGMENTS = pa.schema([
    ("conv_id", pa.int64()), ("seg", pa.int64()), ("turn_no", pa.int64()), ("kind", pa.string()),
    ("role", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])
DIGESTS = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Digest:
    """What is read back from one conversation's segments, as running digests."""

    def __init__(self, template: Template):
        self.template, self.reader = template, Reader(template)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.valid = True

    def _read(self, text: str, last: bool = False) -> None:
        for role, said in self.reader.feed(text, last):
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n_turns += 1

    def add(self, text: str, loss: bool, valid: bool) -> None:
        self.chars += len(text)
        self.valid &= valid
        self._read(text)
        if loss:
            plain = unescape(self.template, text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())

    def row(self, conv: int | None) -> tuple:
        self._read("", last=True)
        return (conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid)


def read_back(segments: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Per conversation: turns, digests and sizes, read from the formatted text and the loss flags.

    The segments of a conversation must stand together and in order, as ``format_conversations``
    leaves them.
    """

    def run(batches):
        own, digest = None, None
        for batch in batches:
            rows = []
            for conv, text, loss, valid in zip(
                    *(batch[c].to_pylist() for c in ("conv_id", "text", "loss", "valid")), strict=True):
                if digest is None or conv != own:
                    if digest:
                        rows.append(digest.row(own))
                    own, digest = conv, Digest(template)
                digest.add(text, loss, valid)
            if rows:
                yield _batch(rows, DIGESTS)
        if digest:
            yield _batch([digest.row(own)], DIGESTS)

    return segments.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
             "formatted_chars long, valid boolean")
