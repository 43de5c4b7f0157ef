"""Chat formatting: a declarative template, a finite-state machine over roles, text segments with loss flags.

Conversations are streamed turn by turn out of a sorted partition, so a conversation of any length needs the memory
of one turn. Control strings inside texts are broken by an escape mark after their first character; a string that
already carries k marks gets k + 1, so escaping is reversible.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches


@dataclass(frozen=True)
class RoleStyle:
    """What stands before and after a turn's text, and whether the text counts for the loss."""

    prefix: str
    suffix: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """A chat layout as data. ``transitions[state][role]`` is the next state; other turns leave the state and break validity."""

    bos: str = "<s>"
    roles: dict[str, RoleStyle] = field(default_factory=lambda: {
        "system": RoleStyle("<<SYS>>\n", "\n<</SYS>>\n"),
        "user": RoleStyle("[INST] ", " [/INST]\n"),
        "assistant": RoleStyle("[ANS] ", " </s>\n", loss=True),
    })
    other: RoleStyle = RoleStyle("[TURN] ", " [/TURN]\n")
    #: Between the name of a role without a style of its own and the text.
    other_as: str = " [AS] "
    #: Control strings beside those of the markers.
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>")
    start: str = "start"
    transitions: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "primed", "user": "asked"},
        "primed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })
    accepting: tuple[str, ...] = ("answered",)
    escape_mark: str = "\\"

    def control_strings(self) -> list[str]:
        marks = [self.bos, self.other_as, *(x for s in (*self.roles.values(), self.other) for x in (s.prefix, s.suffix))]
        found = sorted({m.strip() for m in marks} | set(self.controls), key=lambda c: (-len(c), c))
        if any(len(c) < 2 or c[1] == self.escape_mark or re.search(r"\s", c) for c in found):
            raise ValueError("a control string needs two characters or more, none of them a space, the second not the escape mark")
        for s in (*self.roles.values(), self.other):
            if not (s.prefix[-1:].isspace() and s.suffix[:1].isspace()):
                raise ValueError("a space or line end must stand between markers and text")
        return found

    def pattern(self) -> str:
        """Matches a control string with any number of marks in it: (first character)(marks)(rest)."""
        heads: dict[str, list[str]] = {}
        for c in self.control_strings():
            heads.setdefault(c[0], []).append(c[1:])
        mark = re.escape(self.escape_mark)
        return "|".join(f"{re.escape(h)}{mark}*(?:{'|'.join(map(re.escape, rests))})" for h, rests in sorted(heads.items()))

    def codec(self) -> tuple:
        """(escape, unescape)"""
        found, mark = re.compile(self.pattern()), self.escape_mark

        def escape(text: str) -> str:
            return found.sub(lambda m: m[0][0] + mark + m[0][1:], text)

        def unescape(text: str) -> str:
            return found.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == mark else m[0], text)

        return escape, unescape


SEGMENTS = "conv_id long, seg long, turn_no long, kind string, role string, text string, loss boolean, state string, ok boolean"


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SEGMENTS.split(", ")])


def _formatter(t: ChatTemplate):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escape, _ = t.codec()
        now: object = run  # no conversation yet
        seg = turn_no = size = 0
        state, ok, out = t.start, True, []
        for b in batches:
            for conv, role, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                role, text = role or "", text or ""
                if conv != now:
                    now, seg, turn_no, state, ok = conv, 0, 0, t.start, True
                    out.append((conv, 0, -1, "marker", None, t.bos, False, state, ok))
                    seg = 1
                nxt = t.transitions.get(state, {}).get(role)
                state, ok = nxt or state, ok and nxt is not None
                style = t.roles.get(role, t.other)
                head = style.prefix if role in t.roles else t.other.prefix + escape(role) + t.other_as
                for kind, x, loss in (("marker", head, False), ("text", escape(text), style.loss), ("marker", style.suffix, False)):
                    out.append((conv, seg, turn_no, kind, role, x, loss, state, ok))
                    seg += 1
                turn_no += 1
                size += len(text) + 100
                if size > 4_000_000:
                    yield _emit(out)
                    out, size = [], 0
        if out:
            yield _emit(out)

    return run


def format_chats(turns: DataFrame, template: ChatTemplate | None = None, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Formats every conversation into text segments: conv_id, seg (0, 1, ... in a conversation), turn_no, kind
    ('marker' or 'text'), role, text, loss, state (of the machine after the turn), ok (all turns so far were allowed).

    A conversation is valid if its last segment has ``ok`` and an accepting ``state``; invalid ones are formatted all
    the same. The segments of a conversation come in order within one partition; their texts joined are the formatted
    text.

    Defined results: turns are ordered by (turn, role, text), nulls first, so repeated turns stay, in a fixed order; a
    null role or text counts as empty; an unknown role is named in its marker and breaks validity; rows with a null
    conversation id form one conversation; an empty table gives no segments; other columns are ignored.
    """
    small_batches(turns.sparkSession)
    t = template or ChatTemplate()
    t.control_strings()
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_formatter(t), SEGMENTS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


class _Reader:
    """Reads turns back from a formatted text that comes in pieces."""

    def __init__(self, t: ChatTemplate):
        self.t, self.unescape = t, t.codec()[1]

    def restart(self) -> None:
        self.rest, self.begun = "", False

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        t = self.t
        self.rest += piece
        if not self.begun:
            if not self.rest.startswith(t.bos):
                return
            self.rest, self.begun = self.rest[len(t.bos) :], True
        while True:
            style = next(((r, s) for r, s in (*t.roles.items(), (None, t.other)) if self.rest.startswith(s.prefix)), None)
            if style is None:
                return
            role, s = style
            end = self.rest.find(s.suffix, len(s.prefix))
            if end < 0:
                return
            body, self.rest = self.rest[len(s.prefix) : end], self.rest[end + len(s.suffix) :]
            if role is None:
                role, body = body.split(t.other_as, 1)
                role = self.unescape(role)
            yield role, self.unescape(body)


def _digester(t: ChatTemplate):
    import hashlib

    def run(batches):
        reader, now = _Reader(t), run
        done: list[tuple] = []

        def close():
            if reader.rest:
                raise ValueError(f"conversation {now}: the formatted text can't be read back")
            done.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, ok and state in t.accepting))

        for b in batches:
            for conv, text, in_loss, state_, ok_ in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if conv != now:
                    if now is not run:
                        close()
                    now, n, loss_chars, chars, turns, loss = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                    reader.restart()
                state, ok = state_, ok_
                chars += len(text)
                if in_loss:
                    plain = reader.unescape(text)
                    loss_chars += len(plain)
                    loss.update(plain.encode())
                for role, said in reader.feed(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
        if now is not run:
            close()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        for a in range(0, len(done), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done[a : a + 10_000], strict=True), kinds, strict=True)], [x.split()[0] for x in DIGEST.split(", ")])

    return run


def read_back(segments: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per conversation, read back from the segments of ``format_chats`` in their order:
    the number of turns, SHA-256 over ``role\\ntext\\n`` of each, characters and SHA-256 of the unescaped text under
    the loss mask, characters of the formatted text, and whether the turn order is valid."""
    return segments.select("conv_id", "text", "loss", "state", "ok").mapInArrow(_digester(template or ChatTemplate()), DIGEST)
