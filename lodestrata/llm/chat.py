"""Chat formatting by a finite-state machine over roles.

A declarative template gives for each role what stands before and after a turn's
text and whether the text carries loss, and the machine's transitions: which
role may follow which. Turns stream through it in order; out come text segments
with a loss flag each, so that a conversation of any length needs no more memory
than one turn. Control strings inside texts are broken up by an escape that
reading back undoes, so no text can forge a turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import only

ESCAPE, BREAK = "\\", "\\:"


@dataclass(frozen=True)
class Template:
    """role -> (before, after, loss). The role "*" stands for any other; its before holds {role}."""

    turns: dict[str, tuple[str, str, bool]]
    control: tuple[str, ...]
    follow: dict[str, tuple[str, ...]]
    final: tuple[str, ...]
    pattern: re.Pattern = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "pattern", re.compile("|".join([*(re.escape(c) for c in sorted(self.control, key=len, reverse=True)), re.escape(ESCAPE)])))

    def escape(self, text: str) -> str:
        return self.pattern.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else m[0][0] + BREAK + m[0][1:], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\([\\:])", lambda m: ESCAPE if m[1] == ESCAPE else "", text)

    def next_state(self, state: str, role: str) -> str:
        """The machine's step; the state "bad" is never left."""
        return role if role in self.follow.get(state, ()) else "bad"


#: The marks of the instruction format.
INSTRUCTION = Template(
    turns={"system": ("<<SYS>>", "<</SYS>>", False), "user": ("<s>[INST] ", " [/INST]", False), "assistant": ("<s>[ANS] ", " </s>", True), "*": ("<<ROLE>>{role}<</ROLE>>", "<</TURN>>", False)},
    control=("<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "<</TURN>>"),
    follow={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    final=("assistant",),
)


def segments_of(role: str, text: str, template: Template) -> Iterator[tuple[str, bool]]:
    """The turn's segments (text, loss)."""
    own = role in template.turns and role != "*"
    before, after, loss = template.turns[role if own else "*"]
    yield (before if own else before.replace("{role}", template.escape(role))), False
    yield template.escape(text), loss
    yield after, False


class Reader:
    """Reads turns back from formatted text, one complete turn at a time."""

    def __init__(self, template: Template):
        other = template.turns["*"][0].split("{role}")
        heads = [(before, role, after) for role, (before, after, _) in template.turns.items() if role != "*"]
        self.head = re.compile("|".join([*(f"(?P<r{k}>{re.escape(h[0])})" for k, h in enumerate(heads)), f"{re.escape(other[0])}(?P<other>.*?){re.escape(other[1])}"]), re.S)
        self.heads, self.other_end, self.template = heads, template.turns["*"][1], template

    def turns(self, formatted: str) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(formatted):
            m = self.head.match(formatted, at)
            if m is None:
                raise ValueError("no turn begins here")
            if m["other"] is not None:
                role, end = self.template.unescape(m["other"]), self.other_end
            else:
                k = next(k for k in range(len(self.heads)) if m[f"r{k}"] is not None)
                role, end = self.heads[k][1], self.heads[k][2]
            stop = formatted.index(end, m.end())
            yield role, self.template.unescape(formatted[m.end() : stop])
            at = stop + len(end)


def format_conversations(turns: DataFrame, template: Template = INSTRUCTION) -> DataFrame:
    """One row per segment: conv_id, seq, text, loss, state (the machine's after this turn), of each conversation in order.

    Turns stand in the order of turn, then role, then text, null first; repeated
    rows are turns of their own. A null text is empty, a null role the empty
    role. Turns of a null conv_id form one conversation. Roles out of order are
    formatted all the same; their state is `bad` from there on. Other columns are
    not read, whatever their names; an empty table gives an empty one.

    A conversation's turns pass one task in order, as the machine's state and the
    digests read back run through them; it holds one turn at a time, so a very long
    conversation costs time there and no memory.
    """
    src = only(turns, conv_id="conv_id", turn="turn", role="role", text="text")
    src = src.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    src = src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, state, seq = object(), "start", 0
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for conv, role, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if conv != of:
                    of, state, seq = conv, "start", 0
                state = template.next_state(state, role)
                for piece, loss in segments_of(role, text, template):
                    for c, v in zip(out, (conv, seq, piece, loss, state), strict=True):
                        c.append(v)
                    seq += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()), strict=True)], names=["conv_id", "seq", "text", "loss", "state"])

    return src.mapInArrow(run, "conv_id long, seq long, text string, loss boolean, state string")


def read_back(segments: DataFrame, template: Template = INSTRUCTION) -> DataFrame:
    """One row per conversation of format_conversations' output, digests taken from what the formatted text says.

    segments must still stand in that output's order and partitions. A turn is
    parsed as soon as its closing mark has come, so memory holds one turn.
    valid is true if the machine accepts the conversation.
    """
    reader = Reader(template)
    ends = {after for _, after, _ in template.turns.values()}
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: object = None
        n = loss_chars = chars = 0
        sha = loss_sha = None
        pending, state = "", "start"

        def row() -> list:
            if pending:
                raise ValueError("a turn does not end")
            return [of, n, sha.hexdigest(), loss_chars, loss_sha.hexdigest(), chars, state in template.final]

        rows: list[list] = []
        for b in batches:
            for conv, seq, text, loss, now in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if seq == 0:
                    if sha is not None:
                        rows.append(row())
                    of, n, loss_chars, chars, pending = conv, 0, 0, 0, ""
                    sha, loss_sha = hashlib.sha256(), hashlib.sha256()
                state = now
                chars += len(text)
                pending += text
                if loss:
                    plain = template.unescape(text)
                    loss_chars += len(plain)
                    loss_sha.update(plain.encode("utf-8", "surrogatepass"))
                elif text in ends and seq % 3 == 2:
                    for role, said in reader.turns(pending):
                        n += 1
                        sha.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    pending = ""
            if len(rows) > 2000:
                yield _rows(rows)
                rows = []
        if sha is not None:
            rows.append(row())
        yield _rows(rows)

    def _rows(rows: list[list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        names = [f.split()[0] for f in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return segments.mapInArrow(run, schema)
