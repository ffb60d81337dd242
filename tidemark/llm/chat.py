"""Chat formatting: a finite-state machine over roles, a declarative template, and segments with loss flags."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ready


@dataclass(frozen=True)
class Template:
    """How turns are marked, which texts are learned, and in which order roles may follow.

    ``marks``: opening and closing mark of each known role. Any other role is written between ``other`` marks, its name before
    the text. ``learned``: roles whose text is under the loss mask. ``follows``: the roles allowed after a role (None: at the start).
    """

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"),
    })
    other: tuple[str, str, str] = ("<|role|>", "<|text|>", "<|end|>")
    learned: frozenset[str] = frozenset({"assistant"})
    follows: dict[str | None, frozenset[str]] = field(default_factory=lambda: {
        None: frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"}),
    })
    last: frozenset[str] = frozenset({"assistant"})

    def controls(self) -> list[str]:
        return sorted({m for pair in self.marks.values() for m in pair} | set(self.other), key=lambda m: (-len(m), m))


DEFAULT = Template()


class Escaper:
    """Texts without control strings, reversibly: a backslash goes behind the first character of each, before any that are there."""

    def __init__(self, template: Template):
        controls = template.controls()
        if any(len(c) < 2 or "\\" in c for c in controls):
            raise ValueError("marks need two characters at least and no backslash")
        forms = "|".join(f"(?<={regex.escape(c[0])}\\\\*)(?={regex.escape(c[1:])})" for c in controls)
        self.into = regex.compile(f"(?:{forms})")
        self.back = regex.compile("|".join(f"(?<={regex.escape(c[0])}\\\\*)\\\\(?={regex.escape(c[1:])})" for c in controls))
        self.may = regex.compile("|".join(regex.escape(c[1:]) for c in controls))

    def escape(self, text: str) -> str:
        return self.into.sub("\\\\", text) if self.may.search(text) else text

    def unescape(self, text: str) -> str:
        return self.back.sub("", text) if self.may.search(text) else text


def segments(role: str | None, text: str | None, template: Template, escaper: Escaper) -> list[tuple[str, bool]]:
    """Marks and escaped text of one turn with their loss flags; a null role or text counts as empty."""
    role, body = role or "", escaper.escape(text or "")
    if role in template.marks:
        before, after = template.marks[role]
    else:
        before, after = template.other[0] + escaper.escape(role) + template.other[1], template.other[2]
    return [(before, False), (body, role in template.learned), (after, False)]


SEGMENTS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("loss", T.BooleanType())]))


def format_turns(
    df: DataFrame, template: Template = DEFAULT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Every turn as ``conv_id, turn, role, segments``; the output of a conversation is its segments, joined in turn order.

    Turns are formatted where they are read, before any shuffle. Null roles and texts count as empty; other columns are ignored.
    """
    ready(df.sparkSession)
    source = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    schema = T.StructType([*source.schema.fields[:3], T.StructField("segments", SEGMENTS)])
    kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escaper = Escaper(template)
        for batch in batches:
            rows = [
                [{"text": t, "loss": loss} for t, loss in segments(role, text, template, escaper)]
                for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, kind)], names=["conv_id", "turn", "role", "segments"])

    return source.mapInArrow(run, schema)


class Reader:
    """Reads a conversation back from its formatted output, piece by piece, and keeps digests instead of texts."""

    def __init__(self, template: Template, escaper: Escaper):
        self.template, self.escaper = template, escaper
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.state: str | None = None
        self.valid = True

    def turn(self, pieces: list[dict]) -> None:
        """One turn: its joined output is parsed by the marks; the loss mask is taken from the flags of its characters."""
        output = "".join(p["text"] for p in pieces)
        role, body = self.parse(output)
        self.turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
        learned = self.escaper.unescape("".join(p["text"] for p in pieces if p["loss"]))
        self.loss.update(learned.encode("utf-8", "surrogatepass"))
        self.n_turns, self.loss_chars, self.chars = self.n_turns + 1, self.loss_chars + len(learned), self.chars + len(output)
        self.valid &= role in self.template.follows.get(self.state, ())
        self.state = role

    def parse(self, output: str) -> tuple[str, str]:
        for role, (before, after) in self.template.marks.items():
            if output.startswith(before):
                end = output.index(after, len(before))
                return role, self.escaper.unescape(output[len(before) : end])
        start, middle, after = self.template.other
        split = output.index(middle, len(start))
        end = output.index(after, split + len(middle))
        return self.escaper.unescape(output[len(start) : split]), self.escaper.unescape(output[split + len(middle) : end])

    def row(self, conv) -> tuple:
        valid = self.valid and self.state in self.template.last
        return conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, valid


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Per conversation: counts and digests of what its formatted output says, and whether the machine accepts its roles.

    Conversations stream through partitions sorted by conversation and turn, one turn at a time, so that one of any length needs
    little memory. Turns with equal numbers go by role and text; a null conversation is one of its own, null turns come first.
    An invalid order is reported (``valid`` false), never dropped.
    """
    ready(formatted.sparkSession)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "segments"]
    dealt = formatted.select("conv_id", "turn", "role", "segments").repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "segments")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escaper = Escaper(template)
        names = [p.strip().split()[0] for p in READ_BACK.split(",")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        now, reader = None, None
        for batch in batches:
            done = []
            for conv, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if reader is None or conv != now:
                    if reader is not None:
                        done.append(reader.row(now))
                    now, reader = conv, Reader(template, escaper)
                reader.turn(pieces)
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=names)
        if reader is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(reader.row(now), kinds, strict=True)], names=names)

    return dealt.mapInArrow(run, READ_BACK)
