"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor flattens them, in order, into one
text in which every attachment is a numbered placeholder, and records the attachment's reference and how many
tokens its placeholder expands to. The template marks turns; control strings inside texts are escaped so that
no text can end a turn or forge a placeholder, and the escape is reversible.

A turn is formatted on its own row, whatever its conversation's length. A conversation's output is its turns'
segments in order. Reading it back needs a conversation's rows in order, not all of them at once.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Control strings of common chat templates. This template's own begin with <| and end with |>.
CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: The word joiner, put after the first character of a control string; one that stands in a text is doubled.
MARK = "⁠"

_STARTS = re.compile("(?=(?:" + "|".join(map(re.escape, CONTROL)) + "))(.)", re.S)
_MARKS = re.compile(MARK + "+")
_SEGMENT = re.compile(re.escape(TURN) + r"(.*?)" + re.escape(TEXT) + r"(.*?)" + re.escape(END), re.S)
_PLACEHOLDER = re.compile(r"<\|(image|audio|document|part):(\d+)\|>")

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: str) -> str:
    """Text without any control string; ``unescape`` gives the text back."""
    if MARK in text:
        text = text.replace(MARK, MARK * 2)
    return _STARTS.sub(r"\1" + MARK, text)


def unescape(text: str) -> str:
    # doubled marks stand in even runs; a lone one was put into a control string
    return _MARKS.sub(lambda m: MARK * (len(m[0]) // 2), text) if MARK in text else text


@dataclass(frozen=True)
class TokenCosts:
    """Tokens that an attachment expands to."""

    patch: int = 28
    max_patches: int = 1024
    audio_per_second: float = 25.0
    per_page: int = 512


@dataclass
class Flattener:
    """Visits parts in order. ``text`` is what they flatten to, ``attachments`` are (number, type, ref, tokens)."""

    costs: TokenCosts = field(default_factory=TokenCosts)
    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = (part.get("type") or "text").lower()
        getattr(self, f"visit_{kind}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (max(1, math.ceil((part.get(k) or 0) / self.costs.patch)) for k in ("width", "height"))
        self.attach("image", part, min(across * down, self.costs.max_patches))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil(max(0.0, part.get("seconds") or 0.0) * self.costs.audio_per_second))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, max(1, part.get("pages") or 0) * self.costs.per_page)

    def visit_other(self, part: dict) -> None:
        self.attach("part", part, 0)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        number = len(self.attachments) + 1
        self.attachments.append({"number": number, "type": kind, "ref": part.get("ref"), "tokens": tokens})
        self.pieces.append(f"<|{kind}:{number}|>")

    @property
    def text(self) -> str:
        return "".join(self.pieces)


def format_turn(role: str | None, parts: list[dict] | None, costs: TokenCosts = TokenCosts()) -> dict:
    """The segment of a turn, where its loss mask lies in it (an assistant's content; else nothing), and its attachments."""
    flat = Flattener(costs)
    for part in parts or []:
        flat.visit(part or {})
    head = TURN + escape(role or "") + TEXT
    masked = role == "assistant"
    start = len(head)
    return {"segment": head + flat.text + END, "loss_start": start, "loss_end": start + len(flat.text) * masked, "attachments": flat.attachments}


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation, or of a part of it; placeholders are left out of texts."""
    return [(unescape(m[1]), read_text(m[2])) for m in _SEGMENT.finditer(formatted)]


def read_text(content: str) -> str:
    return unescape(_PLACEHOLDER.sub("", content))


def text_part(text: Column) -> Column:
    """A turn's content of one text part; a null text is empty."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
    return F.array(part)


SEGMENTS = "conv_id long, turn long, role string, segment string, loss_start long, loss_end long, attachments array<struct<number:int,type:string,ref:string,tokens:long>>"


def format_conversations(turns: DataFrame, parts: Column | None = None, costs: TokenCosts = TokenCosts()) -> DataFrame:
    """One row for each row of ``turns(conv_id, turn, role, text)``: its segment, loss mask and attachments.

    ``parts`` is the content (an array of ``PART``); without it the column text is one text part. Defined
    cases: null texts and roles are empty; null conv_ids are one conversation; parts of an unknown type
    become placeholders without tokens; repeated rows are repeated turns; other columns aren't looked at; an
    empty table gives an empty result.
    """
    content = text_part(F.col("text")) if parts is None else parts
    narrow = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), content.alias("parts"))
    out = to_arrow_schema(StructType.fromDDL(SEGMENTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"conv_id": r["conv_id"], "turn": r["turn"], "role": r["role"]} | format_turn(r["role"], r["parts"], costs) for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    return narrow.mapInArrow(run, SEGMENTS)


def in_order(segments: DataFrame) -> DataFrame:
    """A conversation's rows in one partition and in order: by turn, then role and segment where turns tie."""
    return segments.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "segment")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long"


def read_back(segments: DataFrame) -> DataFrame:
    """One row for each conversation, computed from its output alone; only running hashes are held."""
    out = to_arrow_schema(StructType.fromDDL(DIGEST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: list = []  # of the conversation being read: id, and what is summed
        for b in batches:
            done = []
            for r in b.to_pylist():
                if not at or at[0] != r["conv_id"]:
                    done += at[1:]
                    at = [r["conv_id"], _Reading(r["conv_id"])]
                at[1].add(r)
            if done:
                yield pa.RecordBatch.from_pylist([x.row() for x in done], schema=out)
        if at:
            yield pa.RecordBatch.from_pylist([at[1].row()], schema=out)

    return in_order(segments).select("conv_id", "turn", "role", "segment", "loss_start", "loss_end", "attachments").mapInArrow(run, DIGEST)


class _Reading:
    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.chars, self.loss_chars, self.attached, self.tokens = conv_id, 0, 0, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, r: dict) -> None:
        for role, text in parse(r["segment"]):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.chars += len(r["segment"])
        masked = read_text(r["segment"][r["loss_start"] : r["loss_end"]])
        self.loss_chars += len(masked)
        self.loss.update(masked.encode("utf-8", "surrogatepass"))
        self.attached += len(r["attachments"])
        self.tokens += sum(a["tokens"] for a in r["attachments"])

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.turns, "turns_sha256": self.all.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars, "n_attachments": self.attached, "attachment_tokens": self.tokens}


def assemble(segments: DataFrame) -> DataFrame:
    """Whole conversations: ``conv_id, formatted, loss_spans, attachments``, for output that needs one text each.

    Loss spans are in code points of formatted. Segments themselves are the output for conversations too long for one row.
    """
    by = F.array_sort(F.collect_list(F.struct("turn", "role", "segment", "loss_start", "loss_end", "attachments")))
    conv = segments.groupBy("conv_id").agg(by.alias("t"))
    before = lambda i: F.aggregate(F.slice("t", F.lit(1), i), F.lit(0), lambda a, x: a + F.char_length(x.segment))
    spans = F.transform("t", lambda x, i: F.struct((before(i) + x.loss_start).alias("start"), (before(i) + x.loss_end).alias("end")))
    return conv.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x.segment), "").alias("formatted"),
        F.filter(spans, lambda s: s.end > s.start).alias("loss_spans"),
        F.flatten(F.transform("t", lambda x: x.attachments)).alias("attachments"),
    )
