"""Chat formatting from typed content parts.

A turn is a list of typed parts: text, image, audio or document. A visitor
flattens them in order: text is escaped and copied, every other part becomes a
placeholder ``<|image:0|>`` whose attachment (reference, kind, number of tokens
it expands to) is recorded. A turn is written as

    <|start|>role<|body|>text and placeholders<|end|>

and a conversation is its turns one after the other. Inside texts and roles a
backslash goes after the first character of every control string (more
backslashes where the text already has some), so no control string of this or
of the usual other templates appears there, and taking one backslash out again
restores the text exactly.

``format_turns`` is a map over rows: one formatted turn per row, with the spans
under the loss mask, so no conversation has to fit in a task. ``read_turns`` is
the reverse, from the formatted text alone. ``conversation_digests`` streams
the turns of one partition in order and keeps only running hashes.

Defined cases: null text = empty; null role = empty; unknown part kinds raise;
repeated rows are turns of their own (ties of turn by role, then formatted
text); null conversation ids form one conversation; null turns come first;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, BODY, END = "<|start|>", "<|body|>", "<|end|>"
# control strings start with < or [ and go on like this
_CONTROL = re.compile(r"([<\[])(\\*)(?=\||/?s>|/?INST\]|/?SYS)")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=\||/?s>|/?INST\]|/?SYS)")
_TURN = re.compile(r"<\|start\|>(.*?)<\|body\|>(.*?)<\|end\|>", re.S)
_PLACE = re.compile(r"<\|(image|audio|document):(\d+)\|>")

PARTS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("ref", T.StringType()), T.StructField("width", T.LongType()),
    T.StructField("height", T.LongType()), T.StructField("seconds", T.DoubleType()),
    T.StructField("pages", T.LongType())]))


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


class PartVisitor:
    """Flattens the parts of one turn; ``visit_<kind>`` handles a kind."""

    def __init__(self, patch: int = 28, audio_tokens: float = 25.0, page_tokens: int = 256):
        self.patch, self.audio_tokens, self.page_tokens = patch, audio_tokens, page_tokens
        self.out: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part) -> None:
        handler = getattr(self, f"visit_{part['kind']}", None)
        if handler is None:
            raise ValueError(f"unknown part kind {part['kind']!r}")
        handler(part)

    def attach(self, kind: str, part, tokens: int) -> None:
        n = len(self.attachments)
        self.out.append(f"<|{kind}:{n}|>")
        self.attachments.append({"position": n, "kind": kind, "ref": part["ref"], "n_tokens": int(tokens)})

    def visit_text(self, part) -> None:
        self.out.append(escape(part["text"] or ""))

    def visit_image(self, part) -> None:
        across, down = (math.ceil((part[side] or 0) / self.patch) for side in ("width", "height"))
        self.attach("image", part, max(1, across * down))

    def visit_audio(self, part) -> None:
        self.attach("audio", part, max(1, math.ceil((part["seconds"] or 0) * self.audio_tokens)))

    def visit_document(self, part) -> None:
        self.attach("document", part, max(1, (part["pages"] or 0) * self.page_tokens))


def format_turn(role: str | None, parts, trained: bool, **visitor) -> tuple[str, list[dict], list[dict]]:
    """Formatted turn, its loss spans (the text, not the placeholders' expansion)
    and its attachments."""
    v = PartVisitor(**visitor)
    for p in parts:
        v.visit(p)
    body, head = "".join(v.out), f"{START}{escape(role or '')}{BODY}"
    spans = [{"start": len(head), "end": len(head) + len(body)}] if trained else []
    return f"{head}{body}{END}", spans, v.attachments


_FORMATTED = T.StructType([
    T.StructField("formatted", T.StringType()),
    T.StructField("loss_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                                          T.StructField("end", T.LongType())]))),
    T.StructField("attachments", T.ArrayType(T.StructType([
        T.StructField("position", T.LongType()), T.StructField("kind", T.StringType()),
        T.StructField("ref", T.StringType()), T.StructField("n_tokens", T.LongType())]))),
    T.StructField("n_expanded", T.LongType())])


def text_parts(text) -> F.Column:
    """A text column as a list of one text part."""
    null = {f.name: F.lit(None).cast(f.dataType) for f in PARTS.elementType.fields}
    return F.array(F.struct(*[(F.lit("text") if n == "kind" else text if n == "text" else c).alias(n)
                              for n, c in null.items()]))


def format_turns(df: DataFrame, conv: str, turn: str, role: str, parts: str,
                 trained_roles: tuple[str, ...] = ("assistant",), **visitor) -> DataFrame:
    """One row per turn: conv, turn, formatted, loss_spans, attachments,
    n_expanded (tokens that its attachments expand to)."""
    conv_type, turn_type = df.schema[conv].dataType, df.schema[turn].dataType
    rows = df.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.col(role).alias("r"), F.col(parts).alias("p"))
    schema = T.StructType([T.StructField("c", conv_type), T.StructField("t", turn_type), *_FORMATTED.fields])

    def run(batches):
        import pyarrow as pa
        types = pa.schema([pa.field("formatted", pa.string()),
                           pa.field("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                           pa.field("attachments", pa.list_(pa.struct([
                               ("position", pa.int64()), ("kind", pa.string()), ("ref", pa.string()),
                               ("n_tokens", pa.int64())]))), pa.field("n_expanded", pa.int64())])
        for b in batches:
            done = []
            for r, p in zip(b.column("r").to_pylist(), b.column("p").to_pylist()):
                text, spans, attached = format_turn(r, p or [], r in trained_roles, **visitor)
                done.append({"formatted": text, "loss_spans": spans, "attachments": attached,
                             "n_expanded": sum(a["n_tokens"] for a in attached)})
            new = pa.Table.from_pylist(done, schema=types).combine_chunks()
            cols = [new.column(n).combine_chunks() for n in types.names]
            cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols]
            yield pa.RecordBatch.from_arrays([b.column("c"), b.column("t"), *cols], names=schema.names)

    return rows.mapInArrow(run, schema).withColumnsRenamed({"c": conv, "t": turn})


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a formatted text; placeholders stay as they are."""
    for m in _TURN.finditer(formatted):
        yield unescape(m[1]), unescape(m[2])


def conversation_digests(turns: DataFrame, conv: str, turn: str) -> DataFrame:
    """Read back the formatted turns of each conversation, in order: n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    conv_type = turns.schema[conv].dataType
    rows = (turns.select(F.col(conv).alias("c"), F.col(turn).alias("t"), "formatted", "loss_spans")
            .repartition("c").sortWithinPartitions(F.col("c").asc_nulls_first(), F.col("t").asc_nulls_first(),
                                                   "formatted"))
    schema = T.StructType([
        T.StructField("c", conv_type), T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def run(batches):
        now, state = None, None

        def row():
            return (now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for pdf in batches:
            done = []
            for c, text, spans in zip(pdf["c"], pdf["formatted"], pdf["loss_spans"]):
                key = None if pd.isna(c) else c
                if now is None or now[0] != key:
                    if now is not None:
                        done.append(row())
                    now, state = (key,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for r, body in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{r}\n{body}\n".encode())
                for s in spans:
                    masked = unescape(text[s["start"]:s["end"]])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(text)
            yield pd.DataFrame(done, columns=schema.names)
        if now is not None:
            yield pd.DataFrame([row()], columns=schema.names)

    return rows.mapInPandas(run, schema).withColumnRenamed("c", conv)
