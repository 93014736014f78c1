"""Chat formatting: typed content parts, flattened by a visitor into one text with placeholders, and read back.

A turn is `<|im_start|>role`, a line break, its content, `<|im_end|>` and a line break. Text parts are escaped, image,
audio and document parts become placeholders in their order, and their references and expanded token counts are
recorded. Escaping puts one backslash behind the first character of every control string in a text, and one more where
backslashes already stand there; taking one away restores the text, whatever it was. So neither this template's marks
nor those of other common templates occur in a formatted text but as marks.

Defined results: null texts and roles are empty; a role's backslashes and line breaks are escaped too; turns with the
same number follow by role and text; repeated rows are turns of their own; an empty table gives no conversations; rows
without a conv_id are one conversation; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates, without their first character; fixed values.
_REST = r"\|[A-Za-z_]{1,40}(?::[0-9]{1,9})?\|>|/?s>|/?INST\]|/?SYS>>|start_of_turn>|end_of_turn>|pad>|unk>|bos>|eos>"
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_REST})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_REST})")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_PLACEHOLDER = re.compile(r"<\|(image|audio|document):([0-9]{1,9})\|>")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text) if "<" in text or "[" in text else text


@dataclass(frozen=True)
class Part:
    """A piece of a turn's content: kind text, image, audio or document."""

    kind: str
    text: str = ""
    reference: str = ""
    #: Image: tiles; audio: seconds; document: pages.
    units: int = 1


#: Tokens that a placeholder stands for, for each unit of its part.
TOKENS = {"image": 256, "audio": 25, "document": 600}
_PARTS = "array<struct<kind: string, text: string, reference: string, units: long>>"


@dataclass
class Flattened:
    """What the visitor gathers: pieces of text, attachments in order, expanded tokens, and spans that carry loss.

    Text waits until an attachment or the turn's end comes, so that adjoining text parts are escaped as the one text that
    they make: no control string can form over a seam."""

    pieces: list[str] = field(default_factory=list)
    waiting: list[str] = field(default_factory=list)
    attachments: list[tuple[str, str, int]] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    length: int = 0

    def add(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def visit(self, part: Part) -> None:
        getattr(self, f"visit_{part.kind}")(part)

    def visit_text(self, part: Part) -> None:
        self.waiting.append(part.text)

    def flush(self) -> None:
        self.add(escape("".join(self.waiting)))
        self.waiting.clear()

    def _attach(self, part: Part) -> None:
        self.flush()
        self.add(f"<|{part.kind}:{len(self.attachments)}|>")
        self.attachments.append((part.kind, part.reference, TOKENS[part.kind] * part.units))

    visit_image = visit_audio = visit_document = _attach

    @property
    def text(self) -> str:
        return "".join(self.pieces)


def format_turns(turns: list[tuple[str, list[Part]]], learn: str = "assistant") -> Flattened:
    """The turns of one conversation; the contents of `learn` turns carry loss."""
    out = Flattened()
    for role, parts in turns:
        out.add(START + escape(role).replace("\\", "\\\\").replace("\n", "\\n") + "\n")
        begin = out.length
        for part in parts:
            out.visit(part)
        out.flush()
        if role == learn and out.length > begin:
            out.spans.append((begin, out.length))
        out.add(END + "\n")
    return out


def read_turns(text: str, attachments: list[tuple[str, str, int]] = ()) -> list[tuple[str, list[Part]]]:
    """The turns of a formatted text; adjoining text parts come back as one, a turn without parts as an empty text."""
    out = []
    for role, content in _TURN.findall(text):
        role = unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))
        parts, at = [], 0
        for m in _PLACEHOLDER.finditer(content):
            if m.start() > at:
                parts.append(Part("text", unescape(content[at : m.start()])))
            kind, reference, tokens = attachments[int(m[2])]
            parts.append(Part(kind, reference=reference, units=tokens // TOKENS[kind]))
            at = m.end()
        if at < len(content) or not parts:
            parts.append(Part("text", unescape(content[at:])))
        out.append((role, parts))
    return out


def format_chats(rows: DataFrame, learn: str = "assistant", parts: str | None = None) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, formatted, spans, n_attachments, attachment_tokens, attachments (kind,
    reference, tokens, in order).

    `parts` names a column of typed parts, array<struct<kind, text, reference, units>>, that is read instead of the text;
    null parts and units count as none and 1. Turns are dealt by conversation and sorted; a task holds one conversation at a time, which is one output row.
    """
    content = F.coalesce(F.col("text").cast("string"), F.lit("")) if parts is None else F.coalesce(F.col(parts).cast(_PARTS), F.array().cast(_PARTS))
    typed = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), content.alias("content"))
    ordered = typed.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "content")

    def as_parts(content: str | list[dict]) -> list[Part]:
        if isinstance(content, str):
            return [Part("text", content)]
        return [Part(p["kind"] or "text", p["text"] or "", p["reference"] or "", 1 if p["units"] is None else p["units"]) for p in content if p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(conv: int | None, turns: list[tuple[str, list[Part]]]) -> tuple:
            flat = format_turns(turns, learn)
            return conv, flat.text, [{"begin": b, "end": e} for b, e in flat.spans], len(flat.attachments), sum(a[2] for a in flat.attachments), [dict(zip(("kind", "reference", "tokens"), a, strict=True)) for a in flat.attachments]

        def out(done: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.int64(), pa.int64(), pa.list_(pa.struct([("kind", pa.string()), ("reference", pa.string()), ("tokens", pa.int64())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=["conv_id", "formatted", "spans", "n_attachments", "attachment_tokens", "attachments"])

        turns: list[tuple[str, list[Part]]] = []
        key, some, done = None, False, []
        for batch in batches:
            for conv, role, content in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "content")), strict=True):
                if some and conv != key:
                    done.append(made(key, turns))
                    turns = []
                    if len(done) >= 500:
                        yield out(done)
                        done = []
                key, some = conv, True
                turns.append((role, as_parts(content)))
        if some:
            done.append(made(key, turns))
        if done:
            yield out(done)

    return ordered.mapInArrow(run, "conv_id long, formatted string, spans array<struct<begin: long, end: long>>, n_attachments long, attachment_tokens long, attachments array<struct<kind: string, reference: string, tokens: long>>")


def digest_chats(formatted: DataFrame) -> DataFrame:
    """Read every formatted conversation back and digest what it says and what lies under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "spans")), strict=True):
                turns = read_turns(text)
                told = hashlib.sha256("".join(f"{role}\n{''.join(p.text for p in parts)}\n" for role, parts in turns).encode()).hexdigest()
                loss = "".join(unescape(text[s["begin"] : s["end"]]) for s in spans)
                rows.append((conv, len(turns), told, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
