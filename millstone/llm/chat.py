"""Chat formatting: typed content parts flattened by a visitor into one marked-up text.

A turn becomes ``<|turn|>role`` LF content ``<|end|>`` LF. Its content is a list of typed
parts (text, image, audio, document; a document may hold parts of its own). The visitor
walks them in order: text is copied, every other part leaves a placeholder and a record of
its attachment, with the number of tokens that the placeholder expands to.

Control strings all begin ``<|``. In copied text, a ``<`` followed by backslashes and a
``|`` gets one backslash more, so no text can end a turn or fake one, and taking one
backslash away restores it. Roles escape backslash and LF as well.

The loss mask of a turn is the list of its text spans where the role is ``assistant``.
Formatting is row by row; only the offsets within a conversation need its turns in order,
and that pass streams over sorted rows: a conversation of any length is never held.

Order: by turn (nulls first), then by the formatted text; repeated rows follow each other.
A null text is empty, a null role is the empty role, a null conv_id is a conversation. An empty
table gives no rows; columns that are not named are not read, whatever their names. A long text is
one row, of which its task holds some six copies while it is escaped and read back.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


OPEN, END = "<|turn|>", "<|end|>\n"
_ESCAPED, _RAW = re.compile(r"<\\(\\*)\|"), re.compile(r"<(\\*)\|")
_PLACEHOLDER = re.compile(r"<\|(image|audio|document)\|>")

TURN = "conv_id {id}, turn long, formatted string, loss array<struct<start:long,end:long>>, attachments array<struct<at:long,kind:string,ref:string,tokens:long>>, tokens long"


def escaped(text: str) -> str:
    return _RAW.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


@dataclass(frozen=True)
class Expansion:
    """Tokens that a placeholder stands for."""

    tile: int = 336
    per_tile: int = 144
    per_second: float = 25.0
    per_page: int = 256

    def image(self, width: float | None, height: float | None) -> int:
        return self.per_tile * math.ceil((width or 1) / self.tile) * math.ceil((height or 1) / self.tile)

    def audio(self, seconds: float | None) -> int:
        return math.ceil((seconds or 0) * self.per_second)

    def document(self, pages: int | None) -> int:
        return self.per_page * int(pages or 1)


@dataclass
class Flattener:
    """Visitor of the parts of one turn. ``out`` is the content so far, ``at`` its length in code points."""

    expansion: Expansion
    at: int = 0
    out: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict[str, Any]] = field(default_factory=list)

    def visit(self, part: dict[str, Any]) -> None:
        """A part of a kind that no method knows is an error: nothing is dropped in silence."""
        kind = part.get("kind") or "text"
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"unknown content part {kind!r}")
        method(part)

    def visit_text(self, part: dict[str, Any]) -> None:
        text = escaped(part.get("text") or "")
        if text:
            self.spans.append((self.at, self.at + len(text)))
            self._put(text)

    def visit_image(self, part: dict[str, Any]) -> None:
        self._attach("image", part, self.expansion.image(part.get("width"), part.get("height")))

    def visit_audio(self, part: dict[str, Any]) -> None:
        self._attach("audio", part, self.expansion.audio(part.get("seconds")))

    def visit_document(self, part: dict[str, Any]) -> None:
        self._attach("document", part, self.expansion.document(part.get("pages")))
        for inner in part.get("parts") or ():
            self.visit(inner)

    def _attach(self, kind: str, part: dict[str, Any], tokens: int) -> None:
        self.attachments.append({"at": self.at, "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        self._put(f"<|{kind}|>")

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)


def _merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for a, b in spans:
        if out and out[-1]["end"] == a:
            out[-1]["end"] = b
        else:
            out.append({"start": a, "end": b})
    return out


def formatted_turn(
    role: str | None, parts: list[dict[str, Any]], expansion: Expansion, loss_role: str
) -> dict[str, Any]:
    """The segment of a turn, its loss spans (from the segment's start) and its attachments."""
    name = escaped((role or "").replace("\\", "\\\\").replace("\n", "\\n"))
    head = f"{OPEN}{name}\n"
    visitor = Flattener(expansion, at=len(head))
    # Neighbouring texts are one text, so that no control string forms across their seam.
    whole: list[dict[str, Any]] = []
    for part in parts:
        if whole and (part.get("kind") or "text") == "text" == (whole[-1].get("kind") or "text"):
            whole[-1] = {"kind": "text", "text": (whole[-1].get("text") or "") + (part.get("text") or "")}
        else:
            whole.append(part)
    for part in whole:
        visitor.visit(part)
    body = "".join(visitor.out)
    return {
        "formatted": f"{head}{body}{END}",
        "loss": _merged(visitor.spans) if role == loss_role else [],
        "attachments": visitor.attachments,
        "tokens": sum(a["tokens"] for a in visitor.attachments),
    }


def format_turns(
    turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "text", expansion: Expansion = Expansion(), loss_role: str = "assistant"
) -> DataFrame:
    """One row per turn: conv_id, turn, formatted, loss, attachments, tokens; spans count from the segment's start.

    The content column is a text, or an array of structs with ``kind`` and what that kind needs
    (text; ref, width, height; ref, seconds; ref, pages), or, where the column's name ends in
    ``_json``, such a list as JSON, in which documents may hold ``parts``.
    """
    content = turns.schema[content_col].dataType
    as_json = content_col.endswith("_json")
    given = turns.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).alias("role"),
        F.col(content_col).alias("content"),
    )
    plain = isinstance(content, T.StringType) and not as_json
    schema = TURN.format(id=given.schema["conv_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turn, role, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = [{"kind": "text", "text": content}] if plain else json.loads(content or "[]") if as_json else [
                    p for p in content or [] if p
                ]
                rows.append({"conv_id": conv, "turn": turn} | formatted_turn(role, parts, expansion, loss_role))
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow(batch.schema.field(0).type))

    return given.mapInArrow(run, schema)


def _arrow(id_type: pa.DataType, *more: pa.Field) -> pa.Schema:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    attached = pa.struct([("at", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
    return pa.schema(
        [
            ("conv_id", id_type),
            ("turn", pa.int64()),
            ("formatted", pa.string()),
            ("loss", pa.list_(span)),
            ("attachments", pa.list_(attached)),
            ("tokens", pa.int64()),
            *more,
        ]
    )


def assembled(turns: DataFrame) -> DataFrame:
    """``format_turns``' rows in order within their conversation, each with ``start``, its offset in the conversation's
    text.

    One shuffle by conversation; the rows of each partition are sorted and streamed.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in turns.schema) + ", start long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, at, any_yet = None, 0, False
        for batch in batches:
            starts = []
            for c, text in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), strict=True):
                if not any_yet or c != conv:
                    conv, at, any_yet = c, 0, True
                starts.append(at)
                at += len(text)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(starts, pa.int64())], [*batch.schema.names, "start"]
            )

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").mapInArrow(run, schema)


def parsed(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn, read from the text alone; placeholders are left out."""
    if not segment.startswith(OPEN) or not segment.endswith(END):
        raise ValueError("not a formatted turn")
    role, _, body = segment[len(OPEN) : -len(END)].partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))
    return role, unescaped(_PLACEHOLDER.sub("", body))


def read_back(rows: DataFrame) -> DataFrame:
    """Per conversation, from the formatted texts: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, attached.

    ``rows`` come from ``assembled`` (their order within partitions is used).
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attached long"
    given = rows.select("conv_id", "formatted", "loss", "start", F.size("attachments").alias("attached"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "attached"]
        open_: list[Any] | None = None
        id_type = None

        def closed(x: list[Any]) -> list[Any]:
            conv, n, turns, chars, loss, total, attached = x
            return [conv, n, turns.hexdigest(), chars, loss.hexdigest(), total, attached]

        for batch in batches:
            id_type = batch.schema.field(0).type
            done = []
            for conv, text, loss, start, attached in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if start == 0 or open_ is None:
                    if open_ is not None:
                        done.append(closed(open_))
                    open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, plain = parsed(text)
                open_[1] += 1
                open_[2].update(f"{role}\n{plain}\n".encode())
                for span in loss:
                    under = unescaped(text[span["start"] : span["end"]])
                    open_[3] += len(under)
                    open_[4].update(under.encode())
                open_[5] += len(text)
                open_[6] += attached
            if done:
                yield _batch(done, names, id_type)
        if open_ is not None:
            yield _batch([closed(open_)], names, id_type)

    return given.mapInArrow(run, schema)


def _batch(rows: list[list[Any]], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names
    )
