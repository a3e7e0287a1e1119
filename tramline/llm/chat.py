"""Chat formatting with typed content parts.

A turn is a list of typed parts: text, image, audio, document. A visitor flattens them in order: text is
escaped, an attachment becomes a numbered placeholder, and its reference and expanded token count are
recorded. The template of a turn is

    <|turn|>ROLE\\nBODY<|end|>\\n

Every control string starts with "<|". Inside a role or text, a backslash is doubled and "<|" becomes
"<\\|", so no text can hold a control string; a newline in a role becomes "\\n". `unescape` is the exact
inverse. The loss mask of a turn is the body of an assistant turn.

The output has one row a turn (the conversation is its rows in order), so formatting shuffles nothing
and no conversation, however long, is gathered in one row. Order: turn (null first), then role, text.
Null text or role: empty. A null conversation id is a conversation of its own. Repeated rows are turns of
their own; other columns are ignored; an empty table gives no conversation.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
PATCH, FRAMES_A_SECOND, TOKENS_A_PAGE = 28, 25, 512
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
FORMATTED = "conv_id long, turn long, role string, formatted string, loss_start int, loss_end int, attachments array<struct<type:string,ref:string,start:int,n_tokens:long>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


@dataclass
class Flatten:
    """Visits the parts of one turn; at: code points written before the body."""

    at: int = 0
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part)

    def write(self, s: str) -> None:
        self.out.append(s)
        self.at += len(s)

    def attach(self, part: dict, n_tokens: int) -> None:
        self.attachments.append({"type": part["type"], "ref": part.get("ref"), "start": self.at, "n_tokens": n_tokens})
        self.write(f"<|{part['type']}:{len(self.attachments)}|>")

    def visit_text(self, part: dict) -> None:
        self.write(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self.attach(part, -(-(part.get("width") or 0) // PATCH) * -(-(part.get("height") or 0) // PATCH))

    def visit_audio(self, part: dict) -> None:
        self.attach(part, round((part.get("seconds") or 0) * FRAMES_A_SECOND))

    def visit_document(self, part: dict) -> None:
        self.attach(part, (part.get("pages") or 0) * TOKENS_A_PAGE)

    def visit_other(self, part: dict) -> None:
        """A type the template doesn't know keeps its place as an attachment of no tokens."""
        self.attach(part | {"type": "unknown"}, 0)


def text_parts(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as turns of one text part."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.array(part).alias("parts"))


def format_turns(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, parts) to FORMATTED rows."""

    def run(batches):
        for batch in batches:
            text, start, stop, attached = [], [], [], []
            for role, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                head = f"{TURN}{escape_role(role or '')}\n"
                visitor = Flatten(len(head))
                for part in parts or []:
                    visitor.visit(part or {})
                text.append(f"{head}{''.join(visitor.out)}{END}\n")
                learn = role == "assistant"
                start.append(len(head) if learn else None)
                stop.append(visitor.at if learn else None)
                attached.append(visitor.attachments)
            kind = pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("start", pa.int32()), ("n_tokens", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(text, pa.string()), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(attached, kind)], ["conv_id", "turn", "role", "formatted", "loss_start", "loss_end", "attachments"])

    return turns.select("conv_id", "turn", "role", "parts").mapInArrow(run, FORMATTED)


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn of text parts."""
    if not formatted.startswith(TURN) or not formatted.endswith(f"{END}\n"):
        raise ValueError("not a formatted turn")
    role, _, body = formatted[len(TURN) : -len(END) - 1].partition("\n")
    return unescape_role(role), unescape(body)


def digests(formatted: DataFrame) -> DataFrame:
    """Reads conversations back, turn by turn in order: what a task holds is one digest, not a conversation."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        conv, state = None, None
        for batch in batches:
            done = []
            for c, text, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        done.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, body = read_turn(text)
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                if a is not None:
                    learned = unescape(text[a:b])
                    state[2] += len(learned)
                    state[3].update(learned.encode("utf-8", "surrogatepass"))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
        if state is not None:
            last = [conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(last, kinds, strict=True)], names)

    said = F.regexp_replace("formatted", r"(?s)\\(.)", "$1")  # ties go by the text, not by its escaped form
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", said)
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, schema)
