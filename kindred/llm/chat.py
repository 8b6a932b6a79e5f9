"""Chat formatting with typed content parts.

A visitor flattens the parts of a turn: text is escaped, an image, audio or
document becomes a placeholder in its place, with its attachment recorded and
the tokens it will expand to counted.  A turn is one segment::

    <turn ROLE>CONTENT</turn>\\n

In roles and texts ``\\`` and ``<`` (and in roles ``>``) have a ``\\`` before
them, so no text can form a control string, and what is read back is what was
given.  Segments are formatted where their rows are; a conversation is its
segments in order of turn.  Its loss mask covers the content of assistant
turns, without the marks around it.

Defined cases: a null text is empty, a null role is empty, null parts are
skipped, an unknown kind of part is an error; turns of one number follow each
other by role, then text; rows with a null conversation are one conversation;
repeated rows are turns of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from kindred.llm.runtime import bounded

#: Characters that are unescaped at a time.
STRETCH = 1 << 18
HEAD, TAIL = "<turn ", "</turn>\n"
#: What a role ends at, and what is not plain in a body; each is found in one pass, whatever the length.
_ROLE_END = re.compile(r"\\[\\<>]|[\\<>]")
_WORD = re.compile(r"\S+")
_SPECIAL = re.compile(r"\\[\\<>]|<(image|audio|document) (\d+)>|[\\<]")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<")


def unescape(text: str) -> str:
    """Without the marks of ``escape``, a stretch at a time."""
    out, low = [], 0
    while low < len(text):
        high = min(low + STRETCH, len(text))
        own = text[low:high]
        if (len(own) - len(own.rstrip("\\"))) % 2 and high < len(text):  # not between a mark and what it stands before
            high += 1
            own = text[low:high]
        # pairs of backslashes part a stretch first, so that no other mark can begin within one
        out.append("\\".join(part.replace("\\<", "<").replace("\\>", ">") for part in own.split("\\\\")))
        low = high
    return "".join(out)


@dataclass(frozen=True)
class Costs:
    """Tokens that attachments expand to."""

    image_base: int = 85
    image_tile: int = 170
    tile: int = 512
    audio_second: float = 25.0
    document_page: int = 750


@dataclass
class PartVisitor:
    """Flattens the parts of one turn, in order."""

    costs: Costs = field(default_factory=Costs)
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0

    def visit(self, part: dict | None) -> None:
        if part is not None:
            method = getattr(self, f"visit_{part.get('type') or 'text'}", None)
            if method is None:
                raise ValueError(f"unknown kind of part: {part.get('type')!r}")
            method(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        self.tokens += sum(1 for _ in _WORD.finditer(text))
        self.out.append(escape(text))

    def visit_image(self, part: dict) -> None:
        tiles = math.ceil((part.get("width") or 0) / self.costs.tile) * math.ceil((part.get("height") or 0) / self.costs.tile)
        self.attach(part, self.costs.image_base + self.costs.image_tile * tiles)

    def visit_audio(self, part: dict) -> None:
        self.attach(part, math.ceil((part.get("seconds") or 0) * self.costs.audio_second))

    def visit_document(self, part: dict) -> None:
        self.attach(part, (part.get("pages") or 0) * self.costs.document_page)

    def attach(self, part: dict, tokens: int) -> None:
        k = len(self.attachments)
        self.attachments.append({"place": k, "type": part["type"], "uri": part.get("uri"), "tokens": tokens})
        self.tokens += tokens
        self.out.append(f"<{part['type']} {k}>")


ATTACHMENTS = "array<struct<place:long,type:string,uri:string,tokens:long>>"
_ARROW = pa.list_(pa.struct([("place", pa.int64()), ("type", pa.string()), ("uri", pa.string()), ("tokens", pa.int64())]))


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",), costs: Costs | None = None) -> DataFrame:
    """A segment for each row: (conv_id, turn, role, segment, loss_start, loss_end, n_tokens, attachments).

    ``content_col`` is a string, or an array of structs with a ``type`` (text,
    image, audio, document) and the fields that it needs (text, uri, width,
    height, seconds, pages).  ``loss_start`` and ``loss_end`` are code points
    within the segment, equal where there is no loss.  ``n_tokens`` counts the
    words of texts and what attachments expand to.
    """
    costs = costs or Costs()
    bounded(turns.sparkSession)
    given = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(content_col).alias("content"))
    plain = isinstance(given.schema["content"].dataType, StringType)
    if not plain and not isinstance(given.schema["content"].dataType, ArrayType):
        raise TypeError("content is a string or an array of parts")

    def run(batches):
        for batch in batches:
            rows = []
            for role, content in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                visitor = PartVisitor(costs)
                for part in [{"type": "text", "text": content}] if plain else content or []:
                    visitor.visit(part)
                body = "".join(visitor.out)
                head = f"{HEAD}{escape(role or '').replace('>', chr(92) + '>')}>"
                end = len(head) + len(body) if role in loss_roles else len(head)
                rows.append((head + body + TAIL, len(head), end, visitor.tokens, visitor.attachments))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            made = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), _ARROW), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], ["conv_id", "turn", "role", "segment", "loss_start", "loss_end", "n_tokens", "attachments"])

    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    return given.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role {kinds['role']}, segment string, loss_start long, loss_end long, n_tokens long, attachments {ATTACHMENTS}")


def parse_segment(segment: str) -> tuple[str, list[tuple[str, str]]]:
    """Role and parts of a segment: ('text', text) or (kind, place among attachments).

    One pass over the segment, in memory of a few times its length.
    """
    role_end = next((m.start() for m in _ROLE_END.finditer(segment, len(HEAD)) if len(m[0]) == 1), -1)
    last = len(segment) - len(TAIL)
    if not segment.startswith(HEAD) or not segment.endswith(TAIL) or not 0 <= role_end < last or segment[role_end] != ">":
        raise ValueError("not a turn")
    parts, low = [], role_end + 1
    for p in _SPECIAL.finditer(segment, low, last):
        if p[1]:
            parts += [("text", unescape(segment[low : p.start()]))] * (p.start() > low) + [(p[1], p[2])]
            low = p.end()
        elif p.end() - p.start() == 1:
            raise ValueError("not a turn")
    parts += [("text", unescape(segment[low:last]))] * (low < last or not parts)
    return unescape(segment[len(HEAD) : role_end]), parts


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(segments: DataFrame) -> DataFrame:
    """(conv_id, DIGESTS) of formatted conversations, parsed from their segments.

    A conversation streams through one task in order of its turns, and a task
    holds one batch at a time, however long the conversation is: digests over
    all turns can't be put together from parts.
    """
    kind = segments.schema["conv_id"].dataType.simpleString()
    ordered = segments.select("conv_id", "turn", "role", "segment", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")

    def run(batches):
        now, state = None, None

        def done():
            n, turns, chars, loss, formatted = state
            return (now, n, turns.hexdigest(), chars, loss.hexdigest(), formatted)

        def batch_of(rows, kind):
            columns = list(zip(*rows, strict=True))
            types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        conv_type = pa.int64()
        for batch in batches:
            rows, conv_type = [], batch.schema.field(0).type
            for conv, segment, low, high in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        rows.append(done())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, parts = parse_segment(segment)
                text = "".join(t if k == "text" else f"<{k} {t}>" for k, t in parts)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                lost = unescape(segment[low:high])
                state[2] += len(lost)
                state[3].update(lost.encode())
                state[4] += len(segment)
            if rows:
                yield batch_of(rows, conv_type)
        if state is not None:
            yield batch_of([done()], conv_type)

    return ordered.mapInArrow(run, f"conv_id {kind}, {DIGESTS}")
