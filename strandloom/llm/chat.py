"""Event-sourced chat formatting: conversation logs folded into final messages and rendered as training text with a loss mask.

An event is (conv_id, turn, seq, kind, role, text). Events are dealt by conversation, sorted by (turn, seq) and folded one by one, so the
state is one message however long a conversation is:

* ``message``     opens a message with this role and text (an earlier one of the same turn is finished, not replaced);
* ``delta``       appends streamed text to the open message of the turn;
* ``edit``        replaces its text;
* ``regenerate``  throws its text away (the event's text, if any, takes its place) and lets later deltas build the new one;
* ``retract``     removes it.

A finished message is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts every ``<|`` gets a backslash more
between its two characters (``<\\|``, and ``<\\|`` itself becomes ``<\\\\|``), so no text can hold a control string and reading back is exact.
In roles backslash and newline are escaped as well. Output rows are parts of a conversation, cut between messages.

Defined cases: null text or role is empty; a null kind is ``message``; delta, edit and regenerate without an open message open one; null
conv_id is a conversation of its own; null turn or seq come first; ties in (turn, seq) are ordered by kind, role and text; repeated rows count
each; an empty table yields no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columnar import slices

START, END = "<|im_start|>", "<|im_end|>"
PART_CHARS = 1 << 20
SCHEMA = "conv_id long, part long, n_turns long, formatted string, loss array<struct<start:long,length:long>>"
TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def message_events(rows: DataFrame, conv_id: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """The events of a table that already holds one row per message."""
    return rows.select(conv_id.alias("conv_id"), turn.alias("turn"), F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), role.alias("role"), text.alias("text"))


def streamed_events(rows: DataFrame, conv_id: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """The log that a client might have written of the same messages: an assistant's text streams in two halves after a draft was thrown away, anybody else's is
    typed, taken back, begun again and edited. Rows of one turn keep the order of (role, text) and don't mingle."""
    final, who = F.coalesce(text, F.lit("")), F.coalesce(role, F.lit(""))
    place = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("who", "final")) * 8
    base = rows.select(conv_id.alias("conv_id"), turn.alias("turn"), role.alias("role"), who.alias("who"), final.alias("final")).withColumn("place", place.cast("long"))
    half = F.floor(F.char_length("final") / 2).cast("int")
    first, rest = F.substr("final", F.lit(1), half), F.substr("final", half + 1, F.char_length("final"))

    def log(*steps: tuple[str, Column]) -> Column:
        return F.array(*(F.struct((F.col("place") + i).alias("seq"), F.lit(kind).alias("kind"), said.alias("text")) for i, (kind, said) in enumerate(steps)))

    none = F.lit(None).cast("string")
    streamed = log(("message", F.lit("")), ("delta", F.reverse("final")), ("regenerate", none), ("delta", first), ("delta", rest))
    typed = log(("message", F.reverse("final")), ("retract", none), ("message", first), ("edit", F.col("final")))
    each = base.select("conv_id", "turn", "role", F.explode(F.when(F.col("who") == "assistant", streamed).otherwise(typed)).alias("e"))
    return each.select("conv_id", "turn", "e.seq", "e.kind", "role", "e.text")


def fold(events: Iterator[tuple]) -> Iterator[tuple]:
    """Final messages (conv_id, role, text) of sorted events (conv_id, turn, kind, role, text)."""
    at, role, parts = None, "", None
    for conv_id, turn, kind, who, text in events:
        if parts is not None and (conv_id, turn) != at:
            yield at[0], role, "".join(parts)
            parts = None
        at, text = (conv_id, turn), text or ""
        if parts is None or kind == "message" or kind is None:
            if kind == "retract":
                continue
            if parts is not None:
                yield conv_id, role, "".join(parts)
            role, parts = who or "", [text]
        elif kind == "delta":
            parts.append(text)
        elif kind in ("edit", "regenerate"):
            parts = [text]
        elif kind == "retract":
            parts = None
    if parts is not None:
        yield at[0], role, "".join(parts)


def render(messages: Iterator[tuple], roles: frozenset[str], part_chars: int) -> Iterator[tuple]:
    """(conv_id, part, n_turns, formatted, loss spans in code points)."""
    conv, part, size, out, loss, open_ = None, 0, 0, [], [], False
    for conv_id, role, text in messages:
        if open_ and (conv_id != conv or size >= part_chars):
            yield conv, part, len(out), "".join(out), loss
            part = part + 1 if conv_id == conv else 0
            out, loss, size = [], [], 0
        elif not open_:
            part = 0
        conv, open_ = conv_id, True
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role in roles:
            loss.append({"start": size + len(head), "length": len(body)})
        out.append(f"{head}{body}{END}\n")
        size += len(out[-1])
    if open_:
        yield conv, part, len(out), "".join(out), loss


def format_conversations(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), part_chars: int = PART_CHARS) -> DataFrame:
    """Parts of formatted conversations; the parts of one follow each other in one partition, in order."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])
    roles = frozenset(loss_roles)
    columns = ("conv_id", "turn", "kind", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorted_events = (row for batch in slices(batches) for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
        rows, size = [], 0
        for row in render(fold(sorted_events), roles, part_chars):
            rows.append(row)
            size += len(row[3])
            if size > part_chars:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    order = ("conv_id", "turn", "seq", "kind", "role", "text")
    return events.select(*order).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, SCHEMA)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    return [(unescape_role(role), unescape(text)) for role, text in TURN.findall(formatted)]


def read_back(formatted: DataFrame) -> DataFrame:
    """What the output of format_conversations says, per conversation: counts and digests of its turns and of the text under its mask."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        conv, state = None, None

        def close() -> None:
            n, turns, chars, loss, size = state
            rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            for conv_id, part, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss")), strict=True):
                if state is None or part == 0:
                    if state is not None:
                        close()
                    conv, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in spans:
                    said = unescape(text[span["start"] : span["start"] + span["length"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if len(rows) >= 10_000:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows.clear()
        if state is not None:
            close()
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
