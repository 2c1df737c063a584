"""Chat formatting with a grammar round trip.

A conversation is a sequence of segments, one per turn, each between the opening and closing string of its
role.  Every segment is parsed again as soon as it is rendered; where the parsed turn differs from the
source, control strings in the text are escaped and the segment is rendered anew, until both are the same.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

#: The strings around a turn by role.  Any other role is written inside its opening string.
ROLES = {"system": ("<<SYS>> ", " <</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}
OTHER = ("[ROLE:", "] ", " [/ROLE]")
#: A control string, with any number of backslashes after its first character; one more escapes it.
CONTROL = re.compile(r"([<\[])(\\*)(?=<SYS>>|</SYS>>|INST\]|/INST\]|/?s>|ROLE:|/ROLE\])")


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1] + m[2][1:], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The segment, and where the text is in it."""
    if role in ROLES:
        start, end = ROLES[role]
    else:
        start, end = OTHER[0] + role.encode("unicode_escape").hex() + OTHER[1], OTHER[2]
    return start + text + end, len(start), len(start) + len(text)


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, where the text starts, where it ends) of each turn; fails on anything that is no segment."""
    at = 0
    while at < len(formatted):
        for role, (start, end) in ROLES.items():
            if formatted.startswith(start, at):
                begin = at + len(start)
                break
        else:
            close = formatted.find(OTHER[1], at)
            if not formatted.startswith(OTHER[0], at) or close < 0:
                raise ValueError(f"no turn at {at}")
            role, begin, end = bytes.fromhex(formatted[at + len(OTHER[0]) : close]).decode("ascii").encode().decode("unicode_escape"), close + len(OTHER[1]), OTHER[2]
        stop = formatted.find(end, begin)
        if stop < 0 or any(not m[2] for m in CONTROL.finditer(formatted, begin, stop)):
            raise ValueError(f"open turn, or control string inside it, at {at}")
        yield role, unescape(formatted[begin:stop]), begin, stop
        at = stop + len(end)


def parses_to(segment: str, role: str, text: str) -> bool:
    try:
        return [(r, t) for r, t, _, _ in parse(segment)] == [(role, text)]
    except ValueError:
        return False


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A segment that parses back to (role, text)."""
    made = render(role, text)
    if not parses_to(made[0], role, text):
        made = render(role, escape(text))
        if not parses_to(made[0], role, text):
            raise ValueError(f"no segment gives back {text[:80]!r}")
    return made


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [segment(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        keep = [c for c in batch.schema.names if c in ("conv_id", "turn")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] if r == "assistant" else None for m, r in zip(made, batch.column("role").to_pylist(), strict=True)], pa.int32()), pa.array([m[2] if r == "assistant" else None for m, r in zip(made, batch.column("role").to_pylist(), strict=True)], pa.int32())],
            [*keep, "segment", "loss_start", "loss_end"],
        )


def format_turns(df: DataFrame) -> DataFrame:
    """conv_id, turn, segment, loss_start, loss_end: one row per turn, every segment checked by parsing it.

    The formatted conversation is its segments by (turn, segment), one after another.  The loss mask covers the
    text of assistant turns: [loss_start, loss_end) in code points of the segment, else null.  A null text or role counts as empty.
    Turns that repeat give a row each, null conv_ids and turns stay null, texts are rendered whole however long, an empty table gives no rows, and other
    columns, whatever their names, aren't looked at.
    """
    rows = pick(df, "conv_id", "turn", "role", "text").withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    return rows.mapInArrow(_render, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, segment string, loss_start int, loss_end int")


def format_conversations(df: DataFrame) -> DataFrame:
    """conv_id, formatted: each conversation as one text.  Only for conversations that fit in one row; read_back() has no such bound."""
    turns = format_turns(df)
    ordered = F.array_sort(F.collect_list(F.struct("turn", "segment")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["segment"]), "").alias("formatted"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by conversation and turn; a conversation is read as it comes, whatever its length."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    out, now = [], None
    for b in batches:
        for conv, text, start, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end")), strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    out.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            now[5] += len(text)
            for role, turn, _, _ in parse(text):
                now[1] += 1
                now[2].update(f"{role}\n{turn}\n".encode("utf-8", "surrogatepass"))
            if start is not None:
                under = unescape(text[start:end])
                now[3] += len(under)
                now[4].update(under.encode("utf-8", "surrogatepass"))
        if len(out) >= 1000:
            yield batch(out)
            out = []
    if now is not None:
        out.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))
    if out:
        yield batch(out)


def read_back(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, parsed from rows of format_turns().

    A digest over a conversation is sequential, so one task reads each conversation, one segment at a time.
    Rows without a conv_id are one conversation; turns that repeat are all read, equal turns by their segments, nulls first.  No rows give none.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    near = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment").select("conv_id", "segment", "loss_start", "loss_end")
    return near.mapInArrow(_read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
