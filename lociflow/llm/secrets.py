"""Secret scans: three patterns, and a token-efficiency test for random strings.

A string that a public BPE vocabulary can only write with few characters per token is random; digests,
UUIDs, dates, book numbers and digits alone are left out, also inside longer strings.  Such spans are reported as
``random`` where no pattern matched.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_place, pick

#: The words that name a secret, and the patterns.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
LONG_HEX = re.compile("[0-9a-f]{32}")
RUN = re.compile("[A-Za-z0-9+/_=-]{8,}")
#: Limits of characters per token for runs under 20, by alphabet, from each length on: clean text of one case is as hard to write as short random strings.
LIMITS = {"digits": ((16, 2.0), (12, 1.8), (8, 1.6)), "mixed": ((16, 2.0), (12, 1.8), (8, 1.6)), "single": ((16, 1.6), (12, 1.5), (8, 1.25))}
#: Fixed forms of known identifiers and digests: UUID, digest with its name in base 64, hex digest by length, date with time, book number.
FORMS = (
    "[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    "sha(?:256|384|512)-[A-Za-z0-9+/]{43,}={0,2}",
    "[0-9a-fA-F]{128}|[0-9a-fA-F]{96}|[0-9a-fA-F]{64}|[0-9a-fA-F]{56}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32}",
    "[0-9]{4}-?[0-9]{2}-?[0-9]{2}(?:[T_-]?[0-9]{2,6}Z?)?",
    "(?:ISBN-?)?(?:97[89]-)?[0-9]{1,5}-[0-9]{1,7}-[0-9]{1,7}-[0-9X]",
)
KNOWN = re.compile(f"(?<![0-9A-Za-z])(?:{'|'.join(FORMS)})(?![0-9A-Za-z])")


@functools.lru_cache(2)
def encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, in order."""
    found = []
    low = text.lower()
    if any(n in low for n in NAMES) or not low.isascii() and ASSIGN.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if LONG_HEX.search(text):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(found)


def alphabet(s: str) -> str | None:
    """Letters with digits, letters of mixed case (beyond a capital), of one case; None without letters."""
    if not any(c.isalpha() for c in s):
        return None
    if any(c.isdigit() for c in s):
        return "digits"
    return "mixed" if any(c.isupper() for c in s[1:]) and any(c.islower() for c in s) else "single"


def unknown_parts(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """What known identifiers leave of a run, without signs at its ends; the whole run if it holds none."""
    at, whole = start, True
    for m in KNOWN.finditer(text, start, end):
        yield from _bare(text, at, m.start())
        at, whole = m.end(), False
    if whole:
        yield start, end
    else:
        yield from _bare(text, at, end)


def _bare(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    while start < end and not text[start].isalnum():
        start += 1
    while start < end and not text[end - 1].isalnum():
        end -= 1
    if end - start >= 8:
        yield start, end


def random_spans(text: str, taken: list[tuple[int, int, int]], encode, ratio: float) -> list[tuple[int, int, int]]:
    found = []
    for m in RUN.finditer(text):
        for start, end in unknown_parts(text, *m.span()):
            s = text[start:end]
            kind = alphabet(s)
            if not kind or any(a < end and start < b for a, _, b in taken):
                continue
            limit = ratio if len(s) >= 20 else next(x for n, x in LIMITS[kind] if len(s) >= n)
            if len(s) < limit * len(encode(s)):
                found.append((start, 3, end))
    return found


def _finder(ranks: bytes, pattern: str, ratio: float):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks, pattern).encode_ordinary
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(base + random_spans(text or "", base, encode, ratio))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, "spans"])

    return find


def find_secrets(df: DataFrame, ranks: bytes, pattern: str, ratio: float = 2.2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, spans: array of (kind, start, end) by start, then kind; code points, end exclusive.

    ``ranks`` is the content of a tiktoken file, ``pattern`` its split pattern.  A run of 8 or more of
    ``A-Za-z0-9+/_=-`` with a letter, or what known identifiers in it leave (``FORMS``), is ``random`` when it has
    fewer characters per token than ``ratio``, or, under 20 characters, than its length and alphabet allow (``LIMITS``).
    A null text has no spans and stays null.  Texts are scanned whole, a row at a time; rows that repeat have the same
    spans, other columns are ignored, and an empty table gives no rows.
    """
    rows = pick(df, key, text).toDF("key", "text")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_finder(ranks, pattern, ratio), f"key {kind}, text string, spans array<struct<kind:string,start:int,end:int>>").toDF(key, text, "spans")


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            parts, at = [], 0
            for s in spans or []:
                if s["end"] > at:
                    parts += [] if s["start"] < at else [text[at : s["start"]], "[SECRET]"]
                    at = s["end"]
            out.append(text if not parts else "".join(parts) + text[at:])
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.string())], ["key", "text"])


def redact(found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text with each span, or run of overlapping spans, replaced by ``[SECRET]``."""
    rows = pick(found, key, text, "spans").toDF("key", "text", "spans")
    return rows.mapInArrow(_redact, f"key {rows.schema['key'].dataType.simpleString()}, text string").toDF(key, text)


def _redact_rows(ranks: bytes, pattern: str, ratio: float, text_at: int, size_at: int):
    find = _finder(ranks, pattern, ratio)

    def redact_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([batch.column(text_at), batch.column(text_at)], ["key", "text"])
            new = next(_redact(find(iter([pair])))).column("text")
            old, texts = batch.column(text_at).to_pylist(), new.to_pylist()
            columns = list(batch.columns)
            sizes = [n if a == b else len(b) for a, b, n in zip(old, texts, columns[size_at].to_pylist(), strict=True)]
            columns[text_at], columns[size_at] = new, pa.array(sizes, columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return redact_rows


def redact_documents(docs: DataFrame, ranks: bytes, pattern: str, ratio: float = 2.2) -> DataFrame:
    """The rows of ``docs``, all columns, with secrets in text redacted, and n_chars (any integer type) new where the text is; no shuffle.

    Null texts stay null, further columns may repeat names, and an empty table stays empty.
    """
    rows = by_place(docs)
    made = _redact_rows(ranks, pattern, ratio, docs.columns.index("text"), docs.columns.index("n_chars"))
    return rows.mapInArrow(made, rows.schema).toDF(*docs.columns)
