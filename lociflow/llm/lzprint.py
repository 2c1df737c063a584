"""Lempel-Ziv phrase fingerprints.

A text is parsed into phrases, each the longest phrase seen before plus one character.  The set of phrase
hashes is reduced to a minimum-hash signature; the share of equal values estimates how many phrases two texts
have in common, as their compressed sizes would.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, range_bounds, range_number, shuffle_partitions

SIZE = 128
_rng = np.random.default_rng(777)
_A = _rng.integers(0, 1 << 31, SIZE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, SIZE, dtype=np.uint32)
_MASK = (1 << 64) - 1


class Phrases:
    """The phrases of a text as a tree: each is a node, found from its parent's number and its last character."""

    def __init__(self) -> None:
        self.nodes: dict[int, int] = {}
        self.hashes = [0]  # of each node's phrase, in order; the root has none

    def parse(self, text: str, node: int = 0) -> int:
        """Add the text's phrases, the first of which starts at ``node``; returns the node of the phrase still open, or 0."""
        find, hashes = self.nodes.get, self.hashes
        for c in map(ord, text):
            edge = node << 21 | c
            node = find(edge, 0)
            if not node:
                self.nodes[edge] = len(hashes)
                hashes.append((hashes[edge >> 21] * 0x9E3779B97F4A7C15 + c + 1) & _MASK)
        return node

    def forget(self, size: int) -> None:
        """Only the first ``size`` hashes stay."""
        for _ in range(len(self.hashes) - size):
            self.nodes.popitem()
        del self.hashes[size:]

    def signature(self) -> np.ndarray:
        """SIZE values of 16 bits of the set of phrases; all ones for a text without any.  A phrase left open is among them already."""
        h = np.array(self.hashes[1:], np.uint64)
        if not len(h):
            return np.full(SIZE, 0xFFFF, np.uint16)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (h >> np.uint64(32)).astype(np.uint32)
        low = np.full(SIZE, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 4096):
            v = x[None, at : at + 4096] * _A[:, None] + _B[:, None]
            low = np.minimum(low, v.min(1))
        low = (low ^ (low >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        return (low >> np.uint32(16)).astype(np.uint16)


def fingerprint(text: str | None) -> np.ndarray:
    phrases = Phrases()
    phrases.parse(text or "")
    return phrases.signature()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def show(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [show(fingerprint(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], ["key", "fingerprint"])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (hex), one row per input row; null counts as empty; equal texts have equal fingerprints.

    Keys may be null or repeat; texts are parsed whole, a task holding one text's phrases; an empty table gives no rows, and other columns, whatever
    their names, aren't looked at.
    """
    rows = pick(df, key, text).toDF("key", "text")
    return rows.mapInArrow(_map, f"key {rows.schema['key'].dataType.simpleString()}, fingerprint string").withColumnRenamed("key", key)


def in_order(df: DataFrame, n_ranges: int | None = None, range_bytes: int = 16 << 20) -> tuple[DataFrame, int]:
    """doc_id, text, tie, bucket, tail, and the number of ranges: rows dealt in ranges of (doc_id, tie), each range ending with the row that follows it (tail).

    ``tie`` is a hash of the text.  Ranges have about equal bytes: their bounds come from a sample in which a row's chance grows
    with its size.  After the last range its tail is the first row of all.  Only the sample's keys and one key per range
    pass through the driver; only rows that repeat in full can't be split.
    """
    spark = df.sparkSession
    rows = pick(df, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tie", F.xxhash64("text"))
    size = F.octet_length("text") + 64
    total = rows.agg(F.sum(size)).first()[0] or 0
    n = n_ranges or max(shuffle_partitions(spark), math.ceil(total / range_bytes))
    bounds = range_bounds(rows.withColumn("size", size), ["doc_id", "tie"], n, "size", total)
    dealt = rows.withColumn("bucket", range_number(bounds, ["doc_id", "tie"]))
    firsts = dealt.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie")).alias("first"))
    # one row per range
    before = firsts.select("bucket", "first", F.lag("bucket").over(Window.orderBy("bucket")).alias("previous"), F.max("bucket").over(Window.partitionBy(F.lit(1))).alias("last"))
    before = before.select("bucket", "first", F.coalesce("previous", "last").alias("to"))
    at_first = F.expr("d.bucket = b.bucket and d.doc_id <=> b.first.doc_id and d.tie = b.first.tie")
    heads = dealt.alias("d").join(F.broadcast(before.alias("b")), at_first).select("d.doc_id", "d.text", "d.tie", F.col("b.to").alias("bucket"))
    heads = heads.groupBy("bucket", "doc_id", "tie").agg(F.min("text").alias("text"))
    return dealt.withColumn("tail", F.lit(False)).unionByName(heads.withColumn("tail", F.lit(True))), len(bounds) + 1


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document, the text it becomes when its second half is replaced from the next document, and likenesses."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "tail")), strict=True)

    def halves(text: str):
        """How many characters stay, their phrases, the node of the one that is open, and the whole text's signature."""
        keep, phrases = len(text) - len(text) // 2, Phrases()
        node = phrases.parse(text[:keep])
        size = len(phrases.hashes)
        phrases.parse(text[keep:], node)
        own = phrases.signature()
        phrases.forget(size)
        return keep, phrases, node, own

    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    out, size, held = [], 0, None
    for doc_id, text, bucket, tail in rows():
        state = halves(text)
        if held is not None and held[2] == bucket:
            old_id, old, _, (keep, phrases, node, own) = held
            more = text[: len(old) - keep]
            phrases.parse(more, node)
            edited = phrases.signature()
            out.append((old_id, len(old), old[:keep] + more, show(own), show(edited), likeness(own, edited), likeness(own, state[3])))
            size += len(old)
        held = None if tail else (doc_id, text, bucket, state)
        if size > 8_000_000 or len(out) >= 5000:
            yield _batch(out, names)
            out, size = [], 0
    if out:
        yield _batch(out, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def compare_with_next(df: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next, one row per input row.

    The edited text replaces the last floor(n/2) code points by as many of the next document's first, or all it
    has.  The next document is the one with the next doc_id, and the first after the last; null comes first,
    equal ids go by a hash of the text.  A single document follows itself.  doc_id must be an integer; other columns are
    ignored, and an empty table gives no rows.  A text and its successor are held whole by a task.
    """
    kind = pick(df, "doc_id").schema["doc_id"].dataType.simpleString()
    dealt, n = in_order(df, n_ranges)
    near = dealt.repartitionById(n, "bucket").sortWithinPartitions("bucket", "tail", "doc_id", "tie", "text")
    return near.mapInArrow(_with_next, f"doc_id {kind}, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
