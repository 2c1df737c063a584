"""Benchmark decontamination by a prefix-filtered join of shingles.

A window is 13 consecutive words of a benchmark item, or a shorter item whole.  A document that contains a
window contains all its shingles, so the window's rarest shingle alone is a sufficient prefix.  Rarity is
counted over all documents.  Documents give a row for each place of such a shingle, with the words around it;
these rows are joined to the windows by shingle.  Where a window would not fit is dropped by position and
length, and the others are compared word by word.  Documents are read twice, whatever the size of the benchmark:
what a task needs to know of it is a Bloom filter of bounded size, which only saves rows of the joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, by_place, cut, pick

#: Lower-cases A-Z and turns every other ASCII character but digits and a-z into a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_HASHES = WordHashes()
#: Bits of a Bloom filter for each shingle, and at most.
BITS_EACH, MOST_BITS = 16, 1 << 27
_SLICE = 32_768  # bits of one bitmap of Spark's


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows(item: list[bytes], length: int) -> Iterator[bytes]:
    return (b" ".join(item[i : i + length]) for i in range(max(1, len(item) - length + 1) if item else 0))


def shingles(w: list[bytes], size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words."""
    h = np.fromiter(map(_HASHES.__getitem__, w), np.uint64, len(w))
    return _runs(h, size)


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    n = max(len(h) - size + 1, 0)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = (out ^ h[i : i + n]) * _MIX
        out ^= out >> np.uint64(32)
    return out


def _windower(length: int, item_type: pa.DataType):
    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = []
                for w in windows(words(text), length):
                    found.append(w)
                    if len(found) == 20_000:
                        yield pack(item, found)
                        found = []
                if found:
                    yield pack(item, found)

    def pack(item, found: list[bytes]) -> pa.RecordBatch:
        found = list(dict.fromkeys(found))
        return pa.RecordBatch.from_arrays([pa.array([item] * len(found), item_type), pa.array([w.decode() for w in found], pa.string()), pa.array([w.count(b" ") + 1 for w in found], pa.int32())], ["item", "window", "size"])

    return cut_windows


def _gram_rows(shingle: int):
    """Every shingle of every window, and its place in it."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, found = [], [], []
            for w, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = text.encode().split(b" ")
                g = shingles(x, min(shingle, len(x)))
                ids.append(np.full(len(g), w))
                at.append(np.arange(len(g)))
                found.append(g)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(at), pa.int32()), pa.array(np.concatenate(found).view(np.int64))], ["w", "at", "gram"])

    return grams


class Bloom:
    """A set of 64-bit hashes that may hold too much, never too little; built by Spark, used in tasks."""

    def __init__(self, hashes: DataFrame, column: str) -> None:
        n = hashes.agg(F.approx_count_distinct(column)).first()[0]
        self.bits = min(max(_SLICE, 1 << (n * BITS_EACH - 1).bit_length() if n else 1), MOST_BITS)
        low = F.lit(self.bits - 1).cast("long")
        both = F.array(F.col(column).bitwiseAND(low), F.shiftrightunsigned(column, 32).bitwiseAND(low))
        at = hashes.select(F.explode(both).alias("at"))
        parts = at.groupBy((F.col("at") / _SLICE).cast("int").alias("part")).agg(F.expr(f"bitmap_construct_agg(at % {_SLICE})").alias("bits"))
        self.data = np.zeros(self.bits // 8, np.uint8)
        for r in parts.collect():  # MOST_BITS at most
            self.data[r["part"] * _SLICE // 8 : (r["part"] + 1) * _SLICE // 8] = np.frombuffer(r["bits"], np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be in the set."""
        low, at = np.uint64(self.bits - 1), np.arange(len(h))
        for shift in (np.uint64(0), np.uint64(32)):
            x = (h[at] >> shift) & low
            at = at[(self.data[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        return at


def _counter(known: Bloom, sizes: list[int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [np.empty(0, np.uint64)]
            for text in batch.column(0).to_pylist():
                h = np.fromiter(map(_HASHES.__getitem__, w), np.uint64, len(w)) if (w := words(text)) else np.empty(0, np.uint64)
                for n in sizes:
                    g = _runs(h, n)
                    seen.append(g[known.has(g)])
            grams, n = np.unique(np.concatenate(seen), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n, pa.int64())], ["gram", "n"])

    return count


def _looker(known: Bloom, sizes: list[int], length: int, shingle: int):
    """Each document's number of words, and where the chosen shingles may be: place, shingle, words around it, its place in these."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ends, pos, grams, near, first = [], [0], [], [], [], []
            for text in batch.column("text").to_pylist():
                w = words(text)
                h = np.fromiter(map(_HASHES.__getitem__, w), np.uint64, len(w))
                for n in sizes:
                    g = _runs(h, n)
                    at = known.has(g)
                    reach = length - 1 if n == shingle else 0  # a shorter one is its window
                    grams.append(g[at].view(np.int64))
                    pos.append(at)
                    for i in at.tolist():
                        a = max(0, i - reach)
                        near.append(b" ".join(w[a : i + n + reach]).decode())
                        first.append(i - a)
                counts.append(len(w))
                ends.append(len(near))
            none = [np.empty(0, np.int64)]
            fields = [pa.array(np.concatenate(pos + none), pa.int32()), pa.array(np.concatenate(grams + none), pa.int64()), pa.array(near, pa.string()), pa.array(first, pa.int32())]
            spots = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["pos", "gram", "near", "first"]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("digest"), pa.array(counts, pa.int64()), spots], ["key", "digest", "n_words", "spots"])

    return look


def merged(spans) -> list[tuple[int, int]]:
    """Overlapping and touching spans made one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        at = batch.schema.names.index("spans")
        spans = [[{"start": a, "end": b} for a, b in merged((x["start"], x["end"]) for x in found)] for found in batch.column(at).to_pylist()]
        columns = list(batch.columns)
        columns[at] = pa.array(spans, span)
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def _chosen(rows: DataFrame, bench: DataFrame, window: int, shingle: int) -> tuple[DataFrame, list[int]]:
    """window, size, items, gram, at: every window that documents may contain, with its rarest shingle; and the sizes of shingles."""
    kind = bench.schema["item_id"].dataType.simpleString()
    item_type = pa.int64() if kind == "bigint" else bench.limit(0).toArrow().schema.field("item_id").type
    cuts = bench.mapInArrow(_windower(window, item_type), f"item {kind}, window string, size int")
    all_windows = cut(cuts.groupBy("window", "size").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("w", F.monotonically_increasing_id()))
    grams = all_windows.select("w", "window").mapInArrow(_gram_rows(shingle), "w long, at int, gram long")
    sizes = sorted(r[0] for r in all_windows.select(F.least("size", F.lit(shingle))).distinct().collect())
    counts = rows.select("text").mapInArrow(_counter(Bloom(grams, "gram"), sizes), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counted = grams.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("w").agg(F.min(F.struct("n", "at", "gram")).alias("x")).where("x.n > 0")  # a shingle that no document has rules the window out
    return cut(all_windows.join(rarest, "w").select("window", "size", "items", "x.gram", "x.at")), sizes


def _found(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int, key: str) -> DataFrame:
    """key, digest, n_words, spans, items, one row per document; the digest is the text's."""
    bench = pick(benchmark, "item_id", "text").where("item_id is not null and text is not null")
    rows = pick(docs, key, "text").toDF("key", "text").withColumn("digest", F.sha2("text", 256))
    chosen, sizes = _chosen(rows, bench, window, shingle)
    spot = "array<struct<pos:int,gram:bigint,near:string,first:int>>"
    looked = cut(rows.mapInArrow(_looker(Bloom(chosen, "gram"), sizes, window, shingle), f"key {rows.schema['key'].dataType.simpleString()}, digest string, n_words long, spots {spot}"))
    spots = looked.select("key", "digest", F.inline("spots"))
    start = F.col("first") - F.col("at")
    same = F.array_join(F.slice(F.split("near", " "), F.greatest(start, F.lit(0)) + 1, F.col("size")), " ") == F.col("window")
    hits = spots.join(chosen, "gram").where((start >= 0) & same).withColumn("start", F.col("pos") - F.col("at"))
    # equal rows have equal hits, so one row for each is enough to join back
    span = F.struct("start", (F.col("start") + F.col("size")).alias("end"))
    met = hits.groupBy("key", "digest").agg(F.collect_set(span).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    kinds = {c: met.schema[c].dataType.simpleString() for c in ("key", "spans", "items")}
    none = [F.array().cast(kinds[c]).alias(c) for c in ("spans", "items")]
    clean = looked.where("size(spots) = 0").select("key", "digest", "n_words", *none)
    left, right = looked.where("size(spots) > 0").select("key", "digest", "n_words").alias("l"), met.alias("r")
    joined = left.join(right, F.expr("l.key <=> r.key and l.digest <=> r.digest"), "left").select("l.key", "l.digest", "n_words", *(F.coalesce(c, x).alias(c) for c, x in zip(("spans", "items"), none, strict=True)))
    return clean.union(joined.mapInArrow(_merge, f"key {kinds['key']}, digest string, n_words long, spans {kinds['spans']}, items {kinds['items']}"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 3, key: str = "doc_id") -> DataFrame:
    """key, n_words, spans (merged word ranges inside windows), items (ids with occurring windows, sorted).

    One row per row of ``docs``, repeated rows and null keys included; null and empty texts have no words, and
    other columns are ignored.  Items without words or with a null id are left out, and items that repeat count
    once.  Either table may be empty.
    """
    return _found(docs, benchmark, window, shingle, key).select(F.col("key").alias(key), "n_words", "spans", "items")


def hit_words(spans="spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: int = 20, window: int = 13, shingle: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, without those of which windows cover 1 word in ``share`` or more.

    The verdict is joined to the rows by doc_id and digest of the text; equal rows have equal verdicts, and a null
    doc_id counts as a value.  ``docs`` has doc_id and text once; further columns may repeat.
    Rows with a null or empty text stay, an empty benchmark takes nothing, an empty table stays empty, and texts are read whole.
    """
    found = _found(docs, benchmark, window, shingle, "doc_id")
    bad = found.where((hit_words() > 0) & (share * hit_words() >= F.col("n_words"))).select("key", "digest").distinct()
    at = [docs.columns.index(c) for c in ("doc_id", "text")]
    rows = by_place(docs)
    same = F.col(f"_c{at[0]}").eqNullSafe(F.col("key")) & F.sha2(F.col(f"_c{at[1]}"), 256).eqNullSafe(F.col("digest"))
    return rows.join(bad, same, "left_anti").toDF(*docs.columns)
