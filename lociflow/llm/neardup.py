"""Near-duplicates by min-max hashing.

Each document's set of word shingles is hashed under 64 permutations, of which both the smallest and the
largest value are kept: 128 signature values for 64 hash evaluations.  Documents with equal sets form one
class, and only its representative goes on.  Signatures are cut into bands; rows of a band with equal values
share a bucket.

A bucket never gives all its pairs.  First its rows meet a pivot and their next neighbours in an order by
further signature values, which brings similar rows together; what is found is made into components.  Buckets
of more rows than neighbours can cover, and that still hold several components, are then compared whole: rows
are dealt to blocks of up to some thousand, and tasks compare two blocks at a time, first by signature, then on
the full sets; only links come out.  Every link is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, by_place, cut, pick

PERMUTATIONS, BAND = 64, 4
_rng = np.random.default_rng(20240501)
_A = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_MIX = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


_HASHES = WordHashes()


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; A-Z is lower-cased and words end at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, len(words) if len(w) < size else 0, np.uint64)
    for i in range(n):
        h = (h ^ w[i : len(w) - n + 1 + i]) * _MIX[0]
        h ^= h >> np.uint64(32)
    h = h * _MIX[1]
    return np.unique(h ^ (h >> np.uint64(29)))


def min_max(hashes: np.ndarray) -> np.ndarray:
    """Least and greatest value under each permutation, as 32-bit values: 2 * PERMUTATIONS of them."""
    low, high = np.full(PERMUTATIONS, np.uint64(2**64 - 1)), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(hashes), 2048):
        h = hashes[None, at : at + 2048] * _A[:, None] + _B[:, None]
        h ^= h >> np.uint64(31)
        low, high = np.minimum(low, h.min(1)), np.maximum(high, h.max(1))
    both = np.concatenate([low, high])
    return ((both * _MIX[1]) >> np.uint64(32)).astype(np.uint32)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, digests, sketches = [], [], []
        for text in batch.column(1).to_pylist():
            s = shingle_set(text)
            n.append(len(s))
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sketches.append(min_max(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), batch.column(2)], ["doc_id", "n", "digest", "sketch", "node"])


def bucket_keys(sketch: np.ndarray) -> np.ndarray:
    """The bucket of each row of signatures in each band."""
    h = np.repeat((np.arange(1, 2 * PERMUTATIONS // BAND + 1, dtype=np.uint64) * _MIX[0])[None, :], len(sketch), 0)
    for i in range(BAND):
        h = (h ^ sketch[:, i::BAND]) * _MIX[1]
        h ^= h >> np.uint64(32)
    return h.astype(np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document and band: bucket key, and the next two signature values as its place in the bucket."""
    count = 2 * PERMUTATIONS // BAND
    for batch in batches:
        if not batch.num_rows:
            continue
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(batch.num_rows, 2 * PERMUTATIONS).astype(np.uint64)
        place = (np.roll(sketch[:, 0::BAND], -1, 1) << np.uint64(32)) | np.roll(sketch[:, 1::BAND], -1, 1)
        docs = np.repeat(np.asarray(batch.column("doc_id")), count)
        sizes = np.repeat(np.asarray(batch.column("n")), count)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket_keys(sketch).ravel(), docs, sizes, place.astype(np.int64).ravel())], ["bucket", "doc", "n", "place"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["doc", "hashes"])


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist(), strict=True)
            good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], ["a", "b", "linked"])

    return confirm


def _pairs(buckets: DataFrame, percent: int, neighbours: int, most: int = 100_000) -> DataFrame:
    """Pairs (a, b) to compare first, a < b: each row with its bucket's pivot and with its next neighbours.

    Neighbours in a bucket of more than ``most`` rows are looked for in parts of it.
    """
    w = Window.partitionBy("bucket", F.pmod(F.xxhash64("doc"), F.ceil(F.col("size") / most))).orderBy("place", "doc")
    me = F.struct("doc", "n")
    partners = [F.lead(me, i).over(w) for i in range(1, neighbours + 1)]
    pivots = buckets.groupBy("bucket").agg(F.min(me).alias("y"))
    near = buckets.select(me.alias("x"), F.array(*partners).alias("ys")).select("x", F.explode("ys").alias("y")).where("y is not null")
    star = buckets.join(pivots, "bucket").select(me.alias("x"), "y")
    return (
        near.union(star)
        .where("x.doc <> y.doc")
        .where(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")
        .select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b"))
        .distinct()
    )


def _linked(percent: int, least_share: float):
    """Links between rows of two blocks of a bucket, or of one, that have different labels.

    Rows come by (bucket, bi, bj, block); a run of equal (bucket, bi, bj) has two blocks at most.  A pair that
    shares several buckets is looked at in that of its first band.  Signatures are made anew from the sets, which
    costs less than to shuffle both.
    """
    least = int(least_share * 2 * PERMUTATIONS)

    def compare(bucket: int, run: list[tuple]) -> pa.RecordBatch:
        block, doc, label, n, sets = zip(*run, strict=True)
        block, doc, label, n = (np.array(x, np.int64) for x in (block, doc, label, n))
        sets = [np.frombuffer(x, np.uint64) for x in sets]
        sig = np.stack([min_max(x) for x in sets])
        keys = bucket_keys(sig.astype(np.uint64))
        split = int(np.searchsorted(block, block[-1])) if block[0] != block[-1] else 0
        found = []
        for i in range(split or len(run)):
            at = np.arange(split or i + 1, len(run))
            at = at[(label[at] != label[i]) & (100 * np.minimum(n[at], n[i]) >= percent * np.maximum(n[at], n[i]))]
            at = at[(sig[at] == sig[i]).sum(1) >= least]
            at = at[keys[at, (keys[at] == keys[i]).argmax(1)] == bucket]
            found += [(min(doc[i], doc[j]), max(doc[i], doc[j])) for j in at if similar(sets[i], sets[j], percent)]
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, key = [], None
        for batch in batches:
            for *k, block, doc, label, n, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key and run:
                    yield compare(key[0], run)
                    run = []
                key = k
                run.append((block, doc, label, n, hashes))
        if run:
            yield compare(key[0], run)

    return linked


def _remaining_links(buckets: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, neighbours: int, block_rows: int = 4096, block_bytes: int = 16 << 20) -> DataFrame:
    """Links (a, b) between different components in buckets that neighbours don't cover.

    Rows of one label share a block of the bucket, or have blocks of their own if they are many, and blocks of one
    and the same label, as a large group of copies has, never meet.  A row is shipped once for each block that its own
    meets, so up to a block's size only once.  At a similarity of 75 % two signatures of 128 values agree in fewer than
    55 % with a probability under one in a million.
    """
    rows = buckets.select("bucket", "doc", "n").join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    share = F.greatest(F.lit(1 / block_rows), F.col("n") * 8 / block_bytes)
    sizes = rows.groupBy("bucket", "label").agg(F.sum(share).alias("share"), F.count("*").alias("k"))
    small = F.when(F.col("share") <= 0.5, F.col("share")).otherwise(0)
    mixed = sizes.groupBy("bucket").agg(F.sum("k").alias("all"), F.count("*").alias("labels"), F.sum(small).alias("small")).where(f"all > {neighbours + 1} and labels > 1")
    kept = sizes.join(mixed, "bucket").select("bucket", "label", "share", "small")
    own = F.xxhash64(F.lit("own"), "label", F.pmod(F.xxhash64("doc"), F.ceil("share")))
    block = F.when(F.col("share") > 0.5, own).otherwise(F.pmod(F.xxhash64("label"), F.greatest(F.ceil("small"), F.lit(1))))
    dealt = cut(rows.join(kept, ["bucket", "label"]).select("bucket", "doc", "n", "label", block.cast("long").alias("block")))
    blocks = dealt.groupBy("bucket", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    both = blocks.alias("x").join(blocks.alias("y"), "bucket").where("x.block <= y.block and not (x.lo = x.hi and y.lo = y.hi and x.lo = y.lo)")
    pairs = both.select("bucket", F.col("x.block").alias("bi"), F.col("y.block").alias("bj")).withColumn("block", F.explode(F.array_distinct(F.array("bi", "bj"))))
    met = dealt.join(pairs, ["bucket", "block"]).join(sets, "doc")
    near = met.select("bucket", "bi", "bj", "block", "doc", "label", "n", "hashes").repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj", "block")
    return near.mapInArrow(_linked(percent, percent / 100 - 0.2), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """doc, label: the least id reachable from each end of the edges (a, b), by alternating large and small stars."""
    def stars(e: DataFrame, small: bool) -> DataFrame:
        both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")) if small else e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        moved = both.join(least, "u")
        out = moved.select(F.col("v").alias("x"), "m").union(moved.select(F.col("u").alias("x"), "m")).where("x <> m") if small else moved.where("v > u").select(F.col("v").alias("x"), "m")
        return out.select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()

    state, seen = edges.select("a", "b").where("a <> b").distinct(), None
    while True:
        state = cut(stars(stars(state, small=False), small=True))
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return state.select(F.col("a").alias("doc"), F.col("b").alias("label"))
        seen = now


def _labelled(rows: DataFrame, percent: int, neighbours: int) -> DataFrame:
    """doc_id, n, node, label, component of rows of doc_id (long), text and node, a hash of the text.

    ``label`` tells the components apart and ``component`` is the least doc_id of each; both are null without doc_id or shingles.
    """
    sketched = cut(rows.mapInArrow(_sketch, "doc_id long, n long, digest binary, sketch binary, node long"))
    classes = sketched.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("node").alias("node"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch"))
    bands = classes.select(F.col("node").alias("doc_id"), "n", "sketch").mapInArrow(_bands, "bucket long, doc long, n long, place long")
    # counted before the shuffle, and joined, so that a hot bucket is nowhere in one task
    buckets = cut(bands.join(bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "bucket"))
    members = buckets.select("doc").distinct()
    sets = cut(rows.select(F.col("node").alias("doc"), "text").join(members, "doc", "left_semi").dropDuplicates(["doc"]).mapInArrow(_sets, "doc long, hashes binary"))

    full = _pairs(buckets, percent, neighbours).join(sets.toDF("a", "ha"), "a").join(sets.toDF("b", "hb"), "b")
    links = cut(full.mapInArrow(_confirm(percent), "a long, b long, linked boolean").where("linked").select("a", "b"))
    labels = components(links)
    more = cut(_remaining_links(buckets, labels, sets, percent, neighbours))
    if not more.isEmpty():
        labels = components(labels.select(F.col("doc").alias("a"), F.col("label").alias("b")).union(more))
    labelled = classes.select("digest", "rep", "node").join(labels.withColumnRenamed("doc", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    found = labelled.select("digest", "label").join(labelled.groupBy("label").agg(F.min("rep").alias("component")), "label")
    mine = F.col("doc_id").isNotNull()
    return sketched.select("doc_id", "n", "digest", "node").join(found, "digest", "left").select("doc_id", "n", "node", *(F.when(mine, F.col(c)).alias(c) for c in ("label", "component")))


def near_duplicates(df: DataFrame, percent: int = 75, key: str = "doc_id", text: str = "text", neighbours: int = 3) -> DataFrame:
    """key, n_shingles, component_id (least key reachable over links), kept (key = component_id).

    Two documents are linked when 100 * common >= percent * union of their 5-word shingle sets.  Null, empty
    and blank texts have no shingles and stay alone; so do rows with a null key, whose component is null and
    which are kept.  Links are between texts: of a key with several, each row has the component of its own.  Keys must
    be integers; texts count whole, other columns are ignored, and an empty table gives no rows.
    """
    rows = pick(df, key, text).toDF("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = _labelled(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("node")), percent, neighbours)
    return found.select(
        F.col("doc_id").cast(kind).alias(key),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").cast(kind).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def keep_one(df: DataFrame, percent: int = 75, neighbours: int = 3) -> DataFrame:
    """The rows of ``df``, all columns, with one row of each component of near_duplicates(): that of its least doc_id.

    Of several texts of that doc_id the one with the least hash stays, and of rows with the same doc_id and text the least in
    all columns.  Rows without doc_id or shingles all stay.  Further columns may repeat names, and an empty table stays empty.
    """
    columns = by_place(df).columns
    key, text = (F.col(f"_c{df.columns.index(c)}") for c in ("doc_id", "text"))
    rows = by_place(df).withColumns({"doc_id": key.cast("long"), "node": F.xxhash64(text)})
    grouped = key.isNotNull() & F.coalesce(F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    found = _labelled(rows.select("doc_id", text.alias("text"), "node"), percent, neighbours)
    keepers = found.where("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "node")).alias("x")).select("x.doc_id", "x.node").distinct()
    one = rows.where(grouped).join(keepers, ["doc_id", "node"], "left_semi").groupBy("doc_id", "node").agg(F.min(F.struct(*columns)).alias("x"))
    return one.select("x.*").union(rows.where(~grouped).select(*columns)).toDF(*df.columns)
