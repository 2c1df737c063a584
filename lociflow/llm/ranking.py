"""Ranked lexical search: compressed postings per shard, merged document at a time.

An index is a table of shards.  A shard holds some megabytes of documents in the order of doc_id; it has one row of its
documents' ids and lengths, and one row per term with the places of the documents that hold it and how often they do, as
varints.  A search joins the rows of the queries' terms, and each shard is then merged for a block of queries: a heap of
the lists' next places gives the documents in order, and a bounded heap keeps the best of them.  The best of all shards
are merged last.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, pick, shared_dir

#: Bytes as terms have them: A-Z in lower case, 0-9, a-z and all of other characters stay, the rest separates.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

INDEX = "shard long, term string, n_docs long, n_terms long, postings binary"
#: Queries that one task ranks together, and shards that share a key of the join by terms where these are too many to broadcast.
BLOCK, SHARDS_PER_KEY = 256, 64
#: Tasks of a search at most; beyond, a task merges several shards, one after the other.
MOST_PARTS = 20_000


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers as varints, seven bits a byte, lowest first: the bytes, and where each number ends."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << 7 * k)
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[ends[has] - size[has] + k] = (values[has] >> np.uint64(7 * k) & np.uint64(127)) | np.where(size[has] > k + 1, np.uint64(128), np.uint64(0))
    return out, ends


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128) + 1
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    size, values = ends - starts, np.zeros(len(ends), np.uint64)
    for k in range(int(size.max(initial=0))):
        has = size > k
        values[has] |= (raw[starts[has] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return values


class _Shard:
    """Documents as they arrive, until there are enough for a shard."""

    def __init__(self) -> None:
        self.bytes = 0
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.places: list[int] = []  # of the documents, for each posting
        self.terms: list[int] = []
        self.times: list[int] = []
        self.vocabulary: defaultdict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        words = terms_of(text)
        self.bytes += len(text or b"") + 64
        if not words:
            return
        counts = Counter(words)
        self.places += [len(self.ids)] * len(counts)
        self.terms += map(self.vocabulary.__getitem__, counts)
        self.times += counts.values()
        self.ids.append(doc_id)
        self.lengths.append(len(words))

    def rows(self, shard: int) -> pa.RecordBatch:
        """The documents' row first, then the terms' in their order."""
        null = np.array([x is None for x in self.ids])
        ids = np.array([x or 0 for x in self.ids], np.int64)
        order = np.lexsort((ids, ~null))  # null ids first
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        n_null, known = int(null.sum()), ids[order][int(null.sum()) :]
        first = known[:1].astype(np.uint64) << np.uint64(1) ^ (known[:1] >> 63).astype(np.uint64)  # signed, so that the sign is the lowest bit
        gaps = known[1:].astype(np.uint64) - known[:-1].astype(np.uint64)
        documents = pack(np.concatenate((np.array([n_null], np.uint64), first, gaps, np.array(self.lengths, np.uint64)[order])))[0]

        names = sorted(self.vocabulary)
        nth = np.empty(len(names), np.int64)
        nth[[self.vocabulary[x] for x in names]] = np.arange(len(names))
        term, at, times = nth[np.array(self.terms, np.int64)], place[np.array(self.places, np.int64)], np.array(self.times, np.int64)
        order = np.lexsort((at, term))
        term, at, times = term[order], at[order], times[order]
        stops = np.searchsorted(term, np.arange(len(names)), "right")
        starts = np.concatenate(([0], stops[:-1]))
        gap = np.diff(at, prepend=0)
        gap[starts] = at[starts]
        packed, ends = pack(np.column_stack((gap, times)).ravel())
        data = np.concatenate((documents, packed))
        offsets = np.concatenate(([0, len(documents)], len(documents) + ends[2 * stops - 1])).astype(np.int32)
        postings = pa.Array.from_buffers(pa.binary(), len(names) + 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
        n_docs, n_terms = np.concatenate(([len(self.ids)], stops - starts)), np.concatenate(([sum(self.lengths)], np.add.reduceat(times, starts)))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(names) + 1, shard)), pa.array([None, *(x.decode() for x in names)], pa.string()), pa.array(n_docs, pa.int64()), pa.array(n_terms, pa.int64()), postings], ["shard", "term", "n_docs", "n_terms", "postings"])


def build_index(docs: DataFrame, path: str, shard_bytes: int = 16 << 20) -> None:
    """Writes the index of all documents as Parquet: INDEX, with a row for each shard (no term) and one for each of its terms.

    A task cuts what it reads into shards of about ``shard_bytes`` bytes of text, so nothing is shuffled.  A null text and one without terms aren't
    in it; null ids come first, and rows that repeat an id are documents of their own.  Texts are read whole, however long.  An empty table gives an
    empty index; other columns, whatever their names, aren't looked at.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard.add(doc_id, text.as_py())
                if shard.bytes >= shard_bytes:
                    if shard.ids:
                        yield shard.rows(number)
                    number, shard = number + 1, _Shard()
        if shard.ids:
            yield shard.rows(number)

    pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(index, INDEX).write.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def query_terms(queries: DataFrame) -> DataFrame:
    """item_id, term, times.  Rows that share an item_id are one query, with the terms of all."""
    rows = pick(queries, "item_id", "text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(terms_of(x.as_py())) for x in batch.column(1)]
            nth = [i for i, c in enumerate(counts) for _ in c]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(nth, pa.int64())), pa.array([t.decode() for c in counts for t in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())], ["item_id", "term", "times"])

    kind = rows.schema["item_id"].dataType.simpleString()
    found = rows.select("item_id", F.col("text").cast("binary")).mapInArrow(split, f"item_id {kind}, term string, times long")
    return found.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


Postings = tuple[list[int], list[int], int]


def best_documents(lists: list[Postings], k: int) -> list[tuple[int, int]]:
    """(score, place) of the k best documents of a shard, scores above 0, equal scores by place; each list has places, gains and the greatest gain.

    The lists are merged document at a time.  Once the k-th score is known, lists whose greatest gains together can't exceed it no longer bring
    documents up; they are only looked into for documents that others bring, and no further than these can still be among the best.
    """
    lists = sorted(lists, key=lambda x: x[2])
    bounds = list(accumulate(x[2] for x in lists))
    at, best, least, first = [0] * len(lists), [], 0, 0
    while first < len(lists) and bounds[first] <= 0:
        first += 1
    heads = [(lists[i][0][0], i) for i in range(first, len(lists))]
    heapq.heapify(heads)
    while heads:
        place, score = heads[0][0], 0
        while heads and heads[0][0] == place:
            i = heads[0][1]
            places, gains, _ = lists[i]
            score += gains[at[i]]
            at[i] += 1
            if at[i] < len(places):
                heapq.heapreplace(heads, (places[at[i]], i))
            else:
                heapq.heappop(heads)
        for i in range(first - 1, -1, -1):
            if score + bounds[i] <= least:
                break
            places, gains, _ = lists[i]
            at[i] = j = bisect_left(places, place, at[i])
            if j < len(places) and places[j] == place:
                score += gains[j]
        if score <= least:
            continue
        if len(best) < k:
            heapq.heappush(best, (score, -place))
        else:
            heapq.heapreplace(best, (score, -place))
        if len(best) == k:
            least, before = best[0][0], first
            while first < len(lists) and bounds[first] <= least:
                first += 1
            if first > before:
                heads = [x for x in heads if x[1] >= first]
                heapq.heapify(heads)
    return [(score, -place) for score, place in best]


def _ranker(n: int, length: int, k: int):
    """Ranks the documents of a shard for a block of queries, from the shard's documents and the postings of the block's terms."""

    def rank(table: pa.Table) -> pa.Table:
        terms = table.column("term").to_pylist()
        numbers = unpack(table.column("postings")[terms.index(None)].as_py())
        n_docs, n_null = table.column("n_docs")[terms.index(None)].as_py(), int(numbers[0])
        known = numbers[1 : 1 + n_docs - n_null].copy()
        if len(known):
            known[0] = known[0] >> np.uint64(1) ^ (np.uint64(0) - (known[0] & np.uint64(1)))
        ids = [None] * n_null + np.cumsum(known, dtype=np.uint64).astype(np.int64).tolist()
        lengths = numbers[1 + n_docs - n_null :].astype(np.int64)
        norm = 8 * (100 - 75 + 75 * lengths * n // length)
        lists: defaultdict[object, list[Postings]] = defaultdict(list)
        for term, data, weight, users in zip(terms, table.column("postings"), table.column("weight").to_pylist(), table.column("users"), strict=True):
            if term is None:
                continue
            pairs = unpack(data.as_py()).astype(np.int64).reshape(-1, 2)
            places, times = np.cumsum(pairs[:, 0]), pairs[:, 1]
            gains = weight * (1_000_000_000 * times // (1000 * times + norm[places]))
            places, top = places.tolist(), int(gains.max())
            each = {}
            for user in users.as_py():
                if user["times"] not in each:
                    each[user["times"]] = (gains * user["times"]).tolist()
                lists[user["item_id"]].append((places, each[user["times"]], top * user["times"]))
        rows = [(item, ids[place], score) for item, mine in lists.items() for score, place in best_documents(mine, k)]
        kind = table.schema.field("users").type.value_type.field("item_id").type
        return pa.table([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["item_id", "doc_id", "score"])

    return rank


def search(index: DataFrame, queries: DataFrame, k: int = 10, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each query, scores above 0, equal scores by doc_id, nulls first.

    Terms' weights and the lengths' share follow the contract of op13.  The queries' terms are broadcast where their measured size allows it; beyond
    that they are joined by term and a group of shards, so that a frequent term is many keys.  A query with a null text, or without terms that any
    document has, gets no rows, as do all with an empty index; rows that share an item_id, null included, are one query.
    """
    spark = index.sparkSession
    shared_dir(spark)
    documents, postings = index.where("term is null"), index.where("term is not null")
    wanted = cut(query_terms(queries))
    kind = wanted.schema["item_id"].dataType.simpleString()
    n, length, shards = documents.agg(F.sum("n_docs"), F.sum("n_terms"), F.count("*")).first()
    n_items, size = wanted.agg(F.count_distinct(F.coalesce(F.xxhash64("item_id"), F.lit(0))), F.sum(F.octet_length("term") + 24)).first()
    if not n or not n_items:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    blocks = -(-n_items // BLOCK)
    salts = -(-shards // SHARDS_PER_KEY)

    def with_terms(terms: DataFrame) -> DataFrame:
        """The postings of these terms, with their other columns."""
        if size <= broadcast_bytes:
            return postings.join(F.broadcast(terms), "term")
        salted = terms.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        return postings.withColumn("salt", F.pmod(F.hash("shard").cast("long"), F.lit(salts))).join(salted, ["term", "salt"]).drop("salt")

    n_with = with_terms(wanted.select("term").distinct()).groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1))).cast("long")
    blocked = wanted.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    users = blocked.groupBy("block", "term").agg(F.collect_list(F.struct("item_id", "times")).alias("users"))
    weighted = cut(users.join(n_with, "term").select("term", "block", weight.alias("weight"), "users"))
    hits = with_terms(weighted).select("shard", "block", "term", "n_docs", "postings", "weight", "users")
    each = documents.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    none = weighted.schema["users"].dataType
    rows = hits.union(each.select("shard", "block", "term", "n_docs", "postings", F.lit(None).cast("long"), F.lit(None).cast(none)))
    parts = min(shards * blocks, MOST_PARTS)  # stated, since merging takes far more time than its few bytes tell
    found = rows.repartition(parts, "shard", "block").groupBy("shard", "block").applyInArrow(_ranker(n, length, k), f"item_id {kind}, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
