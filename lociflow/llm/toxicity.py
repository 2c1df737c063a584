"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

n-grams of the lower-cased UTF-8 text are hashed into a fixed number of buckets.  Each bucket's presence is
scaled by the log ratio of its document counts in the two classes, and a logistic regression is fitted on the
scaled features.  Fitting uses a bounded, balanced sample of the labelled rows; scoring covers every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_place, pick

BITS = 20
ORDERS = (4, 5, 6)
_BLANK = bytes(0x20 if i < 0x20 else i for i in range(256))


def grams(text: str | None) -> np.ndarray:
    """The bucket of each n-gram of a text, with repeats."""
    data = np.frombuffer(b" " + (text or "").lower().encode("utf-8", "replace").translate(_BLANK) + b" ", np.uint8).astype(np.uint32)
    h, out = data, []
    for n in range(2, max(ORDERS) + 1):
        if len(h) < 2:
            break
        h = h[:-1] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(n)
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out.append((mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = np.zeros((2, 1 << BITS), np.int64)
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[toxic, np.unique(grams(text))] += 1
        at = np.flatnonzero(counts.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[0, at]), pa.array(counts[1, at])], ["bucket", "clean", "toxic"])


def _features(kept: np.ndarray):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[kept] = np.arange(len(kept))
        for batch in batches:
            found = [np.unique(place[grams(t)]) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[x >= 0] for x in found], pa.list_(pa.int32()))], ["toxic", "at"])

    return features


def _scorer(weights: np.ndarray, bias: float):
    kept = np.flatnonzero(weights)
    values = weights[kept]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << BITS, np.float32)
        weights[kept] = values
        for batch in batches:
            sums = np.full(batch.num_rows, bias)
            for i, text in enumerate(batch.column(1).to_pylist()):
                at = grams(text)
                sums[i] += weights[np.unique(at[weights[at] != 0])].sum(dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(sums, -500, 500))))], ["doc_id", "score"])

    return score


class Indicators:
    """A sparse matrix of zeros and ones: for each row the columns that are one."""

    def __init__(self, rows: list[np.ndarray], width: int) -> None:
        self.rows, self.width = rows, width
        self.columns = np.concatenate(rows).astype(np.int32) if rows else np.empty(0, np.int32)
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)])

    def times(self, values: np.ndarray) -> np.ndarray:
        """The sum of the values of each row's columns."""
        sums = np.concatenate([[0.0], np.cumsum(values[self.columns])])
        return sums[self.ends[1:]] - sums[self.ends[:-1]]

    def summed(self, values: np.ndarray) -> np.ndarray:
        """For each column, the sum of the values of the rows that have it."""
        return np.bincount(self.columns, weights=np.repeat(values, self.sizes), minlength=self.width)

    def where(self, keep: np.ndarray) -> Indicators:
        return Indicators([self.rows[i] for i in np.flatnonzero(keep)], self.width)


def logistic(has: Indicators, y: np.ndarray, scale: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on indicators times ``scale``; classes weigh the same."""
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b, m, v = np.zeros(len(scale)), 0.0, np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    for step in range(1, steps + 1):
        z = has.times(scale * w) + b
        error = share * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        g = np.append(scale * has.summed(error) + penalty * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def log_ratios(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, least_count: int, least_z: float) -> np.ndarray:
    """Naive Bayes log-count ratio of each bucket from the documents of each class that have it.

    0 for buckets that are rare, or whose toxic documents are within ``least_z`` standard deviations of what chance would give.
    """
    ratio = np.log((toxic + 1) / (n_toxic + 2)) - np.log((clean + 1) / (n_clean + 2))
    n, share = clean + toxic, n_toxic / (n_toxic + n_clean)
    z = (toxic - n * share) / np.sqrt(n * share * (1 - share) + 1e-9)
    return np.where((n >= least_count) & (np.abs(z) >= least_z), ratio, 0.0)


def best_cut(logits: np.ndarray, y: np.ndarray, clean_weight: float, beta: float = 1.0) -> float | None:
    """The logit from which on calling a text toxic gives the largest F score, where a clean text stands for ``clean_weight`` of them.

    With a ``beta`` under 1 it matters more that what is called toxic is so.  At least half of it must be; None if no cut gives that.
    """
    order = np.argsort(-logits, kind="stable")
    hit, false = np.cumsum(y[order]), np.cumsum(1 - y[order]) * clean_weight
    f = (1 + beta**2) * hit / (hit + false + beta**2 * y.sum())
    last = np.append(logits[order][:-1] != logits[order][1:], True)  # equal logits are on one side
    f = np.where(last & (hit >= false), f, -1)
    best = int(np.argmax(f))
    if f[best] <= 0:
        return None
    return float(logits[order][best] + logits[order][min(best + 1, len(order) - 1)]) / 2


def _out_of_fold(has: Indicators, y: np.ndarray, fold: np.ndarray, least_count: int, least_z: float, penalty: float, steps: int) -> np.ndarray | None:
    """The logit of each row from a model that has not seen its fold; None if a fold leaves one class only."""
    logits = np.zeros(len(y))
    for f in np.unique(fold):
        seen, known = has.where(fold != f), y[fold != f]
        n_toxic, n_clean = int(known.sum()), int((1 - known).sum())
        if not n_toxic or not n_clean:
            return None
        scale = log_ratios(seen.summed(known), seen.summed(1 - known), n_toxic, n_clean, least_count, least_z)
        w, b = logistic(seen, known, scale, penalty, steps)
        logits[fold == f] = has.where(fold == f).times(w * scale) + b
    return logits


#: Values of beta among which the cut's is chosen.
BETAS = (1.0, 0.85, 0.7, 0.5)


def nested_cut(logits: np.ndarray, y: np.ndarray, fold: np.ndarray, clean_weight: float) -> float | None:
    """best_cut() for the beta whose cuts, each made without a fold and tried on it, agree best with the labels, by Matthews' correlation."""

    def agreement(beta: float) -> float | None:
        called = np.zeros(len(y), bool)
        for f in np.unique(fold):
            cut = best_cut(logits[fold != f], y[fold != f], clean_weight, beta)
            if cut is None:
                return None
            called[fold == f] = logits[fold == f] >= cut
        hit, missed = float((called & (y == 1)).sum()), float((~called & (y == 1)).sum())
        false, true = clean_weight * float((called & (y == 0)).sum()), clean_weight * float((~called & (y == 0)).sum())
        return (hit * true - false * missed) / max(np.sqrt((hit + false) * (hit + missed) * (true + false) * (true + missed)), 1e-9)

    found = {beta: agreement(beta) for beta in BETAS}
    if None in found.values():
        return None
    return best_cut(logits, y, clean_weight, max(BETAS, key=found.__getitem__))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 2500, least_count: int = 5, least_z: float = 3.0, penalty: float = 2e-3, steps: int = 300, limit: float = 0.7) -> tuple[np.ndarray, float]:
    """A weight per bucket, and the bias.

    ``labels`` has doc_id and toxic (0 or 1; other values and nulls are left out; of a repeated doc_id the
    larger).  At most ``sample_rows`` rows of each class are used, picked by a hash of doc_id.  Buckets seen in
    fewer than ``least_count`` of these documents get no weight, nor do those in toxic ones about as often as by chance (``least_z``
    standard deviations); there is no cap on how many have one.  The bias is moved so that a score of ``limit`` is where rows of the sample that are kept
    out of the fit are told apart best (nested_cut); no other rows have a part in it.  With one class or none the
    weights are 0 and the bias gives the smoothed share of toxic rows.
    """
    known = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("toxic = 0").orderBy(*by_hash).limit(sample_rows).union(known.where("toxic = 1").orderBy(*by_hash).limit(sample_rows))
    texts = pick(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").select("toxic", "text")  # 2 * sample_rows rows at most
    counts = texts.mapInArrow(_count, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    bucket, clean, toxic = (counts[c].to_numpy() for c in ("bucket", "clean", "toxic"))
    weights = np.zeros(1 << BITS, np.float32)
    n, labelled = np.zeros(2), np.ones(2)
    for r in texts.groupBy("toxic").count().collect():
        n[r["toxic"]] = r["count"]
    for r in known.groupBy("toxic").count().collect():
        labelled[r["toxic"]] = r["count"]
    if not n.all():
        return weights, float(np.log((n[1] + 1) / (n[0] + 1)))
    ratio = log_ratios(toxic, clean, n[1], n[0], least_count, least_z)
    kept = np.flatnonzero(ratio)
    order = kept[np.argsort(bucket[kept])]
    kept, ratio = bucket[order], ratio[order]
    found = texts.mapInArrow(_features(kept), "toxic int, at array<int>").toArrow()
    y = found["toxic"].to_numpy()
    rows = [np.asarray(x.values, np.int64) for x in found["at"]]
    has, fold = Indicators(rows, len(kept)), np.array([(int(r.sum()) + len(r)) % 3 for r in rows])  # equal rows share a fold
    w, b = logistic(has, y, ratio, penalty, steps)
    logits = _out_of_fold(has, y, fold, least_count, least_z, penalty, steps)
    cut = nested_cut(logits, y, fold, labelled[0] / n[0] / (labelled[1] / n[1])) if logits is not None else None
    if cut is not None:
        b += np.log(limit / (1 - limit)) - cut
    weights[kept] = w * ratio
    return weights, float(b)


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id, score in 0 to 1, one row per input row.

    A null or empty text has the features of a blank; texts are scored whole, whatever their length.  doc_id may be null or
    repeat, other columns are ignored, and an empty table gives no rows.
    """
    rows = pick(docs, "doc_id", "text")
    return rows.mapInArrow(_scorer(weights, bias), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels that learning may see: the checksum of doc_id as text leaves a remainder other than 1 by 3."""
    return pick(labels, "doc_id", "toxic").where(~F.coalesce(held_out(), F.lit(False)))


def _keeper(weights: np.ndarray, bias: float, limit: float, at: int):
    one = _scorer(weights, bias)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], ["doc_id", "text"])
            scores = next(one(iter([pair]))).column("score").to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(scores < limit))

    return keep


def keep_clean(docs: DataFrame, weights: np.ndarray, bias: float, limit: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose (first) text column scores under ``limit``; no shuffle.

    Further columns may repeat names; rows that repeat are judged alike, and an empty table stays empty.
    """
    rows = by_place(docs)
    return rows.mapInArrow(_keeper(weights, bias, limit, docs.columns.index("text")), rows.schema).toDF(*docs.columns)
