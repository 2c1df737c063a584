"""Centroid clustering of integer vectors, with adaptive distance bounds that save exact distances.

Each vector carries, from round to round, an upper bound of the distance to its centroid, the next nearest centroids in order with a lower bound for each,
and one lower bound for all others.  Centroids that move by d change bounds by at most d.  A vector whose upper bound is under its first lower
bound stays where it is; one that is under its z-th measures its own centroid and those before the z-th alone; one that isn't under the bound
of all others measures all.  Distances are integers and exact; bounds are doubles with a margin, and equal distances are never told apart by them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick

#: Components must be under this; squared distances of 64 of them then fit 64 bits.
TOO_LARGE = 1 << 27
#: What bounds lose to rounding, many times over.
_MARGIN = 1e-9
#: Rows that are measured at once.
_ROWS = 2048

STATE = "cluster int, upper double, near array<int>, low array<double>, rest double, asked int, measured long"


def integer_vectors(rows: DataFrame, dimensions: int = 64, scale: int = 256) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component, of the vectors that have exactly ``dimensions`` finite components.

    Others, null ones among them, are left out.  Components of 2^27 or more after scaling fail the job, since distances wouldn't fit.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = pick(rows, "vec_id", "embedding").where((F.size("embedding") == dimensions) & F.forall("embedding", lambda x: F.coalesce(finite(x.cast("double")), F.lit(False))))
    whole = lambda x: F.floor(scale * x.cast("double"))
    fits = lambda x: F.when(F.abs(whole(x)) < TOO_LARGE, whole(x).cast("int")).otherwise(F.raise_error(F.lit("a component is too large")).cast("int"))
    return kept.select("vec_id", F.transform("embedding", fits).alias("v"))


def first_by_hash(vectors: DataFrame, k: int, prefix: str) -> list[list[int]]:
    """The k vectors with the least SHA-256 of prefix and vec_id, null ids last, equal hashes by components."""
    digest = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256)
    return [list(r["v"]) for r in vectors.select("v", digest.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to each row of c, by a product of doubles where these hold all integers that arise."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if x.shape[1] * most * most * 4 < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], 1)


@dataclass
class Bounds:
    """What vectors carry: arrays with a row for each."""

    cluster: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    low: np.ndarray
    rest: np.ndarray

    @classmethod
    def none(cls, n: int, b: int) -> Bounds:
        """Bounds that certify nothing."""
        return cls(np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, b), np.int64), np.zeros((n, b)), np.zeros(n))

    def narrowed(self, b: int) -> Bounds:
        """With b lower bounds; those left out join the others' bound."""
        if self.low.shape[1] > b:
            self.rest = np.minimum(self.rest, self.low[:, b:].min(1))
            self.near, self.low = self.near[:, :b], self.low[:, :b]
        return self


def assign(x: np.ndarray, c: np.ndarray, moved: np.ndarray, state: Bounds) -> tuple[np.ndarray, np.ndarray]:
    """Brings ``state`` to the centroids c, each of which moved by at most ``moved`` since: the nearest, of equal ones that with the smaller number.

    Gives how many bounds each vector had to pass (0 none, b + 1 all), and how many distances were measured for it.
    """
    n, b = state.near.shape
    every = np.arange(len(c))
    state.upper = state.upper + moved[state.cluster]
    state.low = state.low - moved[state.near]
    state.rest = state.rest - moved.max(initial=0.0)
    ordered = np.minimum.accumulate(np.column_stack((state.low, state.rest))[:, ::-1], axis=1)[:, ::-1]
    passed = lambda rows: (ordered[rows] <= (state.upper[rows] * (1 + _MARGIN) + _MARGIN)[:, None]).sum(1)  # noqa: E731  ordered grows along a row
    asked, measured = passed(slice(None)), np.zeros(n, np.int64)
    tighten = np.flatnonzero((asked > 0) & np.isfinite(state.upper))
    state.upper[tighten] = np.sqrt(((x[tighten] - c[state.cluster[tighten]]) ** 2).sum(1))
    measured[tighten] += 1
    asked[tighten] = passed(tighten)
    for z in range(1, b + 1):
        rows = np.flatnonzero(asked == z)
        if not len(rows):
            continue
        among = np.sort(np.column_stack((state.cluster[rows], state.near[rows, :z])), axis=1)  # by number, so that a stable sort keeps the smaller first
        d = ((x[rows, None, :] - c[among]) ** 2).sum(2)
        order = np.argsort(d, axis=1, kind="stable")
        among, d = np.take_along_axis(among, order, 1), np.take_along_axis(d, order, 1)
        state.cluster[rows], state.upper[rows] = among[:, 0], np.sqrt(d[:, 0])
        state.near[rows, :z], state.low[rows, :z] = among[:, 1:], np.sqrt(d[:, 1:])
        measured[rows] += z
    rows = np.flatnonzero(asked > b)
    if len(rows):
        d = squared_distances(x[rows], c)
        order = np.argsort(d, axis=1, kind="stable")
        d = np.sqrt(np.take_along_axis(d, order, 1))
        state.cluster[rows], state.upper[rows] = every[order[:, 0]], d[:, 0]
        has = min(b, len(c) - 1)
        state.near[rows, :has], state.low[rows, :has], state.low[rows, has:] = order[:, 1 : has + 1], d[:, 1 : has + 1], np.inf
        state.rest[rows] = d[:, has + 1] if len(c) > has + 1 else np.inf
        measured[rows] += len(c)
    return asked, measured


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, b = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * b, pa.int32()), pa.array(values.ravel(), kind))


def _step(c: np.ndarray, moved: np.ndarray | None, b: int):
    """A task's part of a round; without ``moved`` the rows have no bounds yet."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(i, _ROWS)
                column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)  # noqa: E731,B023
                table = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)  # noqa: E731,B023
                x = table("v").astype(np.int64)
                state = Bounds.none(len(x), b) if moved is None else Bounds(column("cluster").astype(np.int64), column("upper").copy(), table("near").astype(np.int64), table("low").copy(), column("rest").copy()).narrowed(b)
                asked, measured = assign(x, c, np.zeros(len(c)) if moved is None else moved, state)
                found = [pa.array(state.cluster, pa.int32()), pa.array(state.upper), _lists(state.near, pa.int32()), _lists(state.low, pa.float64()), pa.array(state.rest), pa.array(asked, pa.int32()), pa.array(measured)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), *found], ["vec_id", "v", "cluster", "upper", "near", "low", "rest", "asked", "measured"])

    return step


@dataclass
class Clustering:
    """vectors: vec_id, v, cluster and bounds; centroids by number; measured: how many distances each round took, of n times k."""

    vectors: DataFrame
    centroids: list[list[int]]
    measured: list[int]


def cluster(vectors: DataFrame, centroids: list[list[int]], rounds: int = 5) -> Clustering:
    """``rounds`` times: each vector goes to its nearest centroid, and non-empty centroids to the floor of their vectors' mean; then vectors go once more.

    The number of lower bounds starts at a quarter of the centroids and falls to what vectors had to pass in a round, but not under an eighth.
    Between rounds only counts and sums by centroid reach the driver.  Repeated vectors and ids count row by row; with no vectors, or no centroids, no rows are left.
    """
    k = len(centroids)
    if not k:
        return Clustering(vectors.where("false").selectExpr("*", *[f"cast(null as {x.split(' ', 1)[1]}) as {x.split(' ', 1)[0]}" for x in STATE.split(", ")]), [], [])
    c, b, moved, measured = np.array(centroids, np.int64), max(1, k // 4), None, []
    state, id_type = vectors, vectors.schema["vec_id"].dataType.simpleString()
    for nth in range(rounds + 1):
        state = cut(state.mapInArrow(_step(c, moved, b), f"vec_id {id_type}, v array<int>, {STATE}"))
        sums = [F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(c.shape[1])] if nth < rounds else []
        found = state.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("measured").alias("measured"), F.max(F.when(F.col("asked") <= b, F.col("asked"))).alias("asked"), *sums).collect()
        measured.append(sum(r["measured"] for r in found))
        if nth == rounds:
            break
        new = c.copy()
        for r in found:
            new[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(c.shape[1])]
        moved = np.array([math.sqrt(sum((int(p) - int(q)) ** 2 for p, q in zip(x, y, strict=True))) * (1 + _MARGIN) for x, y in zip(c, new, strict=True)])
        c = new
        if nth:
            b = min(b, max(1, k // 8, *(r["asked"] or 0 for r in found)))
    return Clustering(state, c.tolist(), measured)


def with_distance(found: Clustering) -> DataFrame:
    """vec_id, cluster, distance: the exact squared distance to the vector's centroid."""
    c = np.array(found.centroids, np.int64)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column("cluster").to_numpy()
            x = batch.column("v").flatten().to_numpy().astype(np.int64).reshape(len(mine), -1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(((x - c[mine]) ** 2).sum(1))], ["vec_id", "cluster", "distance"])

    id_type = found.vectors.schema["vec_id"].dataType.simpleString()
    return found.vectors.select("vec_id", "v", "cluster").mapInArrow(measure, f"vec_id {id_type}, cluster int, distance long")
