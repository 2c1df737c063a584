"""Clustering against a plain version, the bounds that save distances, and odd rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException

from lociflow.llm import clustering, queries


def vectors(spark, rows):
    return spark.createDataFrame([(i, None, v, None, None) for i, v in rows], "vec_id long, cluster int, embedding array<float>, v int, `_c1` int")


def brute(rows, k, rounds, dimensions):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in set(of):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == j]
            c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i, *nearest(v)[::-1]) for i, v in kept), key=str), c


def run(spark, rows, k, rounds, dimensions):
    kept = clustering.integer_vectors(vectors(spark, rows), dimensions)
    found = clustering.cluster(kept, clustering.first_by_hash(kept, k, "2:"), rounds)
    return sorted(map(tuple, clustering.with_distance(found).collect()), key=str), found


def groups(n, dimensions, scale, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, dimensions)) * scale
    return [(int(i), [float(np.float32(x)) for x in middles[rng.integers(12)] + rng.normal(size=dimensions) * scale / 6]) for i in range(n)]


@pytest.mark.parametrize(("scale", "k"), [(1.0, 16), (0.002, 9), (60_000.0, 16), (1.0, 1), (1.0, 2)])
def test_by_brute_force(spark, scale, k):
    """Small scales have many equal distances, large ones need more than doubles hold."""
    rows = groups(240, 5, scale)
    rows += [rows[0]] * 80 + [(None, rows[1][1]), (None, rows[2][1]), (7, None), (8, [1.0] * 4), (9, [1.0] * 6), (10, [1.0, None, 1.0, 1.0, 1.0]), (11, [math.nan] * 5), (12, [math.inf] + [0.0] * 4), (13, [])]
    got, found = run(spark, rows, k, 5, 5)
    want, centroids = brute(rows, k, 5, 5)
    assert got == want and found.centroids == centroids


def test_bounds_save_distances(spark):
    rows = groups(3000, 8, 1.0)
    _, found = run(spark, rows, 16, 5, 8)
    assert found.measured[0] == 3000 * 16 and found.measured[-1] < 0.1 * found.measured[0] and all(x < found.measured[0] for x in found.measured[1:])


def test_assign_at_every_bound():
    """Random states with valid bounds, also tight ones, lead to the nearest centroid."""
    rng = np.random.default_rng(1)
    for _ in range(60):
        x, old = rng.integers(-6, 7, (50, 3)), rng.integers(-6, 7, (9, 3))
        state = clustering.Bounds.none(50, 3)
        clustering.assign(x, old, np.zeros(9), state)
        new = old + rng.integers(-1, 2, (9, 3)) * (rng.random((9, 1)) < 0.5)
        asked, measured = clustering.assign(x, new, np.sqrt(((new - old) ** 2).sum(1)), state)
        d = clustering.squared_distances(x, new)
        assert (state.cluster == d.argmin(1)).all() and (measured <= 10).all()
        assert (np.sqrt(d[np.arange(50), state.cluster]) <= state.upper * (1 + 1e-9)).all()


def test_few_and_no_vectors(spark):
    assert run(spark, groups(3, 4, 1.0), 40, 2, 4)[0] == brute(groups(3, 4, 1.0), 40, 2, 4)[0]
    assert run(spark, [(1, None), (2, [1.0])], 40, 2, 4)[0] == []
    with pytest.raises(PySparkException, match="too large"):
        run(spark, [(1, [1e9] * 4)], 2, 1, 4)


def test_query_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert queries.op12_clusters(spark, str(tmp_path)).count() == 0
