"""Nearest rows by cells and bounds, against all distances."""

from __future__ import annotations

import numpy as np
import pytest

from trackloom.operators import neighbours


def frame(spark, ids, x, parts=3):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, vec array<double>").repartition(parts)


def clustered(n, dims, seed):
    """Clusters of several sizes, one of copies that holds a third, and points far from all."""
    r = np.random.default_rng(seed)
    x = r.normal(0, 10, (9, dims))[r.integers(0, 9, n)] + r.normal(0, 0.5, (n, dims))
    x[: n // 3] = x[0]
    x[-3:] *= 100
    return np.round(x, 1)


@pytest.mark.parametrize(("pivots", "chunk"), [(None, 4096), (1, 50), (7, 4096), (20, 16), (400, 64)])
@pytest.mark.parametrize("dims", [2, 17])
def test_nearest_equal_all_distances(spark, pivots, chunk, dims):
    x, ids = clustered(300, dims, dims), np.random.default_rng(0).permutation(1000)[:300] - 200
    q = np.concatenate([x[::5], clustered(40, dims, 99)])
    names = np.arange(len(q)) * 3
    k = 8
    got = {}
    for r in neighbours.nearest(frame(spark, ids, x), frame(spark, names, q), k, pivots, chunk).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["distance"], r["id"]))
    assert set(got) == set(names.tolist())
    for name, v in zip(names.tolist(), q, strict=True):
        d = ((x - v) ** 2).sum(axis=1)
        want = sorted(zip(d.tolist(), ids.tolist(), strict=True))[:k]
        assert [(i, y) for _, i, y in sorted(got[name])] == [(pytest.approx(a, rel=1e-12, abs=1e-12), b) for a, b in want]


def test_bounds_leave_most_cells_out(spark, monkeypatch):
    """In a plane with many clusters, a query meets few of the rows."""
    met = []
    pairs = neighbours._pairs
    monkeypatch.setattr(neighbours, "_pairs", lambda rows, asked, k, chunk: met.append(asked.count()) or pairs(rows, asked, k, chunk))
    r = np.random.default_rng(5)
    x = r.normal(0, 100, (60, 2)).repeat(30, axis=0) + r.normal(0, 0.1, (1800, 2))
    out = neighbours.nearest(frame(spark, np.arange(1800), x), frame(spark, np.arange(1800), x), 5, 40)
    assert out.count() == 9000 and met[0] == 1800 and met[1] < 1800 * 39 / 4


def test_few_rows_and_none(spark):
    x = np.arange(6.0).reshape(3, 2)
    few = neighbours.nearest(frame(spark, [1, 2, 3], x), frame(spark, [7], x[:1]), 15, 2)
    assert [(r["id"], r["rank"]) for r in few.orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3)]
    none = spark.createDataFrame([], "id long, vec array<double>")
    for rows, queries in ((none, frame(spark, [1], x[:1])), (frame(spark, [1], x[:1]), none), (none, none)):
        assert neighbours.nearest(rows, queries).collect() == []
