"""Exact search against brute force."""

import numpy as np
import pytest

from labelrank.llm import knn_join as J


def frame(spark, vectors):
    return J.scaled_vectors(spark.createDataFrame(
        [(i, v, "c") for i, v in vectors], "vec_id long, embedding array<float>, cell string"))


def brute(vectors, k, pick=lambda i: i % 50 == 0):
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(int)) for i, v in vectors
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for qi, q in ok:
        if pick(qi):
            s = sorted(((-int(q @ x), i) for i, x in ok if i != qi))[:k]
            out += [(qi, r + 1, i, -v) for r, (v, i) in enumerate(s)]
    return sorted(out)


def run(spark, vectors, k=5, **opts):
    df = frame(spark, vectors)
    return sorted(map(tuple, J.voronoi_knn_join(df.filter("id % 50 = 0"), df, k, **opts).collect()))


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_clusters(spark, monkeypatch, spread):
    monkeypatch.setattr(J, "GROUP", 4)
    monkeypatch.setattr(J, "BLOCK", 40)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 6)) * 2
    vectors = [(i, (centres[i % 8] + spread * rng.normal(size=6)).tolist()) for i in range(700)]
    vectors += [(700 + i, centres[0].tolist()) for i in range(300)]  # a third are one vector: ties
    assert run(spark, vectors, pivots=12) == brute(vectors, 5)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 0.0]), (4, [None, 1.0]), (None, [1.0, 1.0]),
               (50, [-1.0, -0.001]), (51, []), (52, [0.0, 0.0])]
    assert run(spark, vectors) == brute(vectors, 5)
    assert run(spark, []) == [] and run(spark, [(0, [1.0])]) == []


def test_bounds_are_safe():
    rng = np.random.default_rng(4)
    x, pivots = np.floor(rng.normal(size=(500, 5)) * 50), np.floor(rng.normal(size=(9, 5)) * 50)
    cell, far = J._cells(x, pivots)
    count = np.bincount(cell, minlength=9).astype(float)
    radius = np.array([far[cell == c].max(initial=0) for c in range(9)])
    norm = np.array([np.sqrt((x[cell == c] ** 2).sum(1)).max(initial=0) for c in range(9)])
    use = J.needed(x[:50], pivots, count, radius, norm, 5)
    for i in range(50):
        best = np.argsort(-(x @ x[i]), kind="stable")[:6]
        assert use[i, cell[best]].all()
    tight = J.needed(x[:50] * 100, pivots, count, radius * 0, norm, 1)
    assert not tight.all()


def test_repeated_ids(spark):
    """Eight rows of the query's id lie in the best cell and are left out; the k best lie in others."""
    best = [(0, [100.0, 0.0])] * 8
    others = [(1 + i, [50.0 - i, 30.0 * (-1) ** i]) for i in range(12)] + [(100 + i, [-90.0, float(i)]) for i in range(30)]
    df = frame(spark, best + others)
    query = frame(spark, best[:1])
    want = [w for w in dict.fromkeys(brute(best + others, 5, pick=lambda i: i == 0)) if w[0] == 0]
    for pivots in (8, 20, 40):
        assert sorted(map(tuple, J.voronoi_knn_join(query, df, 5, pivots=pivots).collect())) == want
