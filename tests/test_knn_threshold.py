"""Two-round search: the rows of one round, fewer candidates."""

import numpy as np
import pytest

from labelrank.operators.knn import knn_exact
from labelrank.operators.knn_threshold import knn_threshold, threshold_candidates


def vectors(spark, n, name, seed, whole=False, dim=16):
    rng = np.random.default_rng(seed)
    m = rng.integers(-2, 3, (n, dim)).astype(float) if whole else rng.normal(size=(n, dim))
    return spark.createDataFrame([(i, list(map(float, v)), "x") for i, v in enumerate(m)],
                                 f"{name} long, embedding array<double>, score string"), m


def rows(df):
    return sorted((r.qid, r["rank"], r.pid, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("k,blocks,whole", [(10, 6, False), (10, 6, True), (2000, 8, False), (2000, 8, True), (7000, 4, False)])
def test_same_rows_as_one_round(spark, k, blocks, whole):
    q, _ = vectors(spark, 20, "qid", 1, whole)
    p, _ = vectors(spark, 6000, "pid", 2, whole)
    got = knn_threshold(q, p, k, passage_blocks=blocks)
    assert rows(got) == rows(knn_exact(q, p, k))


@pytest.mark.parametrize("k", [100, 2000])
def test_few_candidates_travel(spark, k):
    q, qm = vectors(spark, 20, "qid", 3)
    p, pm = vectors(spark, 8000, "pid", 4)
    found = threshold_candidates(q, p, k, passage_blocks=8)
    n = found.count()
    assert 20 * k <= n <= 1.2 * 20 * k  # one round sends up to 20 * 8 * min(k, 1000)
    kth = np.sort(qm @ pm.T, axis=1)[:, -k]
    low = {r[0]: r[1] for r in found.groupBy("qid").min("score").collect()}
    assert all(low[i] <= kth[i] + 1e-12 for i in range(20))


def test_a_block_with_all_the_best(spark):
    """A bound from one block's few scores is low; nothing is lost."""
    p, pm = vectors(spark, 3000, "pid", 5)
    q, _ = vectors(spark, 5, "qid", 6)
    assert rows(knn_threshold(q, p, 300, passage_blocks=5, probe=1)) == rows(knn_exact(q, p, 300))


def test_passages_are_shuffled_once(spark):
    q, _ = vectors(spark, 5, "qid", 7)
    p, _ = vectors(spark, 500, "pid", 8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = threshold_candidates(q, p, 10, passage_blocks=4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "ReusedExchange" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_empty_and_unsound(spark):
    q, _ = vectors(spark, 5, "qid", 7)
    p, _ = vectors(spark, 5, "pid", 8)
    assert knn_threshold(q, p.limit(0), 3).collect() == [] == knn_threshold(q.limit(0), p, 3).collect()
    assert knn_threshold(q, p, 9).count() == 25
    bad = spark.createDataFrame([(1, None)], "pid long, embedding array<double>")
    with pytest.raises(Exception, match="null or"):
        knn_threshold(q, p.select("pid", "embedding").unionByName(bad), 3).collect()
    zero = spark.createDataFrame([(i, [0.0] * 16) for i in range(9)], "pid long, embedding array<double>")
    assert [r[:3] for r in rows(knn_threshold(q.limit(1), zero, 3, passage_blocks=3))] == [(0, 1, 0), (0, 2, 1), (0, 3, 2)]
