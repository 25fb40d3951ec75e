"""Blocks of the search: the running top-k against brute force, and the bytes that a block needs."""

import numpy as np
import pyarrow as pa
import pytest

from labelrank.operators.knn import (SMALL_BLOCK, _room, knn_exact, matrix, passage_block_rows, query_block_rows, running_top,
                                     sorted_block)


def brute(qm, pm, k, floor=None):
    s = qm @ pm.T
    out = []
    for i, row in enumerate(s):
        order = np.lexsort((np.arange(len(row)), -row))[:k]
        out.append([(int(j), row[j]) for j in order if floor is None or row[j] >= floor[i]])
    return out


@pytest.mark.parametrize("k,n", [(1, 1), (3, 900), (10, 2500), (700, 3000), (3000, 3000), (5000, 40)])
@pytest.mark.parametrize("floored", [False, True])
def test_running_top_is_brute_force_with_ties(k, n, floored):
    rng = np.random.default_rng(k + n)
    qm, pm = (rng.integers(-2, 3, (m, 6)).astype(float) for m in (13, n))
    floor = rng.integers(-3, 9, 13).astype(float) if floored else None
    best, at, count = running_top(qm, pm, k, 1 << 12, floor)
    got = [sorted(zip(at[i, :c].tolist(), best[i, :c].tolist())) for i, c in enumerate(count)]
    assert got == [sorted(r) for r in brute(qm, pm, k, floor)]


@pytest.mark.parametrize("k,dim", [(10, 64), (1000, 64), (1000, 768), (2000, 64)])
def test_blocks_keep_to_their_bytes(k, dim):
    """What a task holds follows the budget, not the number of queries: their vectors, the running best, the rows found."""
    rows = query_block_rows(k, dim, 192 << 20)
    assert rows * (8 * dim + 12 * (k + _room(k)) + 24 * k) <= 192 << 20
    assert passage_block_rows(k, dim, 176 << 20) * 4 * dim <= 176 << 20
    assert passage_block_rows(SMALL_BLOCK, dim, 1 << 30) <= SMALL_BLOCK


def test_vectors_of_two_lengths_fail():
    block = pa.table({"__p": [1, 2], "__pv": [[1.0, 2.0], [1.0]]})
    with pytest.raises(ValueError, match="1 and 2"):
        sorted_block(block)
    assert matrix(pa.chunked_array([[[1.0], [2.0]], [[3.0]]]), np.array([2, 0, 1])).tolist() == [[2.0], [3.0], [1.0]]


def test_many_queries_take_several_blocks(spark):
    """A run of 1000 hits a query is not made by blocks of as many queries as their vectors leave room for."""
    rng = np.random.default_rng(3)
    m = rng.integers(-3, 4, (300, 4)).astype(float)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "qid long, embedding array<float>")
    got = knn_exact(v, v.withColumnRenamed("qid", "pid"), 40, work_bytes=1 << 16, min_tasks=1).collect()
    want = brute(m, m, 40)
    assert sorted((r.qid, r["rank"], r.pid, r.score) for r in got) == sorted(
        (i, j + 1, p, s) for i, row in enumerate(want) for j, (p, s) in enumerate(row))
