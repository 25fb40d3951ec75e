"""Source mixing: targets, flows against exhaustive search, selection, odd rows."""

import itertools
import random
from fractions import Fraction

import pytest

from labelrank.llm import mixing as M
from tests.llm.helpers import same_as_sql


def reshared(sizes, weights, total, most):
    """Targets as the contract tells them: cut, share the excess again, until none is above."""
    target = [Fraction(total * w, sum(weights)) for w in weights]
    while True:
        over = [i for i, t in enumerate(target) if t > most * sizes[i]]
        if not over:
            return target
        excess = sum(target[i] - most * sizes[i] for i in over)
        for i in over:
            target[i] = Fraction(most * sizes[i])
        free = [i for i, t in enumerate(target) if t < most * sizes[i]]
        parts = sum(weights[i] for i in free)
        for i in free:
            target[i] += excess * weights[i] / parts


def test_targets():
    rnd = random.Random(4)
    for _ in range(300):
        n = rnd.randrange(1, 8)
        sizes = [rnd.choice([0, 1, 5, 50, 1000]) for _ in range(n)]
        weights = [1 + i % 3 for i in range(n)]
        got = [Fraction(a, b) for a, b in M.water_level(sizes, weights, sum(sizes), 3)]
        assert got == reshared(sizes, weights, sum(sizes), 3)


def best_flow(patterns, quotas, most):
    """Largest flow and least cost by trying every split."""
    best = (0, 0)
    arcs = [(p, j) for p, (js, _) in enumerate(patterns) for j in js]
    ranges = [range(min(quotas[j], most * patterns[p][1]) + 1) for p, j in arcs]
    for x in itertools.product(*ranges):
        into, out = [0] * len(quotas), [0] * len(patterns)
        for (p, j), v in zip(arcs, x):
            into[j] += v
            out[p] += v
        if any(a > b for a, b in zip(into, quotas)) or any(v > most * s for v, (_, s) in zip(out, patterns)):
            continue
        cost = sum(max(0, min(v - r * s, s)) * (r + 1) for v, (_, s) in zip(out, patterns) for r in range(most))
        best = max(best, (sum(x), -cost))
    return best


def test_flow_is_largest_and_cheapest():
    rnd = random.Random(6)
    for _ in range(60):
        patterns = [(tuple(sorted(rnd.sample(range(3), rnd.choice([1, 1, 2])))), rnd.randrange(0, 3)) for _ in range(3)]
        quotas = [rnd.randrange(0, 5) for _ in range(3)]
        flow = M.route(patterns, quotas, 2)
        total = sum(sum(f.values()) for f in flow)
        cost = sum(max(0, min(sum(f.values()) - r * s, s)) * (r + 1) for f, (_, s) in zip(flow, patterns) for r in range(2))
        assert all(v >= 0 for f in flow for v in f.values())
        assert all(sum(f.get(j, 0) for f in flow) <= q for j, q in enumerate(quotas))
        assert (total, -cost) == best_flow(patterns, quotas, 2)


def test_overlapping_sources(spark):
    rows = [(i, 10 + i % 7, [["a"], ["b"], ["a", "b"], ["b", "a", "b"], [], None, [None]][i % 7]) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, size long, sources array<string>")
    chosen, sources = M.mix_sources(df, {"a": 1, "b": 5, None: 1})
    first, sources = {r.doc_id: r for r in chosen.collect()}, {r.source: r for r in sources.collect()}
    assert len(first) == 700 and all(0 <= r.taken <= 3 * r.size for r in first.values())
    assert all(r.taken == 0 for r in first.values() if not r.members)
    assert all(s.routed == s.quota for s in sources.values())
    assert sum(r.taken for r in first.values()) == sum(s.routed for s in sources.values())
    # one document a pattern at most is cut
    cut = [tuple(r.members) for r in first.values() if r.taken % r.size]
    assert len(cut) == len(set(cut))
    again, _ = M.mix_sources(df.repartition(5), {"a": 1, "b": 5, None: 1})
    assert {r.doc_id: r for r in again.collect()} == first
    other, _ = M.mix_sources(df, {"a": 1, "b": 5, None: 1}, seed=7)
    assert {r.doc_id: r.taken for r in other.collect()} != {i: r.taken for i, r in first.items()}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def run(spark, tmp_path, rows, extra=""):
    df = spark.createDataFrame(rows, SCHEMA + extra)
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    out = M.op12_source_mixing(spark, str(tmp_path))
    return same_as_sql(out, M.ORACLE, documents=df.toArrow())


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(i, "w " * (i % 13), "en", f"s{i % 4}", 0) for i in range(120)]
    rows += [(900, None, None, None, None), (901, "a b c", "en", None, 3), (None, "x y", "en", "s1", 3),
             (902, "", "en", "empty", 0), (903, "long " * 200_000, "en", "one", 0), (901, "a b c", "en", None, 3)]
    assert len(run(spark, tmp_path, rows)) == len(rows)


def test_tables_without_words(spark, tmp_path):
    df = spark.createDataFrame([(1, " \n", "en", "s", 1), (2, None, "en", "t", 1)], SCHEMA)
    df.write.parquet(f"{tmp_path}/a/documents.parquet")
    assert [tuple(r) for r in M.op12_source_mixing(spark, f"{tmp_path}/a").orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    spark.createDataFrame([], SCHEMA + ", size int, place string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert M.op12_source_mixing(spark, f"{tmp_path}/b").collect() == []


def test_too_many_patterns_fail(spark, monkeypatch):
    monkeypatch.setattr(M, "MAX_PATTERNS", 2)
    df = spark.createDataFrame([(i, 1, [str(i)]) for i in range(3)], "doc_id long, size long, sources array<string>")
    with pytest.raises(ValueError, match="sets of sources"):
        M.mix_sources(df, (1,))
