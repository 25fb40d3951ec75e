"""Keyed permutations: bijections at every size, draws against a plain network, whole populations."""

import hashlib

import pytest
from pyspark.sql import functions as F

from labelrank.operators import permutation as PM


def image(j, n, *key):
    a, b = PM.halves(n)

    def mix(i, half):
        return int(hashlib.md5("|".join(map(str, (*key, i, half))).encode()).hexdigest()[:15], 16)
    l, r = j % a, j // a
    while True:
        for i in range(PM.rounds(n)):
            l, r = ((l + mix(i, r)) % a, r) if i % 2 == 0 else (l, (r + mix(i, l)) % b)
        if l + r * a < n:
            return l + r * a


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 16, 97, 1009, 4099])
def test_bijection(spark, n):
    got = [r.x for r in spark.range(n).select(F.col("id"), PM.permuted(F.col("id"), n, 42, 0, "t").alias("x")).orderBy("id").collect()]
    assert sorted(got) == list(range(n)) and got == [image(j, n, 42, 0, "t") for j in range(n)]


@pytest.mark.parametrize("n", [3, 10, 1000, 10**6 + 3, 10**10 + 19])
def test_few_further_passes(n):
    a, b = PM.halves(n)
    assert a * b >= n and min(a, b) >= 2 and a * b - n <= 3


def test_large_population(spark):
    n = 10**10 + 19
    got = [r.x for r in spark.range(2000).select(PM.permuted(F.col("id") * 4_999_999, n, 1, 2, "t").alias("x")).collect()]
    assert len(set(got)) == 2000 and 0 <= min(got) and max(got) < n
    assert got[7] == image(7 * 4_999_999, n, 1, 2, "t")


def corpus(spark, n):
    return spark.range(n).select(F.concat(F.lit("d"), "id").alias("docid"), F.col("id").alias("offset"))


def test_whole_population_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(PM, "DRAW_BLOCK", 16)
    qk = spark.createDataFrame([("a", 50), ("b", 1), ("c", 0), ("d", None), ("e", -1), (None, 17), ("r", 3), ("r", 3)], "qid string, k int")
    rows = PM.keyed_negatives(qk, corpus(spark, 50), seed=3).collect()
    of = {q: sorted((r.j, r.docid) for r in rows if r.qid == q) for q in ("a", "b", "c", "d", "e", None, "r")}
    assert [len(of[q]) for q in ("a", "b", "c", "d", "e", None, "r")] == [50, 1, 0, 0, 0, 17, 6]
    assert [j for j, _ in of["a"]] == list(range(50)) and {d for _, d in of["a"]} == {f"d{i}" for i in range(50)}
    assert [d for _, d in of["a"]] == [f"d{image(j, 50, 3, 0, 'a', 'rand')}" for j in range(50)]
    assert of["r"][::2] == of["r"][1::2] and len({d for _, d in of[None]}) == 17


def test_failures_and_empty_tables(spark):
    qk = spark.createDataFrame([("a", 5)], "qid string, k int")
    with pytest.raises(Exception, match="larger than population"):
        PM.keyed_negatives(qk, corpus(spark, 4)).collect()
    with pytest.raises(Exception, match="larger than population"):
        PM.keyed_negatives(qk, corpus(spark, 0)).collect()
    with pytest.raises(Exception, match="missing corpus offset"):
        PM.keyed_negatives(qk, corpus(spark, 4), n_corpus=5).collect()
    assert PM.keyed_negatives(qk.filter("k < 0"), corpus(spark, 4)).collect() == []


def test_draws_are_spread(spark):
    """Every id about as often as any other, also in pairs of neighbouring draws."""
    qk = spark.range(6000).select(F.col("id").alias("qid"), F.lit(2).alias("k"))
    for n in (4, 6):
        d = PM.keyed_draws(qk, n).groupBy("qid").pivot("j", [0, 1]).agg(F.first("offset")).groupBy("0", "1").count().collect()
        even = 6000 / (n * (n - 1))
        assert len(d) == n * (n - 1) and sum((r["count"] - even) ** 2 / even for r in d) < 2 * len(d)


def test_order_needs_no_exchange(spark):
    df = PM.permuted_order(corpus(spark, 100), 100)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.position for r in df.collect()) == list(range(100))
    odd = PM.permuted_order(corpus(spark, 2).unionByName(corpus(spark, 1).withColumn("offset", F.lit(None).cast("long"))), 2)
    assert sorted(r.position for r in odd.collect() if r.position is not None) == [0, 1] and odd.filter("position is null").count() == 1
    assert PM.permuted_order(corpus(spark, 0), 0).collect() == []
