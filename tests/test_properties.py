"""Properties from the test strategy: metric bounds and monotonicity in k, results
invariant under repartitioning, group shape."""

from pyspark.sql import functions as F

from labelrank.operators import metrics as M
from labelrank.operators import sampling as S
from labelrank.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_metrics_bounded_and_monotone_in_k(spark):
    run, qrels = fx.fx_run(spark, SF), fx.fx_qrels(spark, SF)
    ms = {r["metric"]: r["value"] for r in M.eval_msmarco(run, fx.fx_qrels_binary(spark, SF)).collect()}
    tr = {r["metric"]: r["value"] for r in M.eval_trec(run, qrels).collect()}
    for name, ks in (("MRR @", M.MSMARCO_CUTOFFS), ("Recall @", M.MSMARCO_CUTOFFS)):
        vals = [ms[f"{name}{k}"] for k in ks]
        assert all(0 <= v <= 1 for v in vals) and vals == sorted(vals)
    for name in ("Recall@", "MRR@", "MAP@"):
        vals = [tr[f"{name}{k}"] for k in M.TREC_CUTOFFS]
        assert all(0 <= v <= 1 for v in vals) and vals == sorted(vals)
    assert all(0 <= tr[f"NDCG@{k}"] <= 1 for k in M.TREC_CUTOFFS)


def test_groups_invariant_under_repartition(spark):
    from labelrank.plans.catalog_sampling import tr_inputs
    qidx, pos, hard, neg, corpus, n = tr_inputs(spark, SF)
    a = S.group_pooled(qidx, pos, hard, neg, corpus, 8, n_corpus=n)
    b = S.group_pooled(qidx.repartition(3), pos.repartition(5), hard.repartition(2), neg.repartition(7),
                       corpus.repartition(4), 8, n_corpus=n)
    ra, rb = sorted(map(tuple, a.collect())), sorted(map(tuple, b.collect()))
    assert ra == rb
    sizes = a.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("s")).collect()
    assert all(r["n"] == 8 and r["s"] == 8 for r in sizes)


def test_truncate_words_equals_python_split(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from labelrank.functions.text import truncate_words

    texts = []

    @settings(max_examples=200, deadline=None)
    @given(st.text(alphabet=" ab\n\t", max_size=30))
    def collect(t):
        texts.append(t)
    collect()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 3):
        got = [r[0] for r in df.select(truncate_words("t", n)).collect()]
        assert got == [" ".join(t.split(" ")[:n]) for t in texts]


def test_knn_block_planner_bounds():
    import math

    from labelrank.operators.knn import _block_counts
    budget, dim = 256 << 20, 768
    p_rows, q_rows = budget // (8 * dim), budget // (4 * 8 * dim)
    for nq, npass in ((7_000, 8_800_000), (500_000, 8_800_000), (2_000, 2_000), (1, 10)):
        qb, pb = _block_counts(nq, npass, q_rows, p_rows, 1000, 1000, dim)
        # memory per task never above the budget sizing
        assert math.ceil(npass / pb) <= p_rows and math.ceil(nq / qb) <= q_rows
        # widened to the task target unless blocks would become too small
        assert qb * pb >= 1000 or (nq / (qb * 2) < 128 and npass / (pb * 2) < 512)
    # small corpus, many queries: split queries (cheap passage copies) instead of adding candidates
    assert _block_counts(2_000, 2_000, 131072, 524288, 8, 1000, 64) == (8, 1)
