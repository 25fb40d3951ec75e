"""Hand-made rows for the semantics that bite and operator properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelrank.functions import replies as R
from labelrank.functions import text as T
from labelrank.operators import losses as L
from labelrank.operators import metrics as M
from labelrank.operators import sampling as S
from labelrank.operators.knn import knn_exact
from labelrank.operators.ranking import global_index
from labelrank.session import scratch_path
from labelrank.sources import files as io


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols.keys())) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_parse_selection_quirks(spark):
    df = spark.createDataFrame([("a", ["p1", "p2", "p3"], "My selection:[[1],[0],[3],[7],[123456789012345678901]].")],
                               "q string, ids array<string>, r string")
    ignore = df.select(R.parse_selection("r", "ids").alias("s")).first()["s"]
    wrap = df.select(R.parse_selection("r", "ids", zero="wrap").alias("s")).first()["s"]
    assert ignore == [1, 0, 1]
    assert wrap == [1, 0, 1]  # [3] already marks the last one
    df2 = spark.createDataFrame([(["p1", "p2", "p3"], "[0]")], "ids array<string>, r string")
    assert df2.select(R.parse_selection("r", "ids", zero="wrap").alias("s")).first()["s"] == [0, 0, 1]
    empty = spark.createDataFrame([([], "[1][0]")], "ids array<string>, r string")
    assert empty.select(R.parse_selection("r", "ids", zero="wrap").alias("s")).first()["s"] == []


def test_parse_ranking_dedupes_and_filters(spark):
    df = spark.createDataFrame([(["a", "b", "c"], "[2] > [2] > [0] > [3] > [9] > [1]")], "ids array<string>, r string")
    order, ids = R.parse_ranking("r", "ids")
    row = df.select(order.alias("o"), ids.alias("i")).first()
    assert row["o"] == [1, 2, 0] and row["i"] == ["b", "c", "a"]


def test_strip_reasoning_and_truncate(spark):
    df = spark.createDataFrame([("x</think>mid</think>tail", "no marker", "a  b c")], "r string, s string, t string")
    row = df.select(T.strip_reasoning("r").alias("a"), T.strip_reasoning("s").alias("b"),
                    T.truncate_words("t", 2).alias("c")).first()
    assert row["a"] == "mid" and row["b"] == "no marker" and row["c"] == "a "


def test_format_passage_strips_unicode_whitespace(spark):
    df = spark.createDataFrame([("　Title\n", "\t body  "), (None, " only ")], "title string, text string")
    got = [r["p"] for r in df.select(T.format_passage("text", "title").alias("p")).collect()]
    assert got == ["Title body", "only"]


def test_has_hard_negatives(spark):
    df = spark.createDataFrame([([""],), (["", "a"],), (None,)], "h array<string>")
    got = [r["x"] for r in df.select(T.has_hard_negatives("h").alias("x")).collect()]
    assert got == [[], ["", "a"], []]


def test_apply_permutation_window_keeps_rank_and_score(spark):
    hits = spark.createDataFrame([(1, s, 100 + s, s + 1, 1.0 - s / 10) for s in range(6)],
                                 "qid long, slot long, pid long, rank long, score double")
    replies = spark.createDataFrame([(1, "3 1 [1] 9 x2")], "qid long, reply string")
    out = {r["slot"]: r for r in R.apply_permutation(hits, replies, cut_start=1, cut_end=4).collect()}
    # window slots 1..3 (m = 3): digits 3,1,1,9,2 -> 2,0,0,8,1 -> distinct 2,0,8,1 -> valid 2,0,1
    assert [out[s]["pid"] for s in range(6)] == [100, 103, 101, 102, 104, 105]
    assert [out[s]["rank"] for s in range(6)] == [1, 2, 3, 4, 5, 6]


def test_eval_msmarco_divisor_and_duplicate_qrels(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1)], "qid long, pid long, rank long")
    qrels = spark.createDataFrame([(1, 11), (1, 11), (1, 12), (3, 30)], "qid long, pid long")
    m = {r["metric"]: r["value"] for r in M.eval_msmarco(run, qrels).collect()}
    assert m["MRR @10"] == pytest.approx(0.5 / 2)        # divisor = 2 qrels queries
    assert m["Recall @10"] == pytest.approx((1 / 3) / 2)  # duplicate line counts in the denominator
    assert m["QueriesRanked"] == 2
    bad = spark.createDataFrame([(9, 1)], "qid long, pid long")
    with pytest.raises(Exception):
        M.eval_msmarco(run, bad).collect()


def test_trec_counts_only_queries_in_both(spark):
    run = spark.createDataFrame([(1, 5, 0.9), (1, 6, 0.8), (2, 7, 0.5)], "qid long, pid long, score double")
    qrels = spark.createDataFrame([(1, 6, 2), (1, 8, 1), (3, 9, 1)], "qid long, pid long, rel int")
    m = {r["metric"]: r["value"] for r in M.eval_trec(run, qrels, (10,)).collect()}
    dcg = 2 / np.log2(3)
    idcg = 2 + 1 / np.log2(3)
    assert m["NDCG@10"] == pytest.approx(round(dcg / idcg, 5))
    assert m["Recall@10"] == pytest.approx(0.5)
    assert m["MAP@10"] == pytest.approx(round(0.5 / 2, 5))
    assert m["MRR@10"] == pytest.approx(0.5)


def test_knn_ties_blocks_and_short_corpus(spark):
    rng = np.random.default_rng(0)
    q = rng.normal(size=(23, 5)).round(1)
    p = rng.normal(size=(41, 5)).round(1)
    p[7] = p[3]  # exact tie
    qdf = spark.createDataFrame([(i, q[i].tolist()) for i in range(len(q))], "qid long, embedding array<double>")
    pdf = spark.createDataFrame([(i, p[i].tolist()) for i in range(len(p))], "pid long, embedding array<double>")
    s = q @ p.T
    want = {(i, j + 1): int(pid) for i in range(len(q))
            for j, pid in enumerate(sorted(range(len(p)), key=lambda t: (-s[i, t], t))[:5])}
    for qb, pb in ((1000, 1000), (7, 13)):
        got = {(r["qid"], r["rank"]): r["pid"] for r in knn_exact(qdf, pdf, 5, q_block_rows=qb, p_block_rows=pb,
                                                                   min_tasks=1).collect()}
        assert got == want
    assert knn_exact(qdf, pdf, 100).count() == len(q) * len(p)


def test_random_negatives_distinct_exact_and_partition_free(spark):
    corpus = spark.createDataFrame([(f"d{i}", i) for i in range(12)], "docid string, offset long")
    qk = spark.createDataFrame([(q, 10) for q in range(20)], "qid long, k long")
    a = S.random_negatives(qk, corpus, margin=0)  # N < 4k: coupon-collector draw count
    rows = a.collect()
    by_q = {}
    for r in rows:
        by_q.setdefault(r["qid"], []).append(r["docid"])
    assert all(len(v) == 10 and len(set(v)) == 10 for v in by_q.values()) and len(by_q) == 20
    b = S.random_negatives(qk.repartition(7), corpus.repartition(3), margin=0)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, b.collect()))
    with pytest.raises(Exception):
        S.random_negatives(spark.createDataFrame([(1, 13)], "qid long, k long"), corpus).collect()


def test_groups_have_group_size_and_positive_first(spark):
    G = 4
    qidx = spark.createDataFrame([(1, 0), (2, 1)], "qid long, idx long")
    pos = spark.createDataFrame([(1, 0, "p1"), (1, 1, "p2"), (2, 0, "p3")], "qid long, pos long, docid string")
    hard = spark.createDataFrame([(1, 0, "h1")], "qid long, pos long, docid string")
    neg = spark.createDataFrame([(1, i, f"n{i}") for i in range(5)], "qid long, pos long, docid string")
    corpus = spark.createDataFrame([(f"c{i}", i) for i in range(50)], "docid string, offset long")
    for fn in (S.group_rotate, S.group_pooled, S.group_rotate_pooled, S.group_all_positives, S.group_first_positive):
        rows = fn(qidx, pos, hard, neg, corpus, group_size=G).collect()
        for q in (1, 2):
            slots = sorted(r["slot"] for r in rows if r["qid"] == q)
            assert slots == list(range(G)), fn.__name__
    rot = {r["qid"]: r["docid"] for r in S.group_rotate(qidx, pos, hard, neg, corpus, group_size=G).collect()
           if r["slot"] == 0}
    assert rot == {1: ["p1", "p2"][(0 + 42) % 2], 2: "p3"}
    # query 2 has an empty pool: G-1 corpus ids, all distinct
    q2 = [r["docid"] for r in S.group_rotate(qidx, pos, hard, neg, corpus, group_size=G).collect() if r["qid"] == 2]
    assert len(set(q2)) == G


def test_global_index_is_partition_independent(spark):
    df = spark.range(1000).withColumn("k", F.pmod(F.col("id") * 7919, F.lit(1000)))
    a = {r["k"]: r["idx"] for r in global_index(df.repartition(5), ["k"], "idx").collect()}
    assert sorted(a.values()) == list(range(1000)) and all(a[k] == k for k in a)


def test_losses_hand_values(spark):
    s = spark.createDataFrame([(0, 0, 0, 2.0, 1.0), (0, 0, 1, 0.0, 0.0), (0, 0, 2, 1.0, 1.0)],
                              "batch_id long, q_idx long, p_idx long, score double, target double")
    lse = np.log(np.exp(2) + 1 + np.exp(1))
    assert L.loss_softmax(s).first()["loss"] == pytest.approx(2 * lse - 3)
    p = (np.exp(2) + np.exp(1)) / (np.exp(2) + 1 + np.exp(1))
    assert L.loss_marginal(s).first()["loss"] == pytest.approx(-np.log(p))
    hinge = np.mean([1 - 2.0, 0.5 - 1.0 if 0.5 - 1.0 > 0 else 0.0, 1 - 1.0])
    assert L.loss_hinge(s).first()["loss"] == pytest.approx(hinge)


def test_read_run_last_line_wins_and_rejects_bad_rank(spark):
    path = scratch_path(spark, "run-test")
    spark.createDataFrame([("1\t5\t1",), ("1\t6\t1",), ("1\t7\t2\t0.5",)], "value string").coalesce(1).write.text(path)
    rows = {(r["qid"], r["rank"]): r["pid"] for r in io.read_run(spark, path).collect()}
    assert rows == {(1, 1): 6, (1, 2): 7}
    bad = scratch_path(spark, "run-bad")
    spark.createDataFrame([("1\t5\t1001",)], "value string").write.text(bad)
    with pytest.raises(Exception):
        io.read_run(spark, bad).collect()


def test_teacher_scores_override_and_missing_file(spark):
    p1, p2 = scratch_path(spark, "t1"), scratch_path(spark, "t2")
    spark.createDataFrame([("q1 d1 [0.25]",), ("q1 d2 1",), ("q1 d1 0.3",)], "value string").coalesce(1).write.text(p1)
    spark.createDataFrame([("q1 d2 0.75",)], "value string").write.text(p2)
    got = {(r["qid"], r["did"]): r["score"] for r in io.read_teacher_scores(spark, [p1, p2]).collect()}
    assert got == {("q1", "d1"): 0.3, ("q1", "d2"): 0.75}
    assert io.read_teacher_scores(spark, [p1, p1 + "-missing"]) is None


def test_corpus_tsv_quotes_are_data(spark):
    path = scratch_path(spark, "tsv")
    spark.createDataFrame([('7\t"quoted" text',), ("8\tTitle\tbody\textra",)], "value string").coalesce(1).write.text(path)
    rows = sorted(tuple(r) for r in io.read_corpus_tsv(spark, path).collect())
    assert rows == [("7", None, '"quoted" text', 0), ("8", "Title", "body", 1)]


def test_position_within_skewed_key(spark):
    from labelrank.operators.ranking import position_within
    df = spark.range(3000).select(F.when(F.col("id") < 2000, F.lit(0)).otherwise(F.col("id") % 7).alias("key"),
                                  F.col("id").alias("o"))
    rows = position_within(df.repartition(6), "key", ["o"]).collect()
    by = {}
    for r in rows:
        by.setdefault(r["key"], []).append((r["o"], r["pos"]))
    for key, v in by.items():
        v.sort()
        assert [p for _, p in v] == list(range(len(v))), key


def test_read_negatives_concatenates_lines_and_depth(spark):
    path = scratch_path(spark, "neg")
    spark.createDataFrame([("q1\ta,b",), ("q2\t",), ("q1\tc",)], "value string").coalesce(1).write.text(path)
    got = sorted((r["qid"], r["pos"], r["docid"]) for r in io.read_negatives(spark, path).collect())
    assert got == [("q1", 0, "a"), ("q1", 1, "b"), ("q1", 2, "c"), ("q2", 0, "")]
    top = sorted((r["qid"], r["pos"], r["docid"]) for r in io.read_negatives(spark, path, depth=2).collect())
    assert top == [("q1", 0, "a"), ("q1", 1, "b"), ("q2", 0, "")]


def test_group_lists_chunks_keep_whole_ordered_list(spark):
    df = spark.range(25).select(F.lit("q").alias("k"), F.col("id").alias("item"), (-F.col("id")).alias("o"))
    rows = sorted(M.group_lists(df, "k", "item", ["o"], chunk_size=10).collect(), key=lambda r: r["chunk"])
    assert [r["chunk"] for r in rows] == [0, 1, 2]
    assert [x for r in rows for x in r["items"]] == list(range(24, -1, -1))


def test_reasoning_is_parsed_unless_stripped(spark):
    df = spark.createDataFrame([(["a", "b", "c"], "<think>maybe [2]</think>My selection:[[1]].")],
                               "ids array<string>, r string")
    raw = df.select(R.parse_selection("r", "ids").alias("s")).first()["s"]
    stripped = df.select(R.parse_selection("r", "ids", strip=True).alias("s")).first()["s"]
    assert raw == [1, 1, 0] and stripped == [1, 0, 0]
    order, _ = R.parse_ranking("r", "ids", strip=True)
    assert df.select(order.alias("o")).first()["o"] == [0]
