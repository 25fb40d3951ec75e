"""Disk of deep runs: passages are written once, a run is shuffled once at most, files in order not at all."""

import glob
import gzip
import time

import numpy as np
import pytest

from labelrank.llm.components import write_scratch
from labelrank.operators import knn as K
from labelrank.operators import metrics as M
from labelrank.plans import catalog_eval, catalog_io, fixtures as fx
from labelrank.sources import files as io


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def vectors(spark, ids, m, name, kind):
    return spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, m)], f"{name} string, embedding array<{kind}>")


def brute(qids, qm, pids, pm, k):
    """The k best rows of every query id: score desc, then passage id asc, null first."""
    s, out = qm @ pm.T, []
    for q in set(qids):
        hits = [(-s[i, j], pids[j] is not None, pids[j] or "") for i in range(len(qids)) if qids[i] == q for j in range(len(pids))]
        out += [(str(q), r + 1, str(p if there else None), -score) for r, (score, there, p) in enumerate(sorted(hits)[:k])]
    return sorted(out)


@pytest.mark.parametrize("k,kind,task", [(40, "float", 4_000_000), (40, "double", 60), (500, "double", 4_000_000)])
def test_many_query_blocks_read_passages_written_once(spark, monkeypatch, k, kind, task):
    rng = np.random.default_rng(k)
    qm, pm = (rng.integers(-2, 3, (n, 4)).astype(float) for n in (90, 300))  # many equal scores
    qids = [None if i == 5 else f"q{i if i % 7 else i // 14}" for i in range(len(qm))]
    pids = [None if i == 8 else f"p{i if i % 5 else i // 10}" for i in range(len(pm))]
    monkeypatch.setattr(K, "ROW_BYTES", 4 * 4 * 17)
    monkeypatch.setattr(K, "FILE_BYTES", 4 * 4 * 70)
    monkeypatch.setattr(K, "TASK_PASSAGES", task)
    got = K.knn_exact(vectors(spark, qids, qm, "qid", kind), vectors(spark, pids, pm, "pid", kind), k, q_block_rows=9, min_tasks=1,
                      ordered=True)
    assert "CoGroup" not in plan(got)  # no copy of the passages for each of ten blocks
    rows = [(r.qid, r["rank"], r.pid, r.score) for r in got.collect()]
    assert sorted((str(q), r, str(p), s) for q, r, p, s in rows) == brute(qids, qm, pids, pm, k)
    order = [(q is not None, q or "", r) for q, r, _, _ in rows]
    assert order == sorted(order)


def test_passages_in_any_order_and_ties():
    rng = np.random.default_rng(1)
    qm, pm = rng.integers(-2, 3, (20, 5)).astype(float), rng.integers(-2, 3, (900, 5)).astype(float)
    want, _, _ = K.running_top(qm, pm, 30)
    top = K.RunningTop(20, 30)
    for start in rng.permutation(np.arange(0, 900, 50)):
        top.add(qm, pm[start:start + 50], int(start))
    best, at, n = top.result(sort=True)
    s = qm @ pm.T
    assert (n == 30).all()
    for i in range(20):
        assert at[i].tolist() == np.lexsort((np.arange(900), -s[i]))[:30].tolist()
        assert best[i].tolist() == s[i, at[i]].tolist() == sorted(want[i], reverse=True)


def test_vectors_of_two_lengths_fail_when_streamed(spark):
    q = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)], "qid long, embedding array<double>")
    p = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])], "pid long, embedding array<double>")
    with pytest.raises(Exception, match="components"):
        K.knn_exact(q, p, 1, q_block_rows=1, min_tasks=1).collect()


@pytest.fixture
def small_tables(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist(), i % 3) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def test_the_ranking_file_is_in_order_and_read_without_a_shuffle(spark, small_tables, monkeypatch):
    monkeypatch.setattr(K, "query_block_rows", lambda *a: 5)  # many blocks
    run = fx.fx_run(spark, small_tables, ordered=True)
    assert "CartesianProduct" in plan(run) and "Window" not in plan(run)
    path = catalog_io._written_run(spark, small_tables)
    lines = [line for f in sorted(glob.glob(path.removeprefix("file:") + "/part-*.gz")) for line in gzip.open(f, "rt")]
    keys = [tuple(map(int, line.split("\t")[::2][:2])) for line in lines]
    assert len(keys) == 3600 and keys == sorted(keys)
    read = io.read_run(spark, path)
    assert "Exchange" not in plan(read)
    assert sorted((r.qid, r["rank"], r.pid, r.score) for r in read.collect()) == sorted(
        (r.qid, r["rank"], r.pid, r.score) for r in run.collect())


@pytest.mark.parametrize("lines,want", [
    (["1\t5\t1", "1\t6\t2", "1\t7\t2"], [(1, 1, 5), (1, 2, 7)]),
    (["2\t5\t1", "1\t6\t1", "2\t9\t1"], [(1, 1, 6), (2, 1, 9)]),
    (["1\t5\t1", "1\t6\t2", "3\t6\t1"], [(1, 1, 5), (1, 2, 6), (3, 1, 6)])])
def test_the_last_line_of_a_rank_wins_in_any_order(spark, tmp_path, lines, want):
    path = str(tmp_path / "run")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    spark.createDataFrame([("8\t1\t1",)], "value string").coalesce(1).write.mode("append").text(path)
    got = sorted((r.qid, r["rank"], r.pid) for r in io.read_run(spark, path).collect())
    assert got == [*want, (8, 1, 1)]


def test_duplicates_need_one_search(spark, small_tables):
    made = catalog_eval.q_check_duplicates(spark, small_tables)._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("CoGroup") == 1 and "Union" not in made


def test_relevant_rows_alone_are_shuffled(spark):
    """Of 4000 rows of a run, 40 queries with two relevant ones each."""
    run = spark.createDataFrame([(q, p, p + 1) for q in range(40) for p in range(100)], "qid long, pid long, rank long").coalesce(1)
    qrels = spark.createDataFrame([(q, p) for q in range(40) for p in (3, 30, 300)], "qid long, pid long")
    per_query = M.msmarco_per_query(run, qrels)
    got = per_query.collect()
    assert all((r.n_rel, r.first_rank, r.hits_10, r.hits_50, r.ranked) == (3, 4, 1, 2, 1) for r in got) and len(got) == 40
    made = per_query._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [qid#" in made and "CASE WHEN" in made.split("Aggregate [qid#")[-2] + made


@pytest.mark.parametrize("few", [0, 500_000])
def test_trec_run_is_shuffled_once(spark, monkeypatch, few):
    monkeypatch.setattr(M, "BROADCAST_PAIRS", few)
    monkeypatch.setattr(M, "TASK_QUERIES", 4)
    adaptive, most = spark.conf.get("spark.sql.adaptive.enabled"), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set(most, "-1")
    try:
        run = spark.createDataFrame([(q, p, float(p * q % 7)) for q in range(40) for p in range(12)], "qid int, pid int, score double")
        run = run.union(spark.createDataFrame([(3, None, 9.0)], run.schema))
        qrels = spark.createDataFrame([(q, p, p % 3) for q in range(2, 60) for p in range(0, 12, 2)] + [(3, None, 2)], "qid long, pid long, rel int")
        per_query = M.trec_per_query(run, qrels, (1, 5, 10))
        exchanges = [x for x in plan(per_query).splitlines() if "Exchange hashpartitioning" in x and "REPARTITION_BY_NUM" in x]
        assert len(exchanges) == 1
        after = plan(per_query).split("REPARTITION_BY_NUM")[0]
        assert "Join [qid" not in after.split("Window")[-1]  # neither queries nor pairs are joined to the dealt run
        assert per_query.schema["qid"].dataType.simpleString() == "int"
        rows = {r.qid: r for r in per_query.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.unset(most)
    assert sorted(rows) == list(range(2, 40))
    for q in (2, 3, 11):
        hits = sorted([(float(p * q % 7), str(p), p % 3 if p % 2 == 0 else 0) for p in range(12)] + [(9.0, "", 0)] * (q == 3), reverse=True)
        grades, judged = [g for _, _, g in hits], [p % 3 for p in range(0, 12, 2)] + [2] * (q == 3)
        dcg = sum(g / np.log2(i + 2) for i, g in enumerate(grades[:5]))
        ideal = sum(g / np.log2(i + 2) for i, g in enumerate(sorted(judged, reverse=True)[:5]))
        relevant = sum(g >= 1 for g in judged)
        ap = sum(sum(x >= 1 for x in grades[:i + 1]) / (i + 1) for i, g in enumerate(grades[:5]) if g >= 1) / relevant
        assert (rows[q]["NDCG@5"], rows[q]["MAP@5"]) == pytest.approx((dcg / ideal, ap))
        assert rows[q]["Recall@5"] == pytest.approx(sum(g >= 1 for g in grades[:5]) / relevant)


def test_shuffles_go_with_the_write(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f for d in blocks.localDirs() for f in glob.glob(d.getPath() + "/*/shuffle_*.data")}
    before = shuffled()
    out = write_scratch(spark.range(1000).repartition(3, "id"), "kept")
    for _ in range(50):  # they are removed in the background
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before and out.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
