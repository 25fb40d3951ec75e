"""Runs in files and tasks: a line is split once, a search runs once, a task holds few queries."""

import pytest

from labelrank.operators import metrics as M
from labelrank.plans import catalog_deep, catalog_text, fixtures as fx
from labelrank.sources import files as io

ROWS = {
    "read_run_trec": ("q1 Q0 d1 1 0.5 tag", ("q1", "d1", 1, 0.5)),
    "read_run": ("7\t8\t1\t0.5", (7, 1, 8, 0.5)),
    "read_qrels": ("7\t8", (7, 8)),
    "read_qrels_trec": ("q1 Q0 d1 2", ("q1", "d1", 2)),
    "read_id_map": ("a\t3", ("a", 3)),
    "read_teacher_scores": ("q1 d1 [0.5]", ("q1", "d1", 0.5)),
}


@pytest.mark.parametrize("reader", sorted(ROWS))
def test_a_line_is_split_once(spark, tmp_path, reader):
    path = str(tmp_path / "lines")
    line, row = ROWS[reader]
    spark.createDataFrame([("　 " + line + "\t ",)], "value string").coalesce(1).write.text(path)
    df = getattr(io, reader)(spark, path)
    assert [tuple(r) for r in df.collect()] == [row]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


@pytest.mark.parametrize("query", [catalog_deep.q_apply_permutation_cut, catalog_text.q_apply_permutation])
def test_hits_are_searched_once(spark, tmp_path, query):
    vectors = [(i, [float(i % 7), float(i % 5), 1.0], 0) for i in range(30)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = query(spark, str(tmp_path))
    assert "CoGroup" in fx.fx_run(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == sum(r["rank"] <= (20 if query is catalog_text.q_apply_permutation else 1000)
                              for r in fx.fx_run(spark, str(tmp_path)).collect())


def test_tasks_grow_with_the_queries(spark, monkeypatch):
    run = spark.createDataFrame([(q, p, 1.0 / p) for q in range(40) for p in (1, 2)], "qid int, pid int, score double")
    qrels = spark.createDataFrame([(q, 2, 1) for q in range(40)], "qid int, pid int, rel int")
    few = [tuple(r) for r in M.eval_mrr_at_k(run, qrels, (1, 10)).collect()]
    monkeypatch.setattr(M, "TASK_QUERIES", 1)
    many = M.trec_per_query(run, qrels, (1, 10))
    assert "RepartitionByExpression [qid" in many._jdf.queryExecution().optimizedPlan().toString()
    assert ", 40" in many._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression [qid")[1].split("\n")[0]
    assert [tuple(r) for r in M.mean_over_queries(many, ["MRR@1", "MRR@10"]).collect()] == few == [("MRR@1", 0.0), ("MRR@10", 0.5)]
