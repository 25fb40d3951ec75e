"""Prompts reach the generator in small batches; runs are shuffled once for their judgements."""

import io as text
from contextlib import redirect_stdout

import pandas as pd
import pytest

from labelrank.operators import metrics as M
from labelrank.operators.ledger import generate_with_ledger
from labelrank.plans import jobs as J
from labelrank.plans.rerank import rerank_windows
from labelrank.session import scratch_path
from labelrank.sources import files as io


class BatchSize:
    def generate(self, batch):
        return pd.Series([str(len(batch))] * len(batch), index=batch.index)


def test_a_worker_holds_few_prompts(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = spark.range(1000).repartition(1).selectExpr("id AS query_id", "concat('p', id) AS prompt")
    got = J.batch_generate(df, BatchSize, "reply", ["query_id"], materialize=scratch_path(spark, "few")).collect()
    assert len(got) == 1000 and max(int(r.reply) for r in got) <= J.PROMPT_ROWS
    got = generate_with_ledger(df, BatchSize, "reply", ["query_id"], scratch_path(spark, "few-ledger"), flush_rows=50, partitions=1)
    assert got.count() == 1000 and got.filter("reply is null or cast(reply AS int) > 50").isEmpty()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def exchanges(df):
    out = text.StringIO()
    with redirect_stdout(out):
        df.explain("simple")
    return [line for line in out.getvalue().splitlines() if " Exchange hashpartitioning" in line]


@pytest.fixture
def plain_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_run_is_shuffled_once(spark, plain_plans):
    run = spark.createDataFrame([(1, 5, 1, 0.5), (1, 6, 2, 0.4), (2, 5, 1, 0.1), (3, 9, 1, 0.1)], "qid long, pid long, rank long, score double")
    path = scratch_path(spark, "few-run")
    io.write_ranking(run, path)
    qrels = spark.createDataFrame([(1, 6, 1), (2, 7, 2), (2, 8, 0)], "qid long, pid long, rel int")
    read = io.read_run(spark, path)
    per_query = M.msmarco_per_query(read, qrels)
    with_rank = [line for line in exchanges(per_query) if "rank" in line or "__r" in line or "pid" in line]
    # neither the lines by file nor the ranks by (query, passage)
    assert not [line for line in exchanges(per_query) if "__f" in line and "__b" in line and "SortMergeJoin" in line]
    assert not [line for line in with_rank if "rank#" in line]
    assert "Join BroadcastHashJoin" in " ".join(["Join " + w for w in per_query._jdf.queryExecution().executedPlan().toString().split()])
    assert sorted((r.qid, r.n_rel, r.first_rank, r.hits_10, r.ranked) for r in per_query.filter("n_rel is not null").collect()) == [
        (1, 1, 2, 1, 1), (2, 2, None, 0, 1)]
    assert sorted((r.qid, r["rank"], r.pid) for r in read.collect()) == [(1, 1, 5), (1, 2, 6), (2, 1, 5), (3, 1, 9)]


def test_few_and_many_judgements_score_alike(spark, monkeypatch):
    run = spark.createDataFrame([(q, p, float(p * q % 7)) for q in range(1, 6) for p in range(12)], "qid long, pid long, score double")
    qrels = spark.createDataFrame([(q, p, p % 3) for q in range(2, 8) for p in range(0, 12, 2)], "qid long, pid long, rel int")
    few = sorted(map(tuple, M.eval_trec(run, qrels).collect()))
    monkeypatch.setattr(M, "BROADCAST_PAIRS", 0)
    assert sorted(map(tuple, M.eval_trec(run, qrels).collect())) == few


class AsGiven:
    def generate(self, batch):
        return pd.Series(["[1]"] * len(batch), index=batch.index)


def test_hits_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b
    hits = spark.range(0, 60).selectExpr("id div 30 AS qid", "id % 30 AS slot", "id AS pid", "concat('p', id) AS passage").mapInPandas(
        count, "qid long, slot long, pid long, passage string")
    queries = spark.createDataFrame([(0, "a"), (1, "b")], "qid long, query string")
    out = rerank_windows(hits, queries, AsGiven, 30, 10, 5).collect()
    assert sorted((r.qid, r.slot, r.pid) for r in out) == [(i // 30, i % 30, i) for i in range(60)]
    assert made.value == 60
