"""Malformed input fails, lookups are complete, searches break ties."""

import pytest
from pyspark.sql import Row

from labelrank.operators.knn import knn_exact
from labelrank.operators.lookup import attach_answer, attach_passages, attach_tokens
from labelrank.operators.metrics import check_duplicates, trec_per_query
from labelrank.session import scratch_path
from labelrank.sources import files as io


def lines(spark, rows):
    path = scratch_path(spark, "lines")
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(path)
    return path


@pytest.mark.parametrize("reader,good,bad", [
    (io.read_corpus_tsv, "1\ttext", "only one field"),
    (io.read_id_map, "a\t1", "a\tb"),
    (io.read_positives, "1\t2,3", "no tab"),
    (io.read_negatives, "1\t2,3", "no tab"),
    (io.read_qrels, "1\t2", "1 2"),
    (io.read_qrels_trec, "1 Q0 2 1", "1 Q0 2"),
    (io.read_run_trec, "1 Q0 2 1 0.5 tag", "1 Q0 2 one 0.5 tag"),
    (io.read_run, "1\t2\t1", "1\t2\t0"),
    (io.read_teacher_scores, "1 2 0.5", "1 2 x"),
    (io.read_corpus_jsonl, '{"docid": "1", "text": "t"}', '{"docid": "1"'),
    (io.read_candidates, '{"query_id": "1"}', "{]"),
    (io.read_train_records, '{"query_id": "1"}', "{]"),
])
def test_malformed_lines_fail(spark, reader, good, bad):
    assert reader(spark, lines(spark, [good])).count() >= 1
    with pytest.raises(Exception):
        reader(spark, lines(spark, [good, bad])).collect()


def test_jsonl_offsets_follow_the_file(spark):
    rows = [f'{{"docid": "d{9 - i}", "text": "t"}}' for i in range(9)]
    got = io.read_corpus_jsonl(spark, lines(spark, rows), with_offset=True).orderBy("offset").collect()
    assert [(r.docid, r.offset) for r in got] == [(f"d{9 - i}", i) for i in range(9)]
    with pytest.raises(Exception):
        io.read_corpus_jsonl(spark, lines(spark, rows + ["{"]), with_offset=True).collect()


def test_shared_and_missing_passages(spark):
    df = spark.createDataFrame([(1, ["d1", "d2"]), (2, ["d3", "d1"]), (3, [])], "query_id long, ids array<string>")
    lookup = spark.createDataFrame([("d1", "a"), ("d2", "b"), ("d1", "a"), ("d3", "c")], "docid string, passage string")
    got = {r.query_id: r.passages for r in attach_passages(df, lookup).collect()}
    assert got == {1: ["a", "b"], 2: ["c", "a"], 3: []}
    with pytest.raises(Exception, match="missing passage id d3"):
        attach_passages(df, lookup.filter("docid <> 'd3'")).collect()


def test_one_answer_and_token_list_per_id(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 0), (2, "z", 5)], "query_id long, answer string, line long")
    assert sorted((r.query_id, r.answer) for r in attach_answer(q, a, order="line").collect()) == [(1, "x"), (2, "z")]
    with pytest.raises(Exception, match="missing answer"):
        attach_answer(q, a.filter("query_id = 1")).collect()
    t = spark.createDataFrame([(1, [1, 2]), (1, [1, 2])], "query_id long, input_ids array<int>")
    assert attach_tokens(q.filter("query_id = 1"), t, "query_id").count() == 1
    with pytest.raises(Exception, match="missing tokens"):
        attach_tokens(q, t, "query_id").collect()


def test_search_keeps_k_of_tied_scores(spark):
    p = spark.range(5000).selectExpr("id AS pid", "array(0D, 0D) AS embedding")
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 2.0])], "qid long, embedding array<double>")
    got = knn_exact(q, p, 10, p_block_rows=700, tile_bytes=1 << 14).collect()
    assert sorted((r.qid, r.rank, r.pid) for r in got) == [(i, r + 1, r) for i in (1, 2) for r in range(10)]


@pytest.mark.parametrize("bad", [None, [float("nan"), 1.0], [None, 1.0]])
def test_search_rejects_unsound_vectors(spark, bad):
    q = spark.createDataFrame([(1, [1.0, 2.0])], "qid long, embedding array<double>")
    p = spark.createDataFrame([(1, [1.0, 2.0]), (2, bad)], "pid long, embedding array<double>")
    with pytest.raises(Exception, match="NaN"):
        knn_exact(q, p, 1, dim=2).collect()


def test_repeated_pairs_fail_in_trec_evaluation(spark):
    run = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0)], "qid long, pid string, score double")
    qrels = spark.createDataFrame([(1, "a", 1)], "qid long, pid string, rel int")
    assert trec_per_query(run, qrels).count() == 1
    for r, q in ((run.union(run), qrels), (run, qrels.union(qrels))):
        with pytest.raises(Exception, match="repeated pair"):
            trec_per_query(r, q).collect()


def test_duplicates_with_text_ids(spark):
    run = spark.createDataFrame([Row(qid="q", pid="d"), Row(qid="q", pid="d"), Row(qid="q", pid="0"), Row(qid="q", pid="0")])
    assert [tuple(r) for r in check_duplicates(run).collect()] == [("q", "d", 2)]


def test_cache_needs_a_finished_write(spark, tmp_path):
    path = str(tmp_path / "cache")
    io.cached_dataset(spark, path, lambda: spark.range(1000))
    (tmp_path / "cache" / "_SUCCESS").unlink()
    next(f for f in (tmp_path / "cache").iterdir() if f.name.startswith("part-")).unlink()
    assert io.cached_dataset(spark, path, lambda: spark.range(1000)).count() == 1000


def test_a_gathered_step_shares_its_negatives(spark):
    from labelrank.operators.vectors import gather_batches, in_batch_scores
    w, b, g = 2, 4, 3
    q = spark.createDataFrame([(i, j, [1.0, float(j)]) for i in range(4) for j in range(b)], "batch_id long, q_idx long, q_vec array<double>")
    p = spark.createDataFrame([(i, j, [1.0, float(j)]) for i in range(4) for j in range(b * g)], "batch_id long, p_idx long, p_vec array<double>")
    s = in_batch_scores(gather_batches(q, w, b, g), gather_batches(p, w, b, g))
    n = s.groupBy("batch_id").count().collect()
    assert {r.batch_id: r["count"] for r in n} == {0: (w * b) * (w * b * g), 1: (w * b) * (w * b * g)}
