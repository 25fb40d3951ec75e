"""Registered queries: readers and writers as round trips.

Each query writes a table derived from the driver tables under the shared
scratch folder (``spark.checkpoint.dir``), reads it back with the library
reader and returns the parsed rows; the oracle is SQL over the source table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from labelrank.operators.metrics import eval_msmarco
from labelrank.operators.vectors import tokenize_corpus
from labelrank.plans import fixtures as fx
from labelrank.plans.catalog_eval import _msmarco_sql
from labelrank.plans.catalog_sampling import TR_CTES, tr_hard, tr_negatives, tr_positives
from labelrank.plans.catalog_vectors import d_tok_ids
from labelrank.plans.oracle import sql
from labelrank.plans.registry import register
from labelrank.session import scratch_path
from labelrank.sources import files as io

CLEAN = r"[\t\n\r]"


def _clean(c):
    return F.regexp_replace(c, CLEAN, " ")


def d_clean(x):
    return f"regexp_replace({x}, '[\\t\\n\\r]', ' ', 'g')"


@register("read_corpus_tsv", sql(
    f"SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN lang = 'en' THEN source END AS title, {d_clean('text')} AS text, "
    "CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS \"offset\" FROM documents"))
def q_read_corpus_tsv(spark, sf):
    """English documents as ``id \\t title \\t text``, the rest as ``id \\t text``."""
    d = fx.table(spark, sf, "documents")
    line = F.when(F.col("lang") == "en", F.concat_ws("\t", F.col("doc_id").cast("string"), "source", _clean(F.col("text")))) \
            .otherwise(F.concat_ws("\t", F.col("doc_id").cast("string"), _clean(F.col("text"))))
    path = scratch_path(spark, "corpus-tsv")
    io.write_lines(d.withColumn("__o", F.col("doc_id")), line, path, ["__o"])
    return io.read_corpus_tsv(spark, path)


@register("read_corpus_jsonl", sql("SELECT CAST(docid AS VARCHAR) AS docid, title, text FROM fx_passages"))
def q_read_corpus_jsonl(spark, sf):
    path = scratch_path(spark, "corpus-jsonl")
    fx.fx_passages(spark, sf).select(F.col("docid").cast("string").alias("docid"), "title", "text").write.json(path)
    return io.read_corpus_jsonl(spark, path)


@register("read_candidates", sql(
    "SELECT CAST(c.query_id AS VARCHAR) AS query_id, q.query, CAST(c.pos AS BIGINT) AS pos, CAST(c.docid AS VARCHAR) AS docid, "
    "c.title, c.text FROM fx_candidates c JOIN fx_candidate_queries q USING (query_id)"))
def q_read_candidates(spark, sf):
    path = scratch_path(spark, "candidates")
    lists = fx.fx_candidate_lists(spark, sf)
    lists.select(F.col("query_id").cast("string").alias("query_id"), "query", F.transform("passages", lambda p: F.struct(
        p["docid"].cast("string").alias("docid"), p["title"].alias("title"), p["text"].alias("text"))).alias("passages")) \
        .write.json(path)
    c = io.read_candidates(spark, path)
    return c.select("query_id", "query", F.posexplode("passages").alias("pos", "p")).select(
        "query_id", "query", F.col("pos").cast("bigint").alias("pos"), F.col("p.docid").alias("docid"),
        F.col("p.title").alias("title"), F.col("p.text").alias("text"))


@register("read_train_records", sql(
    "SELECT CAST(l.query_id AS VARCHAR) AS query_id, CASE WHEN l.relevance_score = 1 THEN 'positive' ELSE 'negative' END AS side, "
    "CAST(row_number() OVER (PARTITION BY l.query_id, l.relevance_score ORDER BY l.pos) - 1 AS BIGINT) AS pos, "
    "CAST(l.docid AS VARCHAR) AS docid, CASE WHEN l.relevance_score = 1 THEN c.title END AS title "
    "FROM fx_labels l JOIN fx_candidates c ON c.query_id = l.query_id AND c.pos = l.pos"))
def q_read_train_records(spark, sf):
    """Records with positives (with title) and negatives (no title field)."""
    lab = fx.fx_labels(spark, sf).join(fx.fx_candidates(spark, sf).select("query_id", "pos", "title", "text"),
                                       ["query_id", "pos"])
    g = lab.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("relevance_score") == 1, F.struct("pos", F.struct(
            F.col("docid").cast("string").alias("docid"), "title", "text").alias("p"))))).alias("pp"),
        F.array_sort(F.collect_list(F.when(F.col("relevance_score") == 0, F.struct("pos", F.struct(
            F.col("docid").cast("string").alias("docid"), "text").alias("p"))))).alias("nn"))
    rec = g.select(F.col("query_id").cast("string").alias("query_id"), F.lit("q").alias("query"),
                   F.transform("pp", lambda x: x["p"]).alias("positive_passages"),
                   F.transform("nn", lambda x: x["p"]).alias("negative_passages"))
    path = scratch_path(spark, "train-records")
    rec.write.json(path)
    r = io.read_train_records(spark, path)
    pos = r.select("query_id", F.lit("positive").alias("side"), F.posexplode("positive_passages").alias("pos", "p"))
    neg = r.select("query_id", F.lit("negative").alias("side"), F.posexplode("negative_passages").alias("pos", "p"))
    return pos.unionByName(neg).select("query_id", "side", F.col("pos").cast("bigint").alias("pos"),
                                       F.col("p.docid").alias("docid"), F.col("p.title").alias("title"))


@register("read_qrels", sql("SELECT qid, pid FROM fx_qrels_binary"))
def q_read_qrels(spark, sf):
    path = scratch_path(spark, "qrels")
    q = fx.fx_qrels_binary(spark, sf)
    io.write_lines(q, F.concat_ws("\t", F.col("qid").cast("string"), F.col("pid").cast("string")), path, ["qid", "pid"])
    return io.read_qrels(spark, path)


@register("read_qrels_trec", sql("SELECT CAST(qid AS VARCHAR) AS qid, CAST(pid AS VARCHAR) AS docid, rel FROM fx_qrels"))
def q_read_qrels_trec(spark, sf):
    path = scratch_path(spark, "qrels-trec")
    q = fx.fx_qrels(spark, sf)
    io.write_lines(q, F.concat_ws(" ", F.col("qid").cast("string"), F.lit("0"), F.col("pid").cast("string"),
                                  F.col("rel").cast("string")), path, ["qid", "pid"])
    return io.read_qrels_trec(spark, path)


@register("read_positives", sql(
    "SELECT CAST(qid AS VARCHAR) AS qid, CAST(dense_rank() OVER (ORDER BY qid) - 1 AS BIGINT) AS idx, CAST(pos AS BIGINT) AS pos, "
    "CAST(docid AS VARCHAR) AS docid FROM tr_pos", extra=TR_CTES))
def q_read_positives(spark, sf):
    pos = tr_positives(spark, sf)
    lines = pos.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "docid"))).alias("s"))
    path = scratch_path(spark, "positives")
    io.write_lines(lines, F.concat(F.col("qid").cast("string"), F.lit("\t"), F.array_join(
        F.transform("s", lambda x: x["docid"].cast("string")), ",")), path, ["qid"])
    return io.read_positives(spark, path)


@register("read_negatives", sql(
    "SELECT CAST(qid AS VARCHAR) AS qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY part, pos) - 1 AS BIGINT) AS pos, "
    "CAST(docid AS VARCHAR) AS docid FROM (SELECT qid, 0 AS part, pos, docid FROM tr_hard UNION ALL "
    "SELECT qid, 1, pos, docid FROM tr_neg WHERE qid IN (SELECT qid FROM tr_hard))", extra=TR_CTES))
def q_read_negatives(spark, sf):
    """Two lines per query (hard negatives, then the next group's candidates) concatenate."""
    hard = tr_hard(spark, sf)
    neg = tr_negatives(spark, sf).join(hard.select("qid").distinct(), "qid", "left_semi")
    parts = hard.withColumn("part", F.lit(0)).unionByName(neg.withColumn("part", F.lit(1)))
    lines = parts.groupBy("qid", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "docid"))).alias("s"))
    path = scratch_path(spark, "negatives")
    io.write_lines(lines, F.concat(F.col("qid").cast("string"), F.lit("\t"), F.array_join(
        F.transform("s", lambda x: x["docid"].cast("string")), ",")), path, ["qid", "part"])
    return io.read_negatives(spark, path)


@register("read_teacher_scores", sql(
    "SELECT CAST(c.query_id AS VARCHAR) AS qid, CAST(c.docid AS VARCHAR) AS did, "
    "CASE WHEN l.quality = 1 THEN 0.5 ELSE CAST(l.quality AS DOUBLE) END AS score "
    "FROM fx_candidates c JOIN labels l ON l.doc_id = c.docid"))
def q_read_teacher_scores(spark, sf):
    """Two files: every labelled pair as ``qid did [quality]``, then overrides for
    the positives (``0.5``); the later file wins."""
    c = fx.fx_candidates(spark, sf).join(fx.table(spark, sf, "labels").select(F.col("doc_id").alias("docid"), "quality"), "docid")
    p1, p2 = scratch_path(spark, "teacher1"), scratch_path(spark, "teacher2")
    io.write_lines(c, F.concat_ws(" ", F.col("query_id").cast("string"), F.col("docid").cast("string"),
                                  F.concat(F.lit("["), F.col("quality").cast("double").cast("string"), F.lit("]"))), p1,
                   ["query_id", "docid"])
    io.write_lines(c.filter(F.col("quality") == 1), F.concat_ws(" ", F.col("query_id").cast("string"),
                                                                F.col("docid").cast("string"), F.lit("0.5")), p2,
                   ["query_id", "docid"])
    return io.read_teacher_scores(spark, [p1, p2])


RUN_SQL = "SELECT qid, pid, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM fx_run"


def _written_run(spark, sf):
    path = scratch_path(spark, "ranking")
    io.write_ranking(fx.fx_run(spark, sf, ordered=True), path, in_order=True, compression="gzip")
    return path


@register("write_ranking", sql(RUN_SQL))
def q_write_ranking(spark, sf):
    """The ranking TSV parsed back field by field."""
    path = _written_run(spark, sf)
    f = F.split(F.col("value"), "\t", -1)
    return spark.read.text(path).select(F.get(f, 0).cast("bigint").alias("qid"), F.get(f, 1).cast("bigint").alias("pid"),
                                        F.get(f, 2).cast("bigint").alias("rank"),
                                        F.round(F.get(f, 3).cast("double"), 6).alias("score"))


@register("read_run", sql(RUN_SQL))
def q_read_run(spark, sf):
    r = io.read_run(spark, _written_run(spark, sf))
    return r.select("qid", "pid", "rank", F.round("score", 6).alias("score"))


@register("write_trec_run", sql(
    "SELECT CAST(qid AS VARCHAR) AS qid, CAST(pid AS VARCHAR) AS docid, CAST(rank AS BIGINT) AS rank, "
    "round(score, 6) AS score FROM fx_run"))
def q_write_trec_run(spark, sf):
    path = scratch_path(spark, "trec-run")
    io.write_trec_run(fx.fx_run(spark, sf, ordered=True), path, in_order=True, compression="gzip")
    r = io.read_run_trec(spark, path)
    return r.select("qid", "docid", "rank", F.round("score", 6).alias("score"))


@register("read_run_trec", sql("SELECT CAST(qid AS VARCHAR) AS qid, CAST(pid AS VARCHAR) AS docid, CAST(rank AS BIGINT) AS rank "
                               "FROM fx_run"))
def q_read_run_trec(spark, sf):
    path = scratch_path(spark, "trec-run")
    io.write_trec_run(fx.fx_run(spark, sf, ordered=True), path, in_order=True, compression="gzip")
    return io.read_run_trec(spark, path).select("qid", "docid", "rank")


@register("write_id_map", sql("SELECT CAST(doc_id AS VARCHAR) AS id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) "
                              "AS \"offset\" FROM documents"))
def q_write_id_map(spark, sf):
    from labelrank.operators.ranking import global_index
    ids = global_index(fx.fx_passages(spark, sf).select(F.col("docid").alias("id")), ["id"], "offset")
    path = scratch_path(spark, "id-map")
    io.write_id_map(ids, path)
    return io.read_id_map(spark, path)


@register("read_id_map", sql("SELECT CAST(doc_id AS VARCHAR) AS id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) "
                             "AS \"offset\" FROM documents"))
def q_read_id_map(spark, sf):
    """The reverse form ``offset \\t id`` read back by field (not by line order)."""
    from labelrank.operators.ranking import global_index
    ids = global_index(fx.fx_passages(spark, sf).select(F.col("docid").alias("id")), ["id"], "offset")
    path = scratch_path(spark, "id-map-rev")
    io.write_id_map(ids, path, reverse=True)
    return io.read_id_map(spark, path, reverse=True)


@register("read_vectors", sql(
    "SELECT vec_id AS id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS dim, "
    "round(CAST(unnest(embedding) AS DOUBLE), 6) AS value FROM embeddings"))
def q_read_vectors(spark, sf):
    path = scratch_path(spark, "vectors")
    io.write_vectors(fx.fx_vectors(spark, sf), path)
    v = io.read_vectors(spark, path)
    return v.select("id", F.posexplode("embedding").alias("dim", "value")).select(
        "id", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("value").cast("double"), 6).alias("value"))


@register("write_annotations", sql(
    "SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(generate_subscripts(passages_ids, 1) - 1 AS BIGINT) AS pos, "
    "CAST(unnest(passages_ids) AS VARCHAR) AS docid, relevance_output FROM fx_reply"))
def q_write_annotations(spark, sf):
    path = scratch_path(spark, "annotations")
    r = fx.fx_reply(spark, sf).select(F.col("query_id").cast("string").alias("query_id"),
                                      F.col("passages_ids").cast("array<string>").alias("passages_ids"), "relevance_output")
    io.write_annotations(r, path)
    a = spark.read.schema(io.ANNOTATION).json(path)
    return a.select("query_id", F.posexplode("passages_ids").alias("pos", "docid"), "relevance_output") \
            .withColumn("pos", F.col("pos").cast("bigint"))


@register("write_metrics", _msmarco_sql())
def q_write_metrics(spark, sf):
    """MS MARCO metrics written as ``name: value`` lines and parsed back."""
    m = eval_msmarco(fx.fx_run(spark, sf), fx.fx_qrels_binary(spark, sf))
    path = scratch_path(spark, "metrics")
    io.write_metrics(m, path)
    f = F.split(F.col("value"), ": ", 2)
    return spark.read.text(path).select(F.get(f, 0).alias("metric"), F.round(F.get(f, 1).cast("double"), 6).alias("value"))


@register("cached_dataset", sql(f"SELECT docid, array_to_string({d_tok_ids('text', 512)}, ' ') AS input_ids FROM fx_passages"))
def q_cached_dataset(spark, sf):
    """Tokenised corpus computed once into Parquet, then read from it."""
    path = scratch_path(spark, "tokenised")

    def compute():
        return tokenize_corpus(fx.fx_passages(spark, sf), "docid", "text", max_length=512)
    first = io.cached_dataset(spark, path, compute)
    again = io.cached_dataset(spark, path, compute)  # second call reads the cache
    assert first.columns == again.columns
    return again.select("docid", F.array_join(F.transform("input_ids", lambda x: x.cast("string")), " ").alias("input_ids"))


@register("write_vectors", sql(
    "SELECT vec_id AS id, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS dim, round(CAST(CAST(unnest(v) AS FLOAT) AS DOUBLE), 6) "
    "AS value FROM (SELECT vec_id, list_transform(range(64), lambda j: list_sum(list_transform(range(64), lambda i: "
    "CAST(embedding[i + 1] AS DOUBLE) * (((7 * i + 3 * j) % 11) - 5) / 10.0))) AS v FROM embeddings)"))
def q_write_vectors(spark, sf):
    """Projected vectors stored as float32 Parquet (with the row-count check), read back."""
    from labelrank.operators.vectors import formula_weights, linear_project
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    path = scratch_path(spark, "projected")
    io.write_vectors(linear_project(e, "embedding", formula_weights(64, 64)), path, "id", "projected")
    v = io.read_vectors(spark, path)
    return v.select("id", F.posexplode("embedding").alias("dim", "value")).select(
        "id", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("value").cast("double"), 6).alias("value"))
