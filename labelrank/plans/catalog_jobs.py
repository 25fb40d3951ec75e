"""Registered queries: lookups, export, model calls and end-to-end jobs (2.8, 2.11).

Model calls use the deterministic stand-ins of ``labelrank.models`` (a real
generator plugs in the same way); each oracle re-derives the stand-in's
decision in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from labelrank.functions import text as T
from labelrank.models import OverlapRanker, OverlapSelector, PromptLengthAnswerer
from labelrank.operators import lookup as LK
from labelrank.operators.knn import knn_exact
from labelrank.operators.ranking import global_index
from labelrank.operators.metrics import TREC_CLI_CUTOFFS
from labelrank.operators.vectors import hashed_bow_encode, tokenize_corpus
from labelrank.plans import fixtures as fx
from labelrank.plans import jobs as J
from labelrank.plans.catalog_eval import _msmarco_sql, _trec_sql
from labelrank.plans.catalog_sampling import (G, ORDER_CTE, TR_CTES, d_fill, tr_corpus, tr_hard, tr_positives,
                                              tr_qidx)
from labelrank.plans.catalog_text import (FP_CTE, FX_ANSWERS, PARSE_SEL_SQL, d_fill as d_fmt, d_lit, d_trunc,
                                          fx_answers, parsed_selection)
from labelrank.plans.catalog_vectors import bow_ctes, d_tok_ids
from labelrank.plans.oracle import sql
from labelrank.plans.registry import register
from labelrank.session import scratch_path
from labelrank.sources import files as io
from labelrank.functions import prompts as P


def _ids_long(df, ids, score, score_name):
    z = df.select("query_id", F.posexplode(F.arrays_zip(F.col(ids).alias("d"), F.col(score).alias("s"))).alias("pos", "z"))
    return z.select("query_id", F.col("pos").cast("bigint").alias("pos"), F.col("z.d").alias("docid"),
                    F.col("z.s").alias(score_name))


OVERLAP_CTES = [
    FP_CTE,
    ("qt", "SELECT DISTINCT query_id, t FROM (SELECT query_id, unnest(string_split(lower(query), ' ')) AS t "
           "FROM fx_candidate_queries)"),
    ("pt", f"SELECT DISTINCT query_id, pos, t FROM (SELECT query_id, pos, unnest(string_split(lower({d_trunc('fp')}), ' ')) "
           "AS t FROM fp_all)"),
    ("shared", "SELECT p.query_id, p.pos, count(*) AS n FROM pt p JOIN qt q ON q.query_id = p.query_id AND q.t = p.t "
               "GROUP BY p.query_id, p.pos"),
    ("ann", "SELECT f.query_id, f.pos, f.docid, f.fp, coalesce(s.n, 0) AS n, CAST(CASE WHEN coalesce(s.n, 0) >= 2 THEN 1 "
            "ELSE 0 END AS INTEGER) AS relevance_score FROM fp_all f LEFT JOIN shared s USING (query_id, pos)"),
]


def relevance_annotations(spark, sf):
    return J.annotate_relevance(fx.fx_candidate_lists(spark, sf), lambda: OverlapSelector(2),
                                materialize=scratch_path(spark, "relevance-replies"))


@register("batch_generate", sql(
    "SELECT query_id, 'My selection:[' || coalesce(string_agg('[' || (pos + 1) || ']', ',' ORDER BY pos) "
    "FILTER (WHERE relevance_score = 1), '') || '].' AS relevance_output FROM ann GROUP BY query_id", extra=OVERLAP_CTES))
def q_batch_generate(spark, sf):
    """Relevance prompts through a generator plug-in (the overlap stand-in), replies materialised."""
    return relevance_annotations(spark, sf).select("query_id", "relevance_output")


@register("annotate_relevance", sql("SELECT query_id, CAST(pos AS BIGINT) AS pos, docid, relevance_score FROM ann",
                                    extra=OVERLAP_CTES))
def q_annotate_relevance(spark, sf):
    return _ids_long(relevance_annotations(spark, sf), "passages_ids", "relevance_score", "relevance_score")


def answers(spark, sf):
    return J.annotate_answer(fx.fx_candidate_lists(spark, sf), PromptLengthAnswerer,
                             materialize=scratch_path(spark, "answer-replies"))


ANSWER_PROMPT = ("'<|im_start|>user' || chr(10) || " + d_lit(P.ANSWER_SYSTEM) + " || '<|im_end|>' || chr(10) || "
                 "'<|im_start|>assistant' || chr(10) || " + d_lit(P.ANSWER_ACK) + " || '<|im_end|>' || chr(10) || "
                 "'<|im_start|>user' || chr(10) || " + d_fmt(P.ANSWER_TASK, passages="pj", query="query")
                 + " || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)")
ANSWER_CTES = [FP_CTE, ("qx2", "SELECT q.query_id, q.query, string_agg(f.fp, chr(10) ORDER BY f.pos) AS pj "
                               "FROM fx_candidate_queries q JOIN fp_all f USING (query_id) GROUP BY q.query_id, q.query"),
               ("ans", f"SELECT query_id, 'The context has ' || len(string_split({ANSWER_PROMPT}, ' ')) || ' pieces.' AS answer "
                       "FROM qx2")]


@register("annotate_answer", sql("SELECT query_id, answer FROM ans", extra=ANSWER_CTES))
def q_annotate_answer(spark, sf):
    return answers(spark, sf).select("query_id", "answer")


@register("annotate_utility", sql(
    "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS BIGINT) AS pos, docid, "
    "CAST(CASE WHEN n >= 3 THEN 1 ELSE 0 END AS INTEGER) AS utility_score FROM ann WHERE relevance_score = 1",
    extra=OVERLAP_CTES))
def q_annotate_utility(spark, sf):
    """Utility judged on the relevant passages with the stand-in at a stricter overlap (3)."""
    out = J.annotate_utility(fx.fx_candidate_lists(spark, sf), relevance_annotations(spark, sf), answers(spark, sf),
                             lambda: OverlapSelector(3), materialize=scratch_path(spark, "utility-replies"))
    return _ids_long(out, "passages_ids", "utility_score", "utility_score")


@register("rank_utility", sql(
    "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n DESC, pos) - 1 AS BIGINT) AS rank, "
    "CAST(pos AS BIGINT) AS pos, docid FROM ann", extra=OVERLAP_CTES))
def q_rank_utility(spark, sf):
    out = J.rank_utility(fx.fx_candidate_lists(spark, sf), answers(spark, sf), OverlapRanker,
                         materialize=scratch_path(spark, "ranking-replies"))
    z = out.select("query_id", F.posexplode(F.arrays_zip("ranking_score", "ranked_passage_ids")).alias("rank", "z"))
    return z.select("query_id", F.col("rank").cast("bigint").alias("rank"), F.col("z.ranking_score").alias("pos"),
                    F.col("z.ranked_passage_ids").alias("docid"))


# ---- lookups -----------------------------------------------------------------------
@register("attach_query", sql("SELECT c.query_id, c.docid, q.query || ' (v2)' AS query FROM fx_candidates c "
                              "JOIN fx_candidate_queries q USING (query_id)"))
def q_attach_query(spark, sf):
    """The queries file lists every query twice; the later line (`` (v2)``) wins."""
    q = fx.fx_candidate_queries(spark, sf)
    lines = q.withColumn("line", F.lit(0)).unionByName(
        q.withColumn("query", F.concat("query", F.lit(" (v2)"))).withColumn("line", F.lit(1)))
    c = fx.fx_candidates(spark, sf).select("query_id", "docid")
    return LK.attach_query(c, lines, order="line", strict=True).select("query_id", "docid", "query")


@register("attach_passages", sql(
    "SELECT s.query_id, CAST(row_number() OVER (PARTITION BY s.query_id ORDER BY s.pos) - 1 AS BIGINT) AS idx, f.fp AS passage "
    "FROM sel s JOIN fp_all f ON f.query_id = s.query_id AND f.pos = s.pos WHERE s.relevance_score = 1",
    extra=[FP_CTE, ("sel", PARSE_SEL_SQL)]))
def q_attach_passages(spark, sf):
    sel = parsed_selection(spark, sf).select("query_id", T.relevance_filter("passages_ids", "relevance_score").alias("ids"))
    p = fx.fx_passages(spark, sf).select("docid", T.format_passage("text", "title").alias("passage"))
    out = LK.attach_passages(sel, p, ids="ids", key="docid", value="passage", out="passages")
    return out.select("query_id", F.posexplode("passages").alias("idx", "passage")).withColumn("idx", F.col("idx").cast("bigint"))


@register("attach_answer", sql(
    "SELECT c.query_id, c.docid, CASE WHEN contains(a.answer_output, '</think>') THEN string_split(a.answer_output, "
    "'</think>')[2] ELSE a.answer_output END AS answer FROM fx_candidates c JOIN fx_answers a USING (query_id)",
    extra=[FX_ANSWERS]))
def q_attach_answer(spark, sf):
    a = fx_answers(spark, sf).select("query_id", T.strip_reasoning("answer_output").alias("answer"))
    return LK.attach_answer(fx.fx_candidates(spark, sf).select("query_id", "docid"), a).select("query_id", "docid", "answer")


@register("attach_tokens", sql(
    f"SELECT l.query_id, l.pos, CAST(len({d_tok_ids('d.text', 128)}) AS BIGINT) AS n_tokens FROM fx_labels l "
    "JOIN fx_passages d ON d.docid = l.docid WHERE l.relevance_score = 1"))
def q_attach_tokens(spark, sf):
    toks = tokenize_corpus(fx.fx_passages(spark, sf), "docid", "text", max_length=128)
    pos = fx.fx_labels(spark, sf).filter(F.col("relevance_score") == 1).select("query_id", "pos", "docid")
    return LK.attach_tokens(pos, toks).select("query_id", "pos", F.size("input_ids").cast("bigint").alias("n_tokens"))


@register("attach_teacher_scores", sql(
    "SELECT c.query_id AS qid, c.docid, coalesce(CAST(l.quality AS DOUBLE), 0.0) AS score FROM fx_candidates c "
    "LEFT JOIN labels l ON l.doc_id = c.docid"))
def q_attach_teacher_scores(spark, sf):
    """Every candidate pair; pairs without a teacher line score 0.0."""
    groups = fx.fx_candidates(spark, sf).select(F.col("query_id").alias("qid"), "docid")
    teacher = fx.fx_candidates(spark, sf).join(fx.table(spark, sf, "labels").select(F.col("doc_id").alias("docid"), "quality"),
                                               "docid").select(F.col("query_id").alias("qid"), "docid", F.col("quality").alias("score"))
    return LK.attach_teacher_scores(groups, teacher).select("qid", "docid", "score")


@register("offset_to_id", sql("SELECT qid, pid, CAST(rank AS BIGINT) AS rank FROM fx_run WHERE rank <= 10"))
def q_offset_to_id(spark, sf):
    """Search over row offsets (as the index does), then offsets -> ids by a join."""
    v = fx.fx_vectors(spark, sf)
    idmap = global_index(v.select("id"), ["id"], "offset")
    vo = v.join(idmap, "id")
    run = knn_exact(vo.select(F.col("id").alias("qid"), "embedding"), vo.select("offset", "embedding"), 10,
                    p_id="offset")
    return LK.offset_to_id(run, idmap.withColumnRenamed("id", "pid"), "offset", "pid").select("qid", "pid", "rank")


# ---- export, training batches, evaluation --------------------------------------------
EXPORT_CTES = [("sel", PARSE_SEL_SQL),
               ("keepq", "SELECT DISTINCT query_id FROM sel WHERE relevance_score = 1")]


@register("export_training_sets", sql(
    "SELECT 'positives' AS file, CAST(query_id AS VARCHAR) AS qid, query_id || chr(9) || string_agg(CAST(docid AS VARCHAR), ',' "
    "ORDER BY pos) AS line FROM sel WHERE relevance_score = 1 GROUP BY query_id "
    "UNION ALL SELECT 'negatives', CAST(query_id AS VARCHAR), query_id || chr(9) || string_agg(CAST(docid AS VARCHAR), ',' ORDER BY pos) "
    "FROM sel WHERE relevance_score = 0 AND query_id IN (SELECT query_id FROM keepq) GROUP BY query_id "
    "UNION ALL SELECT 'teacher', CAST(query_id AS VARCHAR), query_id || ' ' || docid || ' ' || CASE WHEN relevance_score = 1 "
    "THEN '1.0' ELSE '0.0' END FROM sel WHERE query_id IN (SELECT query_id FROM keepq)", extra=EXPORT_CTES))
def q_export_training_sets(spark, sf):
    files = J.export_training_sets(parsed_selection(spark, sf))
    out = None
    for name, df in files.items():
        d = df.select(F.lit(name).alias("file"), "qid", "line")
        out = d if out is None else out.unionByName(d)
    return out


BT_CTES = TR_CTES + [ORDER_CTE, ("sel", PARSE_SEL_SQL),
                     ("rot", "SELECT p.qid, p.pos, p.docid FROM tr_pos p JOIN (SELECT q.qid, (q.idx + 42 + 0) % c.n AS pick "
                             "FROM tr_q q JOIN (SELECT qid, count(*) AS n FROM tr_pos GROUP BY qid) c USING (qid)) r "
                             "ON r.qid = p.qid AND r.pick = p.pos")] \
    + d_fill("bt", "SELECT qid, 2 AS part, pos, docid FROM tr_hard WHERE pos < 200 AND qid IN (SELECT qid FROM tr_q)",
             f"SELECT qid, {G - 1} AS k FROM tr_q", "rotate") + [
    ("grp", "SELECT qid, 0 AS slot, docid FROM rot UNION ALL SELECT qid, 1 + j, docid FROM bt_fill"),
    ("gs", "SELECT g.qid, g.slot, g.docid, coalesce(CAST(s.relevance_score AS DOUBLE), 0.0) AS score FROM grp g "
           "LEFT JOIN sel s ON s.query_id = g.qid AND s.docid = g.docid"),
    ("gb", f"SELECT g.*, o.\"order\" // 4 AS batch_id, o.\"order\" % 4 AS q_idx, (o.\"order\" % 4) * {G} + g.slot AS p_idx, "
           f"list_concat([1], {d_tok_ids('d.text', None)}[1:126], [2]) AS t FROM gs g JOIN ord o USING (qid) "
           "JOIN fx_passages d ON d.docid = g.docid"),
]


@register("build_training", sql(
    "SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(q_idx AS BIGINT) AS q_idx, CAST(p_idx AS BIGINT) AS p_idx, qid, docid, "
    "round(score, 6) AS score, CAST(max(len(t)) OVER (PARTITION BY batch_id) AS BIGINT) AS n_tokens, "
    "CAST(len(t) AS BIGINT) AS n_real FROM gb", extra=BT_CTES))
def q_build_training(spark, sf):
    """Annotations -> training files -> rotate groups (G=8) -> teacher scores -> batches (B=4) -> padded ids."""
    sel = parsed_selection(spark, sf)
    z = sel.select("query_id", F.posexplode(F.arrays_zip("passages_ids", "relevance_score")).alias("pos", "z"))
    teacher = z.select(F.col("query_id").alias("qid"), F.col("z.passages_ids").alias("docid"),
                       F.col("z.relevance_score").cast("double").alias("score"))
    out = J.build_training(tr_positives(spark, sf), tr_hard(spark, sf), tr_corpus(spark, sf), fx.fx_passages(spark, sf),
                           teacher, tr_qidx(spark, sf), G, 4, n_corpus=fx.fx_passages(spark, sf).count())
    return out.select("batch_id", "q_idx", "p_idx", "qid", "docid", F.round("score", 6).alias("score"),
                      F.size("input_ids").cast("bigint").alias("n_tokens"),
                      F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_real"))


@register("evaluate", _msmarco_sql())
def q_evaluate(spark, sf):
    """Ranking TSV + qrels TSV files -> MS MARCO metrics, written and returned."""
    run_path, qrels_path = scratch_path(spark, "eval-run"), scratch_path(spark, "eval-qrels")
    io.write_ranking(fx.fx_run(spark, sf, ordered=True), run_path, in_order=True, compression="gzip")
    q = fx.fx_qrels_binary(spark, sf)
    io.write_lines(q, F.concat_ws("\t", F.col("qid").cast("string"), F.col("pid").cast("string")), qrels_path, ["qid", "pid"])
    m = J.evaluate(spark, run_path, qrels_path, scratch_path(spark, "eval-metrics"))
    return m.select("metric", F.round("value", 6).alias("value"))


FILES_CTES = [("sel", "SELECT query_id, pos, docid, relevance_score FROM fx_labels") if n == "sel" else (n, q)
              for n, q in BT_CTES]


@register("build_training_files", sql(
    "SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(q_idx AS BIGINT) AS q_idx, CAST(p_idx AS BIGINT) AS p_idx, "
    "CAST(qid AS VARCHAR) AS qid, CAST(docid AS VARCHAR) AS docid, round(score, 6) AS score, "
    "CAST(max(len(t)) OVER (PARTITION BY batch_id) AS BIGINT) AS n_tokens, CAST(len(t) AS BIGINT) AS n_real FROM gb",
    extra=FILES_CTES))
def q_build_training_files(spark, sf):
    """Labels -> exported files -> read back -> groups, teacher scores, batches and padded ids."""
    lab = fx.fx_labels(spark, sf).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "docid", "relevance_score"))).alias("s"))
    annotations = lab.select("query_id", F.transform("s", lambda x: x["docid"]).alias("passages_ids"),
                             F.transform("s", lambda x: x["relevance_score"]).alias("relevance_score"))
    paths = J.write_training_sets(J.export_training_sets(annotations), scratch_path(spark, "training"))
    corpus = tr_corpus(spark, sf).withColumn("docid", F.col("docid").cast("string"))
    docs = fx.fx_passages(spark, sf).withColumn("docid", F.col("docid").cast("string"))
    out = J.build_training_from_files(spark, paths, corpus, docs, G, 4, n_corpus=docs.count())
    return out.select("batch_id", "q_idx", "p_idx", "qid", "docid", F.round("score", 6).alias("score"),
                      F.size("input_ids").cast("bigint").alias("n_tokens"),
                      F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_real"))


@register("retrieve_files", sql(
    "SELECT q.id AS qid, p.id AS pid, round(sum(q.v * p.v), 6) AS score FROM f32 q JOIN f32 p ON q.side = 'q' AND p.side = 'p' "
    "AND q.b = p.b GROUP BY q.id, p.id HAVING sum(q.v * p.v) > 0.1",
    extra=bow_ctes("SELECT 'q' AS side, query_id AS id, query AS text FROM fx_queries UNION ALL "
                   "SELECT 'p', docid, text FROM fx_passages")
    + [("f32", "SELECT side, id, b, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM bow_vec")]))
def q_retrieve_files(spark, sf):
    """Encode every document and benchmark text, search, write and read the ranking; reported are
    all pairs that score above 0.1.  The ranking is as deep as the corpus (1000 at least), so that
    no pair above the bar is cut off."""
    q = fx.fx_queries(spark, sf).select(F.col("query_id").alias("qid"), F.col("query").alias("text"))
    p = fx.fx_passages(spark, sf).select(F.col("docid").alias("pid"), "text")
    run = J.retrieve(q, p, hashed_bow_encode, scratch_path(spark, "retrieve"), max(fx.RUN_DEPTH, p.count()))
    return run.filter(F.col("score") > 0.1).select("qid", "pid", F.round("score", 6).alias("score"))


@register("evaluate_trec", _trec_sql(TREC_CLI_CUTOFFS))
def q_evaluate_trec(spark, sf):
    """TREC run file + graded qrels file -> TREC metrics at the CLI cut-offs, written and returned."""
    run_path, qrels_path = scratch_path(spark, "trec-run"), scratch_path(spark, "trec-qrels")
    io.write_trec_run(fx.fx_run(spark, sf, ordered=True), run_path, in_order=True, compression="gzip")
    q = fx.fx_qrels(spark, sf)
    io.write_lines(q, F.concat_ws(" ", F.col("qid").cast("string"), F.lit("Q0"), F.col("pid").cast("string"),
                                  F.col("rel").cast("string")), qrels_path, ["qid", "pid"])
    m = J.evaluate_trec(spark, run_path, qrels_path, scratch_path(spark, "trec-metrics"))
    return m.select("metric", F.round("value", 6).alias("value"))
