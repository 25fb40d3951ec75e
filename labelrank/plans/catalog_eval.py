"""Registered queries: search, ranking and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelrank.operators import metrics as M
from labelrank.operators.knn import dot, knn_exact
from labelrank.operators.ranking import rank_by_score, topk_per_query
from labelrank.plans import fixtures as fx
from labelrank.plans.oracle import sql, union_metrics
from labelrank.plans.registry import register


def _run_out(df):
    return df.select("qid", "pid", F.col("rank").cast("bigint").alias("rank"),
                     F.round("score", 6).alias("score"))


def _metrics_out(df):
    return df.select("metric", F.round("value", 6).alias("value"))


RUN_OUT_SQL = "SELECT qid, pid, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM {src}"


@register("knn_exact", sql(RUN_OUT_SQL.format(src="fx_run")))
def q_knn_exact(spark, sf):
    return _run_out(fx.fx_run(spark, sf))


@register("retrieve", sql(RUN_OUT_SQL.format(src="fx_run1000"), extra=[(
    "fx_run1000", "SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank, "
                  "score FROM fx_scores QUALIFY rank <= 1000")]))
def q_retrieve(spark, sf):
    """The search step on given vectors, 1000 deep (see ``retrieve_files`` for the whole job)."""
    v = fx.fx_vectors(spark, sf)
    return _run_out(knn_exact(v.withColumnRenamed("id", "qid"), v.withColumnRenamed("id", "pid"), 1000))


@register("topk_per_query", sql(RUN_OUT_SQL.format(src="fx_run") + " WHERE rank <= 10"))
def q_topk(spark, sf):
    run = fx.fx_run(spark, sf).drop("rank")
    return _run_out(topk_per_query(run, 10))


@register("rank_by_score", sql("""
    SELECT qid, pid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS BIGINT) AS rank,
           round(score, 6) AS score
    FROM (SELECT r.qid, r.pid, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
          FROM fx_qrels r JOIN fx_vec a ON a.id = r.qid JOIN fx_vec b ON b.id = r.pid)"""))
def q_rank_by_score(spark, sf):
    """Score each judged pair by inner product, rank per query."""
    v = fx.fx_vectors(spark, sf)
    pairs = (fx.fx_qrels(spark, sf)
             .join(v.select(F.col("id").alias("qid"), F.col("embedding").alias("qv")), "qid")
             .join(v.select(F.col("id").alias("pid"), F.col("embedding").alias("pv")), "pid")
             .select("qid", "pid", dot(F.col("qv"), F.col("pv")).alias("score")))
    return _run_out(rank_by_score(pairs))


@register("score_pairs", sql("""
    SELECT r.qid, r.pid, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
    FROM fx_qrels r JOIN fx_vec a ON a.id = r.qid JOIN fx_vec b ON b.id = r.pid"""))
def q_score_pairs(spark, sf):
    """Dot product of every (query, passage) pair that shares a key (here: the judged pair)."""
    from labelrank.operators.knn import score_pairs
    v = fx.fx_vectors(spark, sf)
    pairs = fx.fx_qrels(spark, sf).select("qid", "pid")
    qv = pairs.join(v.select(F.col("id").alias("qid"), F.col("embedding").alias("q_vec")), "qid")
    pv = v.select(F.col("id").alias("pid"), F.col("embedding").alias("p_vec"))
    return score_pairs(qv, pv, "pid").select("qid", "pid", F.round("score", 6).alias("score"))


@register("run_join_qrels", sql("""
    SELECT r.qid, r.pid, CAST(r.rank AS BIGINT) AS rank
    FROM fx_run r JOIN (SELECT DISTINCT qid, pid FROM fx_qrels_binary) q USING (qid, pid)"""))
def q_run_join_qrels(spark, sf):
    return M.run_join_qrels(fx.fx_run(spark, sf), fx.fx_qrels_binary(spark, sf)) \
            .select("qid", "pid", F.col("rank").cast("bigint").alias("rank"))


@register("qrels_restrict", sql("""
    SELECT qid, pid, rel FROM fx_qrels WHERE qid IN (
        SELECT r.qid FROM fx_run r JOIN fx_qrels_binary b USING (qid, pid) WHERE r.rank <= 10)"""))
def q_qrels_restrict(spark, sf):
    """Judgements restricted to the queries of a run; the run here is the set of
    top-10 rows that hit a relevant passage, so queries without a hit drop out."""
    run = M.run_join_qrels(fx.fx_run(spark, sf).filter(F.col("rank") <= 10), fx.fx_qrels_binary(spark, sf))
    return M.qrels_restrict(fx.fx_qrels(spark, sf), run).select("qid", "pid", "rel")


@register("check_duplicates", sql("""
    SELECT qid, pid, count(*) AS n FROM (
        SELECT qid, pid FROM fx_run UNION ALL SELECT qid, pid FROM fx_run WHERE rank <= 2)
    WHERE pid <> 0 GROUP BY qid, pid HAVING count(*) > 1"""))
def q_check_duplicates(spark, sf):
    # the second copy of a row is made beside it: a union would search and rank once for either side
    copies = F.when(F.col("rank") <= 2, F.array(F.lit(0), F.lit(100))).otherwise(F.array(F.lit(0)))
    dup = fx.fx_run(spark, sf).withColumn("__more", F.explode(copies)).withColumn("rank", F.col("rank") + F.col("__more"))
    return M.check_duplicates(dup).select("qid", "pid", F.col("n").cast("bigint").alias("n"))


def _msmarco_sql(with_acc: bool = False, acc_only: bool = False) -> str:
    ks = M.MSMARCO_CUTOFFS
    hits = ", ".join(f"count(*) FILTER (WHERE rk <= {k}) AS h{k}" for k in ks)
    sums = []
    for k in ks:
        sums.append(f"sum(CASE WHEN ranked AND first_rank <= {k} THEN 1.0 / first_rank ELSE 0 END) AS mrr{k}")
        sums.append(f"sum(CASE WHEN ranked THEN coalesce(h{k}, 0) / n_rel ELSE 0 END) AS rec{k}")
        sums.append(f"count(*) FILTER (WHERE ranked AND first_rank <= {k}) AS acc{k}")
    pairs = []
    for k in ks:
        if not acc_only:
            pairs += [(f"MRR @{k}", f"round(mrr{k} / nq, 6)"), (f"Recall @{k}", f"round(rec{k} / nq, 6)")]
        if with_acc:
            pairs.append((f"ACC @{k}", f"round(acc{k} / nq, 6)"))
    if not acc_only:
        pairs.append(("QueriesRanked", "(SELECT count(DISTINCT qid) FROM fx_run)"))
    body = union_metrics("tot", pairs)
    return sql(body, extra=[
        ("qb", "SELECT qid, pid FROM fx_qrels_binary"),
        ("nrel", "SELECT qid, count(*) AS n_rel FROM qb GROUP BY qid"),
        ("hit", "SELECT r.qid, r.pid, min(r.rank) AS rk FROM fx_run r JOIN (SELECT DISTINCT qid, pid FROM qb) p "
                "USING (qid, pid) GROUP BY r.qid, r.pid"),
        ("hq", f"SELECT qid, min(rk) AS first_rank, {hits} FROM hit GROUP BY qid"),
        ("pq", "SELECT n.qid, n.n_rel, h.*, n.qid IN (SELECT qid FROM fx_run) AS ranked FROM nrel n "
               "LEFT JOIN hq h USING (qid)"),
        ("tot", f"SELECT count(*) AS nq, {', '.join(sums)} FROM pq"),
    ])


@register("eval_msmarco", _msmarco_sql())
def q_eval_msmarco(spark, sf):
    return _metrics_out(M.eval_msmarco(fx.fx_run(spark, sf), fx.fx_qrels_binary(spark, sf)))


@register("eval_acc", _msmarco_sql(with_acc=True, acc_only=True))
def q_eval_acc(spark, sf):
    return _metrics_out(M.eval_acc(fx.fx_run(spark, sf), fx.fx_qrels_binary(spark, sf)))


def _trec_sql(ks, names_filter=None) -> str:
    kmax = max(ks)
    run_aggs, ideal_aggs, out = [], [], []
    for k in ks:
        run_aggs += [
            f"sum(CASE WHEN rk <= {k} AND g > 0 THEN g / log2(rk + 1) ELSE 0 END) AS dcg{k}",
            f"sum(CASE WHEN rk <= {k} AND hit = 1 THEN cum / rk ELSE 0 END) AS ap{k}",
            f"sum(CASE WHEN rk <= {k} THEN hit ELSE 0 END) AS hits{k}",
            f"max(CASE WHEN rk <= {k} AND hit = 1 THEN 1.0 / rk ELSE 0 END) AS rr{k}",
        ]
        ideal_aggs.append(f"sum(CASE WHEN ir <= {k} THEN g / log2(ir + 1) ELSE 0 END) AS idcg{k}")
    cols = []
    for k in ks:
        cols += [f"CASE WHEN coalesce(idcg{k}, 0) > 0 THEN dcg{k} / idcg{k} ELSE 0 END AS ndcg{k}",
                 f"CASE WHEN num_rel > 0 THEN ap{k} / num_rel ELSE 0 END AS map{k}",
                 f"CASE WHEN num_rel > 0 THEN hits{k} / num_rel ELSE 0 END AS recall{k}",
                 f"rr{k} AS mrr{k}"]
    pairs = ([(f"NDCG@{k}", f"round(avg(ndcg{k}), 5)") for k in ks]
             + [(f"MAP@{k}", f"round(avg(map{k}), 5)") for k in ks]
             + [(f"Recall@{k}", f"round(avg(recall{k}), 5)") for k in ks]
             + [(f"MRR@{k}", f"round(avg(mrr{k}), 5)") for k in ks])
    if names_filter:
        pairs = [p for p in pairs if p[0].startswith(names_filter)]
    return sql(union_metrics("pq", pairs), extra=[
        ("judged", "SELECT qid, pid, rel AS g FROM fx_qrels"),
        ("top1", "SELECT r.qid, r.pid, row_number() OVER (PARTITION BY r.qid ORDER BY r.score DESC, "
                 "CAST(r.pid AS VARCHAR) DESC) AS rk FROM fx_run r WHERE r.qid IN (SELECT qid FROM judged)"),
        ("top2", f"SELECT t.qid, t.rk, coalesce(j.g, 0) AS g, CASE WHEN coalesce(j.g, 0) >= 1 THEN 1 ELSE 0 END AS hit "
                 f"FROM top1 t LEFT JOIN judged j USING (qid, pid) WHERE t.rk <= {kmax}"),
        ("top3", "SELECT *, sum(hit) OVER (PARTITION BY qid ORDER BY rk ROWS UNBOUNDED PRECEDING) AS cum FROM top2"),
        ("per_run", f"SELECT qid, {', '.join(run_aggs)} FROM top3 GROUP BY qid"),
        ("ideal", "SELECT qid, g, row_number() OVER (PARTITION BY qid ORDER BY g DESC) AS ir FROM judged WHERE g > 0"),
        ("per_ideal", f"SELECT qid, {', '.join(ideal_aggs)} FROM ideal GROUP BY qid"),
        ("nrel", "SELECT qid, count(*) FILTER (WHERE g >= 1) AS num_rel FROM judged GROUP BY qid"),
        ("pq", f"SELECT per_run.qid, {', '.join(cols)} FROM per_run JOIN nrel USING (qid) "
               f"LEFT JOIN per_ideal USING (qid)"),
    ])


@register("eval_trec", _trec_sql(M.TREC_CUTOFFS))
def q_eval_trec(spark, sf):
    return _metrics_out(M.eval_trec(fx.fx_run(spark, sf), fx.fx_qrels(spark, sf)))


@register("eval_mrr_at_k", _trec_sql(M.TREC_CUTOFFS, names_filter="MRR"))
def q_eval_mrr(spark, sf):
    return _metrics_out(M.eval_mrr_at_k(fx.fx_run(spark, sf), fx.fx_qrels(spark, sf)))


@register("mean_over_queries", _trec_sql(M.TREC_CLI_CUTOFFS))
def q_mean_over_queries(spark, sf):
    """Per-query TREC metrics at the CLI cut-offs, averaged and rounded to 5 digits."""
    per_q = M.trec_per_query(fx.fx_run(spark, sf), fx.fx_qrels(spark, sf), M.TREC_CLI_CUTOFFS)
    return _metrics_out(M.mean_over_queries(per_q, M.trec_metric_names(M.TREC_CLI_CUTOFFS)))


@register("rank_list_stats", sql("""
    SELECT n.qid, CAST(n.n_relevant AS BIGINT) AS n_relevant, CAST(coalesce(i.n_intersection, 0) AS BIGINT) AS n_intersection
    FROM (SELECT qid, count(*) AS n_relevant FROM (SELECT DISTINCT qid, pid FROM fx_qrels_binary) GROUP BY qid) n
    LEFT JOIN (SELECT qid, count(*) AS n_intersection FROM (SELECT DISTINCT r.qid, r.pid FROM fx_run r
               JOIN (SELECT DISTINCT qid, pid FROM fx_qrels_binary) q USING (qid, pid) WHERE r.rank <= 10)
               GROUP BY qid) i USING (qid)"""))
def q_rank_list_stats(spark, sf):
    out = M.rank_list_stats(fx.fx_run(spark, sf), fx.fx_qrels_binary(spark, sf), 10)
    return out.select("qid", F.col("n_relevant").cast("bigint").alias("n_relevant"),
                      F.col("n_intersection").cast("bigint").alias("n_intersection"))


@register("group_lists", sql("""
    SELECT qid, CAST(0 AS BIGINT) AS chunk, string_agg(CAST(pid AS VARCHAR), ',' ORDER BY rel DESC, pid) AS items
    FROM fx_qrels GROUP BY qid"""))
def q_group_lists(spark, sf):
    q = fx.fx_qrels(spark, sf).withColumn("neg_rel", -F.col("rel"))
    out = M.group_lists(q, "qid", "pid", ["neg_rel", "pid"])
    return out.select("qid", "chunk", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))
