"""Registered queries over whole runs, 1000 deep.

The keys ``offset_to_id``, ``apply_permutation`` and ``retrieve_files`` keep their shallower or
unbounded SQL; these are the same operators at the depth that runs have.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from labelrank.functions import replies as R
from labelrank.models import OverlapRanker
from labelrank.operators import lookup as LK
from labelrank.operators.knn import knn_exact
from labelrank.operators.ranking import global_index
from labelrank.operators.vectors import hashed_bow_encode
from labelrank.plans import fixtures as fx
from labelrank.plans import jobs as J
from labelrank.plans.catalog_jobs import OVERLAP_CTES
from labelrank.plans.catalog_vectors import bow_ctes
from labelrank.plans.oracle import sql
from labelrank.plans.registry import register
from labelrank.plans.rerank import rerank_windows, window_starts
from labelrank.session import scratch_path, write_once

#: The hits that a reply may move; those before and behind stay.
CUT_START, CUT_END = 10, 100


@register("offset_to_id_run", sql("SELECT qid, pid, CAST(rank AS BIGINT) AS rank FROM fx_run"))
def q_offset_to_id_run(spark, sf):
    """Search over row offsets at the depth of a run, then offsets -> ids."""
    v = fx.fx_vectors(spark, sf)
    ids = global_index(v.select("id"), ["id"], "offset")
    rows = v.join(ids, "id")
    run = knn_exact(rows.select(F.col("id").alias("qid"), "embedding"), rows.select("offset", "embedding"), fx.RUN_DEPTH,
                    p_id="offset")
    return (LK.offset_to_id(run, ids.withColumnRenamed("id", "pid"), "offset", "pid")
            .select("qid", "pid", F.col("rank").cast("bigint").alias("rank")))


RETRIEVE_CTES = bow_ctes("SELECT 'q' AS side, query_id AS id, query AS text FROM fx_queries UNION ALL "
                         "SELECT 'p', docid, text FROM fx_passages") + [
    ("f32", "SELECT side, id, b, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM bow_vec"),
    ("shared", "SELECT q.id AS qid, p.id AS pid, sum(q.v * p.v) AS score FROM f32 q JOIN f32 p ON q.side = 'q' AND p.side = 'p' "
               "AND q.b = p.b GROUP BY q.id, p.id"),
    ("every", "SELECT q.query_id AS qid, p.docid AS pid, coalesce(s.score, 0) AS score FROM fx_queries q CROSS JOIN fx_passages p "
              "LEFT JOIN shared s ON s.qid = q.query_id AND s.pid = p.docid")]


@register("retrieve_ranking", sql(
    "SELECT qid, rank, round(score, 6) AS score FROM (SELECT qid, score, "
    "row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM every) "
    f"WHERE rank <= {fx.RUN_DEPTH}", extra=RETRIEVE_CTES))
def q_retrieve_ranking(spark, sf):
    """Encode every document and benchmark text, search 1000 deep, write the ranking and read it back.
    Reported are ranks and scores: which of several documents with one score stands first depends on
    the order in which an engine adds products."""
    q = fx.fx_queries(spark, sf).select(F.col("query_id").alias("qid"), F.col("query").alias("text"))
    p = fx.fx_passages(spark, sf).select(F.col("docid").alias("pid"), "text")
    run = J.retrieve(q, p, hashed_bow_encode, scratch_path(spark, "retrieve-ranking"), fx.RUN_DEPTH)
    return run.select(F.col("qid").cast("bigint").alias("qid"), F.col("rank").cast("bigint").alias("rank"),
                      F.round("score", 6).alias("score"))


@register("apply_permutation_cut", sql(
    "SELECT h.qid, h.slot, coalesce(m.pid, h.pid) AS pid, h.rank, round(h.score, 6) AS score "
    "FROM hits h LEFT JOIN moved m ON m.qid = h.qid AND m.slot = h.slot",
    extra=[("hits", "SELECT qid, CAST(rank - 1 AS BIGINT) AS slot, pid, CAST(rank AS BIGINT) AS rank, score FROM fx_run"),
           ("cut", f"SELECT qid, slot - {CUT_START} AS x, pid FROM hits WHERE slot >= {CUT_START} AND slot < {CUT_END}"),
           ("rep", "SELECT qid, string_agg('[' || (x + 1) || ']', ' > ' ORDER BY pid DESC) FILTER (WHERE x % 4 <> 1) || ' [0] [91]' AS reply "
                   "FROM cut GROUP BY qid"),
           ("m", "SELECT qid, count(*) AS m FROM cut GROUP BY qid"),
           ("nums", "SELECT r.qid, m.m, unnest(list_transform(regexp_extract_all(r.reply, '[0-9]+'), "
                    "lambda x: TRY_CAST(x AS BIGINT) - 1)) AS x, generate_subscripts(regexp_extract_all(r.reply, '[0-9]+'), 1) AS i "
                    "FROM rep r JOIN m USING (qid)"),
           ("valid", "SELECT qid, x, min(i) AS i FROM nums WHERE x >= 0 AND x < m GROUP BY qid, x"),
           ("vpos", "SELECT qid, x, row_number() OVER (PARTITION BY qid ORDER BY i) - 1 AS j FROM valid"),
           ("nvalid", "SELECT qid, count(*) AS nv FROM valid GROUP BY qid"),
           ("missing", "SELECT h.qid, h.x, coalesce(n.nv, 0) + row_number() OVER (PARTITION BY h.qid ORDER BY h.x) - 1 AS j "
                       "FROM cut h LEFT JOIN nvalid n USING (qid) WHERE NOT EXISTS (SELECT 1 FROM valid v WHERE v.qid = h.qid AND v.x = h.x)"),
           ("perm", "SELECT qid, x, j FROM vpos UNION ALL SELECT qid, x, j FROM missing"),
           ("moved", f"SELECT p.qid, p.j + {CUT_START} AS slot, h.pid FROM perm p JOIN cut h ON h.qid = p.qid AND h.x = p.x")]))
def q_apply_permutation_cut(spark, sf):
    """Whole runs; replies name three quarters of the hits 10 to 99 in descending order of id, and two
    numbers out of range.  Hits outside the cut stay."""
    # the replies and the cut read the hits several times, each with its own filter: the search runs once
    hits = write_once(fx.fx_run(spark, sf).select("qid", (F.col("rank") - 1).cast("bigint").alias("slot"), "pid",
                                                  F.col("rank").cast("bigint").alias("rank"), "score"), "cut-hits")
    x = F.col("slot") - CUT_START
    named = hits.filter((x >= 0) & (F.col("slot") < CUT_END) & (x % 4 != 1))
    order = F.array_sort(F.collect_list(F.struct((-F.col("pid")).alias("k"), (x + 1).alias("number"))))
    replies = named.groupBy("qid").agg(order.alias("s")).select("qid", F.concat(
        F.array_join(F.transform("s", lambda h: F.concat(F.lit("["), h["number"].cast("string"), F.lit("]"))), " > "),
        F.lit(" [0] [91]")).alias("reply"))
    out = R.apply_permutation(hits, replies, CUT_START, CUT_END, moved=("pid",))
    return out.select("qid", "slot", "pid", "rank", F.round("score", 6).alias("score"))


WINDOW, STEP, DEPTH = 8, 4, fx.CAND_GROUP + 1
STARTS = window_starts(DEPTH, WINDOW, STEP)


@register("rerank_windows", sql(
    "SELECT query_id AS qid, CAST(generate_subscripts(h, 1) - 1 AS BIGINT) AS slot, unnest(h).docid AS pid FROM rounds "
    f"WHERE round = {len(STARTS)}", extra=OVERLAP_CTES + [
        ("lists", "SELECT query_id, list({'n': n, 'docid': docid} ORDER BY pos) AS h FROM ann GROUP BY query_id"),
        ("turns", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {s})" for i, s in enumerate(STARTS)) + ") t(round, start)"),
        ("rounds", "SELECT query_id, h, 0 AS round FROM lists UNION ALL "
                   f"SELECT query_id, list_concat(h[1:start], list_transform(list_sort(list_transform(h[start + 1:start + {WINDOW}], "
                   "lambda x, i: {'less': -x.n, 'i': i, 'n': x.n, 'docid': x.docid})), lambda x: {'n': x.n, 'docid': x.docid}), "
                   f"h[start + {WINDOW} + 1:]), round + 1 FROM rounds JOIN turns USING (round)")]).replace("WITH ", "WITH RECURSIVE ", 1))
def q_rerank_windows(spark, sf):
    """Every candidate list re-ranked by windows of 8 hits, 4 apart, from the last hits to the first."""
    lists = write_once(J.formatted(fx.fx_candidate_lists(spark, sf)).select("query_id", "query", "passages_ids", J._truncated()),
                       "rerank-lists")
    z = F.posexplode(F.arrays_zip(F.col("passages_ids").alias("pid"), F.col("passages_trunc").alias("passage"))).alias("slot", "z")
    hits = lists.select(F.col("query_id").alias("qid"), z).select("qid", F.col("slot").cast("bigint").alias("slot"), "z.pid", "z.passage")
    queries = lists.select(F.col("query_id").alias("qid"), "query")
    return rerank_windows(hits, queries, OverlapRanker, DEPTH, WINDOW, STEP).select("qid", "slot", "pid")
