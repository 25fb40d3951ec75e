"""Registered queries: keyed draws, the content-addressed cache, search under a threshold."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelrank.operators import permutation as PM
from labelrank.operators.knn_threshold import knn_threshold
from labelrank.operators.vectors import tokenize_corpus
from labelrank.plans import catalog_sampling as CS
from labelrank.plans import fixtures as fx
from labelrank.plans.catalog_eval import RUN_OUT_SQL
from labelrank.plans.catalog_vectors import d_tok_ids
from labelrank.plans.oracle import sql
from labelrank.plans.registry import register
from labelrank.session import scratch_path
from labelrank.sources.cache import content_cache

RUN_K = 100


def permuted_sql(body: str, draws: str, key: str) -> str:
    """``body`` over ``image(qid, j, off)``: the network's rounds as a recursion over ``draws`` (qid, j)."""
    def mixed(half):
        return CS.d_hash60(str(CS.SEED), str(CS.EPOCH), *([] if key == "order" else ["qid"]), repr(key), "i % rounds", half)
    arrived = "(i > 0 AND i % rounds = 0 AND l + r * a < n)"
    return "WITH RECURSIVE " + sql("", extra=CS.TR_CTES)[len("WITH "):] + f""",
size AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS root FROM tr_corpus),
net AS (SELECT n, a, (n + a - 1) // a AS b, CASE WHEN n < {PM.SMALL} THEN {PM.SMALL_ROUNDS} ELSE {PM.ROUNDS} END AS rounds FROM (SELECT n, unnest(range(root, least(2 * root, root + {PM.TRIES - 1},
    greatest(root, n // 2)) + 1)) AS a FROM size) ORDER BY a * ((n + a - 1) // a), a LIMIT 1),
walk AS (SELECT qid, j, j % a AS l, j // a AS r, 0 AS i, n, a, b, rounds FROM ({draws}), net
  UNION ALL SELECT qid, j, CASE WHEN i % 2 = 0 THEN (l + {mixed('r')}) % a ELSE l END,
    CASE WHEN i % 2 = 1 THEN (r + {mixed('l')}) % b ELSE r END, i + 1, n, a, b, rounds FROM walk WHERE NOT {arrived}),
image AS (SELECT qid, j, l + r * a AS off FROM walk WHERE {arrived})
{body}"""


@register("keyed_negatives", permuted_sql(
    "SELECT qid, CAST(j AS BIGINT) AS j, docid FROM image JOIN tr_corpus c ON c.\"offset\" = image.off",
    "SELECT qid, unnest(range(0, 30)) AS j FROM tr_q", "rand"))
def q_keyed_negatives(spark, sf):
    """30 distinct random corpus ids per training query, by a keyed permutation of the corpus."""
    qidx, *_rest, corpus, n = CS.tr_inputs(spark, sf)
    return PM.keyed_negatives(qidx.select("qid", F.lit(30).alias("k")), corpus, n_corpus=n)


@register("corpus_permutation", permuted_sql(
    "SELECT c.docid, CAST(image.off AS BIGINT) AS position FROM image JOIN tr_corpus c ON c.\"offset\" = image.j",
    "SELECT 0 AS qid, \"offset\" AS j FROM tr_corpus", "order"))
def q_corpus_permutation(spark, sf):
    """The whole corpus in a seeded order: the place of every document."""
    *_rest, corpus, n = CS.tr_inputs(spark, sf)
    return PM.permuted_order(corpus, n, seed=CS.SEED, epoch=CS.EPOCH).select("docid", "position")


@register("content_cache", sql(f"SELECT docid, array_to_string({d_tok_ids('text', 512)}, ' ') AS input_ids FROM fx_passages"))
def q_content_cache(spark, sf):
    """Tokenised corpus under the name of its inputs and parameters; the second call reads it."""
    root, length = scratch_path(spark, "content-cache"), 512

    def tokens():
        return tokenize_corpus(fx.fx_passages(spark, sf), "docid", "text", max_length=length)

    def cached(compute):
        return content_cache(spark, root, compute, tokens().schema, [f"{sf.rstrip('/')}/documents.parquet"],
                             {"max_length": length})
    cached(tokens)
    again = cached(lambda: (_ for _ in ()).throw(RuntimeError("computed twice")))
    return again.select("docid", F.array_join(F.transform("input_ids", lambda x: x.cast("string")), " ").alias("input_ids"))


@register("knn_threshold", sql(RUN_OUT_SQL.format(src="fx_run100k"), extra=[(
    "fx_run100k", "SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank, "
                  f"score FROM fx_scores QUALIFY rank <= {RUN_K}")]))
def q_knn_threshold(spark, sf):
    """Every embedding against every embedding, 100 deep, candidates cut by a bound of the k-th score."""
    v = fx.fx_vectors(spark, sf)
    run = knn_threshold(v.withColumnRenamed("id", "qid"), v.withColumnRenamed("id", "pid"), RUN_K, passage_blocks=8)
    return run.select("qid", "pid", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))
