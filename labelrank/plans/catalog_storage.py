"""Registered queries: binary formats, the corpus vocabulary, resumed generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelrank.functions import prompts as P
from labelrank.models import OverlapSelector
from labelrank.operators import ledger as L
from labelrank.operators import vocabulary as V
from labelrank.operators.ranking import global_index
from labelrank.operators.vectors import tokenize_corpus
from labelrank.plans import fixtures as fx
from labelrank.plans import jobs as J
from labelrank.plans.catalog_jobs import OVERLAP_CTES
from labelrank.plans.catalog_vectors import d_tok_ids, ids_str
from labelrank.plans.oracle import sql
from labelrank.plans.registry import register
from labelrank.session import scratch_path, table, write_once
from labelrank.sources import arrow_dataset as A
from labelrank.sources import npy as N


@register("npy_vectors", sql(
    "SELECT vec_id AS id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS dim, "
    "CAST(CAST(unnest(embedding) AS FLOAT) AS DOUBLE) AS value FROM embeddings"))
def q_npy_vectors(spark, sf):
    """Embeddings written as one ``.npy`` file in order of id, read back in ranges, named by their id map."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    rows = write_once(global_index(v, ["id"], "offset"), "npy-rows")
    path = f"{scratch_path(spark, 'npy')}/vectors.npy"
    N.write_npy(rows, path)
    back = N.read_npy_vectors(spark, path, rows.select("id", "offset"))
    return back.select("id", F.posexplode("embedding").alias("dim", "value")).select(
        "id", F.col("dim").cast("bigint").alias("dim"), F.col("value").cast("double").alias("value"))


@register("arrow_dataset", sql(f"SELECT docid, array_to_string({d_tok_ids('text', 512)}, ' ') AS input_ids FROM fx_passages"))
def q_arrow_dataset(spark, sf):
    """Tokenised corpus saved as an on-disk Arrow dataset and read back by record batches."""
    path = scratch_path(spark, "dataset")
    A.write_arrow_dataset(tokenize_corpus(fx.fx_passages(spark, sf), "docid", "text", max_length=512), path)
    return A.read_arrow_dataset(spark, path).select("docid", ids_str(F.col("input_ids")).alias("input_ids"))


TOKENS = "list_filter(string_split(lower(text), ' '), lambda t: t <> '')"
VOCAB_CTES = [("vocab", "SELECT token, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, token) + 2 AS token_id "
                        f"FROM (SELECT unnest({TOKENS}) AS token FROM fx_passages) GROUP BY token")]


@register("corpus_vocabulary", sql("SELECT token, n, token_id FROM vocab", extra=VOCAB_CTES))
def q_corpus_vocabulary(spark, sf):
    return V.build_vocabulary(fx.fx_passages(spark, sf))


@register("vocabulary_encode", sql(
    "SELECT docid, coalesce(string_agg(CAST(token_id AS VARCHAR), ' ' ORDER BY pos) FILTER (WHERE token_id IS NOT NULL), '') AS input_ids "
    f"FROM (SELECT p.docid, t.pos, vocab.token_id FROM fx_passages p LEFT JOIN (SELECT docid, unnest({TOKENS}) AS token, "
    f"generate_subscripts({TOKENS}, 1) AS pos FROM fx_passages) t ON t.docid = p.docid LEFT JOIN vocab ON vocab.token = t.token) "
    "GROUP BY docid", extra=VOCAB_CTES))
def q_vocabulary_encode(spark, sf):
    """Whole texts of the corpus in ids of its own vocabulary."""
    p = fx.fx_passages(spark, sf)
    vocabulary = write_once(V.build_vocabulary(p), "vocabulary")
    return V.encode_with_vocabulary(p, "docid", vocabulary).select("docid", ids_str(F.col("input_ids")).alias("input_ids"))


@register("resumed_generation", sql(
    "SELECT query_id, 'My selection:[' || coalesce(string_agg('[' || (pos + 1) || ']', ',' ORDER BY pos) "
    "FILTER (WHERE relevance_score = 1), '') || '].' AS relevance_output, CAST(1 AS BIGINT) AS sends FROM ann GROUP BY query_id",
    extra=OVERLAP_CTES))
def q_resumed_generation(spark, sf):
    """Relevance replies in two runs over one ledger: the second has all prompts and sends only those
    that the first, with the prompts of even queries, did not answer; every prompt is sent once."""
    f = J.formatted(fx.fx_candidate_lists(spark, sf))
    prompts = write_once(f.select(
        "query_id", "query", J._truncated(), P.render_chat(P.relevance_messages(F.col("query"), F.col("passages"))).alias("prompt"))
        .withColumnRenamed("passages_trunc", "passages"), "prompts")
    ledger = scratch_path(spark, "ledger")

    def run(rows):
        return L.generate_with_ledger(rows, lambda: OverlapSelector(2), "relevance_output", ["query_id", "prompt"], ledger,
                                      context=["query", "passages"])
    run(prompts.filter("query_id % 2 = 0"))
    replies = run(prompts)
    sends = L.read_ledger(spark, ledger).select("key", "sends")
    return (replies.withColumn("key", L.prompt_key("prompt")).join(sends, "key")
            .select("query_id", "relevance_output", "sends"))
