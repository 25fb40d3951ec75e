"""Stand-in inputs derived from the driver tables, whole tables only.

Every row of ``documents`` / ``embeddings`` is used; grouping is by fixed-size
id blocks so each group is bounded while the number of groups grows with the
data.  The DuckDB twins of these views live in ``labelrank.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelrank.operators.knn import knn_exact
from labelrank.operators.ranking import global_index
from labelrank.session import table

# fixed fixture parameters
CAND_GROUP = 16      # candidate passages per annotation query
QREL_FANOUT = 3      # judged neighbours per query vector
RUN_DEPTH = 1000     # depth of the evaluation run


def fx_passages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("docid"), F.col("source").alias("title"), "text")


def fx_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def fx_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Long form: every document is a candidate of query ``doc_id div 16``, and the first
    document of a block also of the query before (shared candidates), at a dense 0-based
    position (window over a group of at most 17 rows)."""
    own = table(spark, sf, "documents").withColumn("query_id", F.expr(f"doc_id div {CAND_GROUP}"))
    shared = own.filter((F.col("doc_id") % CAND_GROUP == 0) & (F.col("query_id") > 0)) \
                .withColumn("query_id", F.col("query_id") - 1)
    d = own.unionByName(shared)
    w = Window.partitionBy("query_id").orderBy("doc_id")
    return d.select("query_id", (F.row_number().over(w) - 1).cast("bigint").alias("pos"),
                    F.col("doc_id").alias("docid"), F.col("source").alias("title"), "text")


def fx_candidate_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Query text of every candidate group.  Groups and benchmark items are numbered in
    order and paired round-robin until every group has an item and every item is used;
    a group with several items joins their texts."""
    groups = global_index(fx_candidates(spark, sf).select("query_id").distinct(), ["query_id"], "g")
    items = global_index(fx_queries(spark, sf).withColumnRenamed("query_id", "item_id"), ["item_id"], "i")
    n_groups, n_items = groups.count(), items.count()  # single-row metadata
    m = spark.range(max(n_groups, n_items)).select(
        F.col("id").alias("m"), F.pmod("id", F.lit(max(1, n_groups))).alias("g"),
        F.pmod("id", F.lit(max(1, n_items))).alias("i"))
    texts = m.join(groups, "g").join(items, "i").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("m", "query"))).alias("s"))
    return texts.select("query_id", F.array_join(F.transform("s", lambda x: x["query"]), " ").alias("query"))


def fx_candidate_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Nested candidates ``(query_id, query, passages array<struct<docid,title,text>>)``."""
    c = fx_candidates(spark, sf)
    lists = c.groupBy("query_id").agg(F.array_sort(F.collect_list(
        F.struct("pos", "docid", "title", "text"))).alias("__p"))
    lists = lists.select("query_id", F.transform("__p", lambda s: F.struct(
        s["docid"].alias("docid"), s["title"].alias("title"), s["text"].alias("text"))).alias("passages"))
    return fx_candidate_queries(spark, sf).join(lists, "query_id")


def fx_labels(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("docid"), "quality")
    return (fx_candidates(spark, sf).select("query_id", "pos", "docid")
            .join(labels, "docid", "left")
            .select("query_id", "pos", "docid",
                    F.coalesce(F.col("quality"), F.lit(0)).cast("int").alias("relevance_score")))


def _quirk(q: F.Column, r: F.Column, variants: tuple) -> F.Column:
    expr = F.when(F.pmod(q, F.lit(5)) == 0, r)
    for i, v in enumerate(variants, start=1):
        expr = expr.when(F.pmod(q, F.lit(5)) == i, v)
    return expr


def fx_reply(spark: SparkSession, sf: str) -> DataFrame:
    """Selection replies: ``My selection:[[p],...].`` listing the labelled positives
    (1-based), with a quirk by ``query_id mod 5``: none, ``[0]`` appended, ``[99]``
    appended, repeated, or a reasoning prefix."""
    lab = fx_labels(spark, sf)
    g = lab.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "docid"))).alias("__s"),
        F.array_sort(F.collect_list(F.when(F.col("relevance_score") == 1, F.col("pos")))).alias("__pos"))
    r = F.concat(F.lit("My selection:["),
                 F.array_join(F.transform("__pos", lambda p: F.concat(F.lit("["), (p + 1).cast("string"), F.lit("]"))), ","),
                 F.lit("]."))
    q = F.col("query_id")
    return g.select("query_id", F.transform("__s", lambda s: s["docid"]).alias("passages_ids"),
                    _quirk(q, r, (F.concat(r, F.lit("[0]")), F.concat(r, F.lit("[99]")), F.concat(r, r),
                                  F.concat(F.lit("<think>maybe [2]</think>"), r))).alias("relevance_output"))


def fx_rank_reply(spark: SparkSession, sf: str) -> DataFrame:
    """Ranking replies ``[i] > [j] > ...`` ordered by ``md5(docid)``, with quirks."""
    lab = fx_labels(spark, sf)
    g = lab.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "docid"))).alias("__s"),
        F.array_sort(F.collect_list(F.struct(F.md5(F.col("docid").cast("string")).alias("h"),
                                             F.col("pos")))).alias("__o"))
    r = F.array_join(F.transform("__o", lambda s: F.concat(F.lit("["), (s["pos"] + 1).cast("string"), F.lit("]"))), " > ")
    q = F.col("query_id")
    return g.select("query_id", F.transform("__s", lambda s: s["docid"]).alias("passages_ids"),
                    _quirk(q, r, (F.concat(r, F.lit(" > [0]")), F.concat(r, F.lit(" > [99]")),
                                  F.concat(r, F.lit(" > "), r),
                                  F.concat(F.lit("<think>[3] first</think>"), r))).alias("utility_ranking"))


def fx_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def fx_run(spark: SparkSession, sf: str, depth: int = RUN_DEPTH, ordered: bool = False) -> DataFrame:
    """Self-search of every embedding against every embedding, top ``depth``; ``ordered`` as in ``knn_exact``."""
    v = fx_vectors(spark, sf)
    return knn_exact(v.withColumnRenamed("id", "qid"), v.withColumnRenamed("id", "pid"), depth, ordered=ordered)


def fx_qrels(spark: SparkSession, sf: str) -> DataFrame:
    """Graded judgements: each vector judges its next ``QREL_FANOUT`` ids (when they
    exist): grade ``1 + pid mod 3`` when the labels agree, else 0 (kept)."""
    v = fx_vectors(spark, sf)
    q = v.select(F.col("id").alias("qid"), F.col("label").alias("ql"),
                 F.explode(F.sequence(F.lit(1), F.lit(QREL_FANOUT))).alias("j")) \
         .withColumn("pid", F.col("qid") + F.col("j"))
    p = v.select(F.col("id").alias("pid"), F.col("label").alias("pl"))
    return q.join(p, "pid").select(
        "qid", "pid", F.when(F.col("ql") == F.col("pl"), 1 + F.pmod(F.col("pid"), F.lit(3)))
        .otherwise(0).cast("int").alias("rel"))


def fx_qrels_binary(spark: SparkSession, sf: str) -> DataFrame:
    """Two-column qrels (relevant pairs only)."""
    return fx_qrels(spark, sf).filter(F.col("rel") > 0).select("qid", "pid")
