"""Exact inner-product search in two rounds, the second under a bound of the k-th score.

Queries and passages meet in blocks as in ``knn_exact``.  Round one sends, per query and passage
block, only the block's few best scores (numbers in one array, no ids).  The k-th best of them over
all blocks can't be above the query's true k-th score.  Round two multiplies the blocks again and
sends only passages that reach this bound: about k a query in all, where one round sends up to k a
query and block.  Both rounds read one shuffle of the passages.  It pays off with many passage
blocks or a large k; with few blocks ``knn_exact`` saves the second product.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelrank.operators.knn import (_block_counts, found_rows, gathered, matrix, passage_block_rows, plain, query_block_rows,
                                     running_top, sorted_block)
from labelrank.operators.ranking import rank_by_score
from labelrank.session import ship_package


def threshold_candidates(queries: DataFrame, passages: DataFrame, k: int, *, q_id: str = "qid", p_id: str = "pid",
                         vec: str = "embedding", passage_blocks: int | None = None, query_blocks: int | None = None,
                         probe: int | None = None, block_bytes: int = 176 << 20, work_bytes: int = 192 << 20,
                         tile_bytes: int = 64 << 20) -> DataFrame:
    """(q_id, p_id, score): a superset of every query's ``k`` best passages, ties of the k-th included
    up to k a block.

    ``probe`` scores a query and block are sent in round one; the default is twice the share of a
    block in k.  A query with fewer than k scores in round one has no bound, and its k best of each
    block are sent.  Two products of one pair may differ in their last bits, so the bound is lowered
    by the largest rounding error that the vectors' norms allow."""
    spark = queries.sparkSession
    ship_package(spark)
    q = queries.select(F.col(q_id).alias("__q"), plain(F.col(vec), queries.schema[vec].dataType).alias("__qv"))
    p = passages.select(F.col(p_id).alias("__p"), plain(F.col(vec), passages.schema[vec].dataType).alias("__pv"))
    q_type, p_type = q.schema["__q"].dataType.simpleString(), p.schema["__p"].dataType.simpleString()
    nq, np_ = queries.count(), passages.count()
    if nq == 0 or np_ == 0:
        return spark.createDataFrame([], f"{q_id} {q_type}, {p_id} {p_type}, score double")
    dim = max(1, p.select(F.size("__pv")).first()[0])
    p_rows = passage_block_rows(k, dim, block_bytes)
    # either round keeps a running best and sends it, 2k at most: that sizes the query block
    q_rows = query_block_rows(min(2 * k, p_rows, np_), dim, work_bytes)
    qb, pb = _block_counts(nq, np_, q_rows, p_rows, spark.sparkContext.defaultParallelism, k, dim)
    qb, pb = query_blocks or qb, passage_blocks or pb
    few = min(k, probe or 2 * math.ceil(k / pb))

    def blocks(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))

    def dealt(df):
        return df.withColumn("qb", F.pmod(F.xxhash64("__q"), F.lit(qb))).withColumn("pb", blocks(pb))
    p_rep = p.withColumn("pb", F.pmod(F.xxhash64("__p"), F.lit(pb))).withColumn("qb", blocks(qb)).groupBy("qb", "pb")

    def best_scores(qt: pa.Table, pt: pa.Table) -> pa.Table:
        if qt.num_rows == 0 or pt.num_rows == 0:
            return pa.table([qt["__q"].slice(0, 0), pa.array([], pa.float64()), pa.array([], pa.list_(pa.float64()))],
                            names=["__q", "slack", "best"])
        qm, pm = matrix(qt["__qv"]).astype(np.float64), matrix(pt["__pv"])
        best, _, n = running_top(qm, pm, few, tile_bytes)
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(best[np.arange(best.shape[1]) < n[:, None]]))
        # dim * eps * |q| * |p| bounds the error of a product summed in any order
        longest = math.sqrt(np.einsum("ij,ij->i", pm, pm, dtype=np.float64).max())
        slack = 2 * dim * np.finfo(np.float64).eps * np.linalg.norm(qm, axis=1) * longest
        return pa.table([qt["__q"], pa.array(slack), lists], names=["__q", "slack", "best"])

    def reaching(qt: pa.Table, pt: pa.Table) -> pa.Table:
        if qt.num_rows == 0 or pt.num_rows == 0:
            return found_rows(qt["__q"].slice(0, 0), pt["__p"].slice(0, 0), np.zeros(0))
        pm, pids = sorted_block(pt)
        bound = qt["bound"].fill_null(-np.inf).to_numpy()
        best, at, n = running_top(matrix(qt["__qv"]).astype(np.float64), pm, k, tile_bytes, bound)
        return gathered(qt["__q"], pids, best, at, n)

    # a query's list holds probe * pb numbers, about 2k by default
    scores = (dealt(q).groupBy("qb", "pb").cogroup(p_rep)
              .applyInArrow(best_scores, f"__q {q_type}, slack double, best array<double>"))
    kth = F.get(F.sort_array(F.flatten(F.collect_list("best")), asc=False), F.lit(k - 1))
    bounds = scores.groupBy("__q").agg((kth - 2 * F.max("slack")).alias("bound"))
    asked = q.join(bounds.withColumnRenamed("__q", "__b"), F.col("__q").eqNullSafe(F.col("__b")), "left").drop("__b")
    return (dealt(asked).groupBy("qb", "pb").cogroup(p_rep)
            .applyInArrow(reaching, f"__q {q_type}, __p {p_type}, score double")
            .select(F.col("__q").alias(q_id), F.col("__p").alias(p_id), "score"))


def knn_threshold(queries: DataFrame, passages: DataFrame, k: int = 1000, *, q_id: str = "qid", p_id: str = "pid",
                  vec: str = "embedding", **blocks) -> DataFrame:
    """Exact top-k by inner product: the rows of ``knn_exact``, from ``threshold_candidates``.

    Returns ``(q_id, p_id, rank, score)``, ranks from 1 by score desc, then passage id asc; fewer
    than k rows when the corpus is smaller.  Query ids must be unique.  Null vectors and vectors
    with a null or NaN component fail the job; an empty side gives no rows."""
    found = threshold_candidates(queries, passages, k, q_id=q_id, p_id=p_id, vec=vec, **blocks)
    return rank_by_score(found, k, group=q_id, item=p_id, score="score", rank_col="rank").select(q_id, p_id, "rank", "score")
