"""Listwise losses over a scored table ``(batch_id, q_idx, p_idx, score, target)``.

Each returns one row per batch ``(batch_id, loss)``.  Per-query log-sum-exp uses
a window max over the query's row (B*G cells, bounded) for stability.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _per_query(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("batch_id", "q_idx")
    s = df.withColumn("__m", F.max("score").over(w))
    return s.groupBy("batch_id", "q_idx").agg(
        (F.first("__m") + F.log(F.sum(F.exp(F.col("score") - F.col("__m"))))).alias("lse"),
        F.sum(F.col("target") * F.col("score")).alias("ts"),
        F.sum("target").alias("tsum"),
        F.sum(F.col("target") * F.exp(F.col("score") - F.col("__m"))).alias("__pe"),
        F.sum(F.exp(F.col("score") - F.col("__m"))).alias("__z"))


def loss_softmax(df: DataFrame) -> DataFrame:
    """Mean over queries of ``-sum t * log_softmax(s)`` (one-hot t: lse - s[target])."""
    q = _per_query(df).withColumn("l", F.col("tsum") * F.col("lse") - F.col("ts"))
    return q.groupBy("batch_id").agg(F.avg("l").alias("loss"))


def loss_multi_softmax(df: DataFrame) -> DataFrame:
    """Per-query soft cross-entropy; batch loss = sum / number of non-zero losses, 0 if none."""
    q = _per_query(df).withColumn("l", F.col("tsum") * F.col("lse") - F.col("ts"))
    return q.groupBy("batch_id").agg(
        F.coalesce(F.sum("l") / F.nullif(F.count(F.when(F.col("l") != 0, True)), F.lit(0)), F.lit(0.0)).alias("loss"))


def loss_marginal(df: DataFrame) -> DataFrame:
    """``-ln(clamp(sum softmax(s) * t, 1e-9, 1))`` averaged over queries with sum t > 0; 0 if none."""
    q = _per_query(df).withColumn("p", F.least(F.greatest(F.col("__pe") / F.col("__z"), F.lit(1e-9)), F.lit(1.0)))
    return q.groupBy("batch_id").agg(F.coalesce(F.avg(F.when(F.col("tsum") > 0, -F.log("p"))), F.lit(0.0)).alias("loss"))


def loss_hinge(df: DataFrame, margin: float = 0.5) -> DataFrame:
    """Hinge-embedding loss on ``d = 1 - s`` with ``y = 2t - 1``, mean over all cells:
    ``d`` where y != -1 plus ``max(0, margin - d)`` where y != 1."""
    d = 1 - F.col("score")
    y = 2 * F.col("target") - 1
    cell = F.when(y != 1, F.greatest(F.lit(margin) - d, F.lit(0.0))).otherwise(0.0) + F.when(y != -1, d).otherwise(0.0)
    return df.groupBy("batch_id").agg(F.avg(cell).alias("loss"))
