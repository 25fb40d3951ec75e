"""Ranking, top-k, global order, batching.

All per-query windows are partitioned by the query key, and every top-k is a
``row_number() <= k`` filter, which Catalyst turns into a partial
``WindowGroupLimit`` *before* the shuffle (k <= 1000), so a hot query key ships at
most k rows per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelrank.functions.hashing import hash_order
from labelrank.session import scratch_path, shuffles_removed


def rank_by_score(df: DataFrame, k: int | None = None, group: str = "qid", item: str = "pid",
                  score: str = "score", rank_col: str = "rank") -> DataFrame:
    """Per ``group``: order by score desc, item asc; ranks from 1; optionally keep the top k."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(item).asc())
    out = df.withColumn(rank_col, F.row_number().over(w))
    if k is not None:
        out = out.filter(F.col(rank_col) <= k)
    return out


def topk_per_query(df: DataFrame, k: int, group: str = "qid", item: str = "pid",
                   score: str = "score", rank_col: str = "rank") -> DataFrame:
    """Top-k rows per query by score (alias of :func:`rank_by_score` with a k)."""
    return rank_by_score(df, k, group, item, score, rank_col)


def prefix_slice(arr: Column, n: int = 200) -> Column:
    """First ``n`` entries of a list in listed order (``neg[:n]``)."""
    return F.slice(arr, 1, n)


def global_index(df: DataFrame, order_cols: list[str], name: str = "idx",
                 num_partitions: int | None = None) -> DataFrame:
    """Dense 0-based index in the total order of ``order_cols`` without a
    single-partition window.

    The frame is range-partitioned, sorted inside partitions and written once under the
    shared scratch folder, one file per partition.  A row's index is its row number inside
    its file plus the rows of the files before it.  Rows and counts both come from these
    files, so they cannot disagree however the range boundaries were sampled, and a lost
    executor only rereads them.  The counts have one row per partition.  ``order_cols``
    need a unique order for results that repeat from run to run.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "ordered")
    with shuffles_removed(spark):
        df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols).write.parquet(path)
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("bigint")
    ordered = spark.read.schema(df.schema).parquet(path)
    rows = ordered.select("*", part.alias("__part"), F.col("_metadata.row_index").alias("__row"))
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ordered.select(part.alias("__part")).groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
              .select("__part", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__start")))
    return (rows.join(F.broadcast(starts), "__part")
            .withColumn(name, F.col("__start") + F.col("__row"))
            .drop("__part", "__row", "__start"))


def position_within(df: DataFrame, key: str, order_cols: list[str], name: str = "pos") -> DataFrame:
    """Dense 0-based position of each row inside its ``key`` in ``order_cols`` order,
    without a per-key window: a global index over (key, order) minus the index of
    the key's first row (a partial-aggregated min).  A hot key is spread over
    many tasks instead of being sorted in one."""
    g = global_index(df, [key] + order_cols, "__gi")
    first = g.groupBy(key).agg(F.min("__gi").alias("__g0"))
    return g.join(first, key).withColumn(name, F.col("__gi") - F.col("__g0")).drop("__gi", "__g0")


def rotate_positive(positives: Column, idx: Column, seed: int = 42, epoch: int = 0) -> Column:
    """Positive at ``(idx + seed + epoch) mod len(positives)`` (the hash of an int is the int)."""
    return F.get(positives, F.pmod(idx + F.lit(seed) + F.lit(epoch), F.size(positives)))


def train_order(df: DataFrame, idx: str = "idx", shuffle: bool = True, seed: int = 42,
                epoch: int = 0, name: str = "order") -> DataFrame:
    """Row order for one epoch: seeded random (``md5(seed|epoch|idx)``) or sequential."""
    if not shuffle:
        return df.withColumn(name, F.col(idx))
    keyed = df.withColumn("__h", hash_order(F.lit(seed), F.lit(epoch), F.col(idx)))
    return global_index(keyed, ["__h", idx], name).drop("__h")


def assign_batches(df: DataFrame, batch_size: int, order: str = "order") -> DataFrame:
    """Consecutive batches: ``batch_id = order div B`` and the position inside the batch."""
    return (df.withColumn("batch_id", F.floor(F.col(order) / batch_size).cast("bigint"))
            .withColumn("q_idx", F.pmod(F.col(order), F.lit(batch_size)).cast("bigint")))
