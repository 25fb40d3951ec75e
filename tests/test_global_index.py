"""Global positions far beyond the sample that range partitioning takes, with payload columns."""

import pytest
from pyspark.sql import functions as F

from labelrank.operators.ranking import global_index, position_within, train_order

N = 200_000


@pytest.mark.parametrize("reuse", ["true", "false"])
@pytest.mark.parametrize("parts", [2, 8, 32])
def test_exact_positions_with_payload(spark, parts, reuse):
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        df = spark.range(N).select(F.xxhash64("id").alias("key"), F.concat(F.lit("payload "), F.col("id")).alias("text"))
        got = global_index(df, ["key"], "idx", parts).select("key", "idx").toPandas().sort_values("idx")
        assert got["idx"].tolist() == list(range(N))
        assert got["key"].is_monotonic_increasing
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")


def test_train_order_is_a_permutation(spark):
    df = spark.range(50_000).select(F.col("id").alias("idx"), F.lit("x").alias("payload"))
    out = train_order(df).agg(F.countDistinct("order"), F.min("order"), F.max("order")).first()
    assert tuple(out) == (50_000, 0, 49_999)


def test_positions_within_a_hot_key(spark):
    df = spark.range(60_000).select(F.when(F.col("id") < 50_000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("key"),
                                    F.col("id").alias("line"), F.lit("text").alias("payload"))
    out = position_within(df, "key", ["line"])
    w = out.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.min("pos").alias("a"), F.max("pos").alias("b"))
    assert all(r.n == r.d == r.b + 1 and r.a == 0 for r in w.collect())


def test_empty(spark):
    assert global_index(spark.range(0).withColumn("x", F.lit(1)), ["id"]).collect() == []
