"""Queries that number rows, against their oracles at sf0.01 with few and many partitions."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from labelrank.plans.registry import ORACLE, QUERIES, load_all
from tools.check_oracle import TABLES, rows_of

load_all()
SF = "/root/testdata/sf0.01"
NUMBERED = [k for k in ("read_negatives", "read_positives", "read_corpus_tsv", "train_order", "dense_offsets", "group_lists",
                        "write_id_map", "build_training", "build_training_files", "gather_batches", "random_negatives")
            if k in QUERIES]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("parts", ["2", "16"])
@pytest.mark.parametrize("key", NUMBERED)
def test_same_rows_for_any_partitioning(spark, con, key, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = E.queries()[key](spark, SF)
        cols, rows = df.columns, [tuple(r) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rel = con.sql(ORACLE[key])
    assert rows_of(cols, rows) == rows_of(rel.columns, rel.fetchall())
