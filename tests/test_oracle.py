"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from labelrank.plans.registry import ORACLE, QUERIES, load_all
from tools.check_oracle import TABLES, rows_of

SF = os.environ.get("LABELRANK_TEST_SF", "/root/testdata/sf0.001")
load_all()
KEYS = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_key_has_an_oracle():
    assert set(ORACLE) == set(KEYS) <= set(E.queries())


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["metric", "value"] and len(rows) == 11


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[key])
    o_cols, o_rows = rel.columns, rel.fetchall()
    assert sorted(s_cols) == sorted(o_cols)
    assert rows_of(s_cols, s_rows) == rows_of(o_cols, o_rows)
