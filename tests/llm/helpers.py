"""Comparing a query with its DuckDB text on given rows."""

import duckdb

from tools.check_oracle import rows_of


def same_as_sql(df, sql, **tables):
    con = duckdb.connect()
    for name, arrow in tables.items():
        con.register(name, arrow)
    rel = con.sql(sql)
    got, want = [tuple(r) for r in df.collect()], rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, got) == rows_of(rel.columns, want)
    return got


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
