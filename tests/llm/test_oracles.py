"""Every query that has SQL, on the smallest driver tables."""

import os

import pyarrow.parquet as pq
import pytest

from labelrank.llm import registry
from tests.llm.helpers import no_python, same_as_sql

SF = "/root/testdata/sf0.001"
registry.load_all()


@pytest.mark.parametrize("key", sorted(registry.ORACLE))
def test_query_matches_sql(spark, key):
    tables = {t: pq.read_table(f"{SF}/{t}.parquet") for t in
              ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
              if os.path.exists(f"{SF}/{t}.parquet")}
    df = registry.QUERIES[key](spark, SF)
    assert same_as_sql(df, registry.ORACLE[key], **tables)
    if key.split("_")[0] in ("op2", "op7", "op8", "op10"):
        no_python(df)
