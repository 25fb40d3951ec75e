"""Retrieval from files on a corpus of more than 1,000 documents."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as E
from labelrank.operators.vectors import hashed_bow_encode
from labelrank.plans import jobs as J
from labelrank.session import scratch_path
from tools.check_oracle import rows_of

N = 1300


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    """Documents and benchmark items that share their words, so that nearly all pairs score above 0.1."""
    rng, root = np.random.default_rng(5), tmp_path_factory.mktemp("retrieve")
    words = np.array([f"w{i}" for i in range(40)])
    texts = [" ".join(rng.choice(words, 30)) for _ in range(N)]
    texts[7] = "apart"  # a tail that scores low
    pq.write_table(pa.table({"doc_id": range(N), "text": texts, "lang": ["en"] * N, "source": ["s"] * N,
                             "n_chars": [len(t) for t in texts]}), root / "documents.parquet")
    pq.write_table(pa.table({"item_id": range(3), "text": [" ".join(rng.choice(words, 30)) for _ in range(3)]}),
                   root / "benchmark.parquet")
    return str(root)


def test_every_pair_above_the_bar(spark, corpus):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{corpus}/{t}.parquet')")
    df = E.queries()["retrieve_files"](spark, corpus)
    rel = con.sql(E.oracle_sql()["retrieve_files"])
    got, want = [tuple(r) for r in df.collect()], rel.fetchall()
    assert len(want) > 3 * 1000
    assert rows_of(df.columns, got) == rows_of(rel.columns, want)


def test_ranking_of_the_reference_depth(spark, corpus):
    """1000 deep, tail and low scores included, against brute force."""
    p = spark.read.parquet(f"{corpus}/documents.parquet").selectExpr("doc_id as pid", "text")
    q = spark.read.parquet(f"{corpus}/benchmark.parquet").selectExpr("item_id as qid", "text")
    got = {(r.qid, r["rank"]): (r.pid, r.score)
           for r in J.retrieve(q, p, hashed_bow_encode, scratch_path(spark, "retrieve-1000")).collect()}
    pv = sorted((r.pid, r.embedding) for r in hashed_bow_encode(p, "pid").collect())
    for r in hashed_bow_encode(q, "qid").collect():
        s = np.array([x for _, x in pv], np.float32).astype(float) @ np.array(r.embedding, np.float32).astype(float)
        best = sorted(s, reverse=True)[:1000]
        mine = [got[r.qid, i + 1] for i in range(1000)]
        assert np.allclose([x for _, x in mine], best) and len({i for i, _ in mine}) == 1000
        assert np.allclose([s[i] for i, _ in mine], best)
    assert len(got) == 3 * 1000
