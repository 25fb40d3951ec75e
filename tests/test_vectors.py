"""Tokenizer plug-ins, record tokenisation, and the pool -> project -> normalise chain."""

import numpy as np
from pyspark.sql import functions as F

from labelrank.operators import vectors as V


class LengthTokenizer:
    """One id per piece: its length."""

    def encode(self, texts, max_length):
        return [[len(p) for p in t.split(" ")][:max_length] for t in texts]


PASSAGE = "array<struct<docid:string,title:string,text:string>>"


def records(spark):
    return spark.createDataFrame(
        [("q1", "what is it", [("d1", "T", "a bb ccc")], [("d2", None, "dd"), ("d3", "U V", "e")])],
        f"query_id string, query string, positive_passages {PASSAGE}, negative_passages {PASSAGE}")


def test_tokenizer_plug_in_with_titles(spark):
    df = spark.createDataFrame([(1, "T", "a bb"), (2, None, "ccc")], "docid long, title string, text string")
    out = V.tokenize_corpus(df, "docid", "text", "title", True, max_length=5, tokenizer_factory=LengthTokenizer)
    assert {r.docid: r.input_ids for r in out.collect()} == {1: [len("T[SEP]a"), 2], 2: [3]}


def test_records_by_plug_in_and_stand_in(spark):
    got = {(r.side, r.pos): (r.docid, r.input_ids) for r in V.tokenize_records(
        records(spark), 2, 3, tokenizer_factory=LengthTokenizer).collect()}
    assert got == {("query", 0): (None, [4, 2]), ("positive", 0): ("d1", [7, 2, 3]), ("negative", 0): ("d2", [2]),
                   ("negative", 1): ("d3", [1, 7])}
    assert V.tokenize_records(records(spark)).filter("size(input_ids) > 0").count() == 4


def test_chain_with_mask(spark):
    rng = np.random.default_rng(0)
    x, keep = rng.normal(size=(3, 5, 4)), np.array([[1, 1, 0, 0, 0], [1, 0, 1, 0, 1], [1, 1, 1, 1, 1]])
    rows = [(s, t, x[s, t].tolist(), int(keep[s, t])) for s in range(3) for t in range(5)]
    rows.append((9, 0, [1.0] * 4, 0))  # nothing left of this sequence
    tokens = spark.createDataFrame(rows, "seq long, t long, vec array<double>, mask int")
    w = V.formula_weights(4, 6)
    out = V.linear_project(V.pool_mean(tokens, "seq", "vec", "mask"), "embedding", w)
    got = {r.seq: np.array(r.v) for r in out.select("seq", V.l2_normalize(F.col("projected")).alias("v")).collect()}
    assert sorted(got) == [0, 1, 2]
    for s in range(3):
        y = (x[s] * keep[s][:, None]).sum(0) / keep[s].sum() @ w
        np.testing.assert_allclose(got[s], y / np.linalg.norm(y), rtol=1e-9)
