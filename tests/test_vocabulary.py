"""Corpus vocabulary and encoding against plain Python."""

from collections import Counter

import pytest

from labelrank.operators import vocabulary as V

SCHEMA = "docid long, text string"


def corpus():
    rows = [(i, " ".join(["the"] * 30 + [f"w{i % 7}", f"rare{i}", "Öl", "öl"])) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, "  "), (None, "the end"), (5, "the the"), (5, "the the"), (103, "a " * 50_000)]


def pieces(text):
    return [t for t in (text or "").lower().split(" ") if t]


def ranked(rows):
    n = Counter(t for _, text in rows for t in pieces(text))
    order = sorted(n, key=lambda t: (-n[t], t.encode()))
    return {t: (n[t], i + 3) for i, t in enumerate(order)}


def test_vocabulary(spark):
    rows = corpus()
    got = {r.token: (r.n, r.token_id) for r in V.build_vocabulary(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert got == ranked(rows)


@pytest.mark.parametrize("common", [0, 2, 1000])
@pytest.mark.parametrize("longest", [None, 31])
def test_encoding(spark, common, longest):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    vocabulary = V.build_vocabulary(df)
    ids = ranked(rows)
    want = sorted((str(d), [ids[t][1] for t in pieces(x)[:longest]]) for d, x in rows)
    got = V.encode_with_vocabulary(df, "docid", vocabulary, max_length=longest, common=common)
    assert sorted((str(r.docid), list(r.input_ids)) for r in got.collect()) == want


def test_unknown_tokens(spark):
    vocabulary = V.build_vocabulary(spark.createDataFrame([(1, "a b a")], SCHEMA))
    df = spark.createDataFrame([(1, "b x a", 7)], SCHEMA + ", token_id int")
    assert V.encode_with_vocabulary(df, "docid", vocabulary).first().input_ids == [4, 3]
    assert V.encode_with_vocabulary(df, "docid", vocabulary, unknown_id=1).first().input_ids == [4, 1, 3]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    vocabulary = V.build_vocabulary(none)
    assert vocabulary.collect() == [] and V.encode_with_vocabulary(none, "docid", vocabulary).collect() == []
    one = spark.createDataFrame([(1, "x")], SCHEMA)
    assert V.encode_with_vocabulary(one, "docid", vocabulary).first().input_ids == []
