"""Phrase collocations against SQL and brute force, with low thresholds on small tables."""

import random
from collections import Counter
import re

import pyarrow as pa
import pytest

from labelrank.llm import collocations as C
from tests.llm.helpers import same_as_sql

SCHEMA = "doc_id long, text string, lang string"


def some_docs(seed, n=120):
    rnd = random.Random(seed)
    words = ["a", "B", "the", "of", "Öl", "öl", "x y", "d", "e-f", "THE", "'g'"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "; ", "!", "\r\n", "\x0b", " ? "]
    rows = []
    for i in range(n):
        text = "".join(rnd.choice(words[:rnd.choice([3, 6, 11])]) + rnd.choice(ends) for _ in range(rnd.randrange(0, 60)))
        rows.append((i, text, rnd.choice(["en", "de", None])))
    return rows + [(900, None, "en"), (901, "", None), (902, " \t..", "xx"), (None, "a b the of", None), (5, "a b the of", "en")] + rows[:3]


def brute(rows, least, first):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = {}
    for (lang, p), a in cand.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p):
                    inside[lang, p[i:j]] = max(a, inside.get((lang, p[i:j]), 0))
    out = []
    for (lang, p), a in cand.items():
        if 100 * inside.get((lang, p), 0) >= 100 * a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank, res = Counter(), []
    for r in out:
        rank[r[0]] += 1
        if rank[r[0]] <= first:
            res.append((r[0], rank[r[0]], *r[1:]))
    return res


@pytest.mark.parametrize("least,first,chunk", [(2, 2000, 1 << 23), (5, 7, 64), (12, 2000, 300)])
def test_random_tables(spark, monkeypatch, least, first, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    monkeypatch.setattr(C, "PART_BYTES", 1000)
    rows = some_docs(least)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = same_as_sql(C.collocations(df, least, first), C._sql(least, first), documents=df.toArrow())
    assert sorted(got) == sorted(brute(rows, least, first)) and got


def test_chunks_cut_between_pieces():
    texts = ["ab cd", "", "e f. g h. i", None, "j" * 40 + " k", "l,m"]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    want = [[p.split() for p in re.split("[.,]", t or "")] for t in texts]
    want = [(d, w) for d, ps in enumerate(want) for p in ps for w in [tuple(p)] if p]
    for limit in (1, 4, 7, 16, 1000):
        found = []
        for data, edges, first in C._chunks(batch, limit):
            w = C._Words(data, edges, first, C._seeds(["en"] * len(texts)))
            for i in range(len(w.starts)):
                word = bytes(data[w.starts[i]:w.ends[i]]).decode()
                if w.opens[i]:
                    found.append((int(w.doc[i]), (word,)))
                else:
                    found[-1] = (found[-1][0], found[-1][1] + (word,))
        assert found == want


def test_long_text_and_products_beyond_64_bits(spark):
    rows = [(1, "new york " * 100_000 + ". old town" * 200, "en")]
    got = C.collocations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r) for r in got] == brute(rows, 100, 2000) and got
    big = spark.createDataFrame([(10 ** 13, 10 ** 14, 10 ** 13, 10 ** 13)], "a long, n long, l long, r long")
    d = {c: big[c].cast("decimal(19,0)") for c in "anlr"}
    out = big.select((d["a"] * d["n"] * 1000).alias("x"), (d["l"] * d["r"]).alias("y")).selectExpr("x div y AS s").first().s
    assert out == 1000 * 10 ** 27 // 10 ** 26


def test_empty_tables_and_clashing_columns(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert C.collocations(spark.createDataFrame([(1, None, None), (2, ".. ", "en")], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "x y. " * 100, "en", 7, "z")], SCHEMA + ", n int, phrase string")
    assert [tuple(r) for r in C.collocations(df).collect()] == [("en", 1, "x y", 100, 100, 100, 200, 2000)]
