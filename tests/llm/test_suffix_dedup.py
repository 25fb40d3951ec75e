"""Removal of repeated strings against brute force."""

import random

import numpy as np
import pytest

from labelrank.llm import suffix_dedup as S


def brute(rows, length=100):
    """rows: (id, text), one per document, in the order of documents."""
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            if s in seen:
                gone[p:p + length] = True
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1)
        out.append((i, len(b), int(gone.sum()), len(edges), kept))
    return out


def corpus(rng):
    alphabet = ["the ", "and ", "eön ", "thor", "in", "\n", "a", "😀"]
    def some(n):
        return "".join(rng.choice(alphabet) for _ in range(n))
    passages = [some(60) for _ in range(4)] + ["MIT License. " * 12, "ab" * 80, some(20)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else some(rng.randint(0, 80)) for _ in range(rng.randint(0, 6))]
        rows.append((i, "".join(parts)))
    return rows + [(60, rows[5][1]), (61, rows[5][1]), (62, None), (63, ""), (64, "x" * 5000), (65, "x" * 99)]


def run(spark, rows):
    df = spark.createDataFrame([(*r, "u", 1) for r in rows], "doc_id long, text string, uid string, part int")
    return sorted(((r[0], r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(df).collect()),
                  key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("hot", [500_000, 1])
def test_random_corpus(spark, monkeypatch, hot):
    """Also with every repeated anchor split by its strings."""
    monkeypatch.setattr(S, "HOT", hot)
    rng = random.Random(4)
    rows = corpus(rng)
    want = brute(rows)
    assert sum(w[2] for w in want) > 5000
    shuffled = rows[:]
    rng.shuffle(shuffled)
    assert run(spark, shuffled) == want


def test_repeated_and_null_ids(spark):
    rng = random.Random(1)
    t = "".join(rng.choice("abcdef ") for _ in range(300))
    got = run(spark, [(None, t), (7, t), (7, t), (8, "short")])
    assert [g[:3] for g in got] == [(None, 300, 0), (7, 300, 300), (7, 300, 300), (8, 5, 0)]
    assert run(spark, [(7, t), (7, t)]) == [(7, 300, 0, 0, t.encode())] * 2


def test_empty_table(spark):
    assert run(spark, []) == []


def test_columns_against_sorting():
    rng = np.random.default_rng(2)
    seg = rng.integers(97, 99, (200, 176)).astype(np.uint8)
    seg[50:120, 30:150] = seg[3, 30:150]
    full = np.full(200, 76, np.uint8)
    got = S.repeated_windows(seg, full, np.full(200, 100, np.uint8), 100)
    for c in range(77):
        first = {}
        for i in range(200):
            s = seg[i, c:c + 100].tobytes()
            assert got[i, c] == (s in first)
            first.setdefault(s, i)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(tuple(r) for r in docs.select("doc_id", "text").collect())
    got = sorted(((r[0], r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(docs).collect()))
    assert got == brute(rows)


def test_parts_follow_the_segments(spark, monkeypatch):
    """A part keeps its byte bound whatever the number of shuffle partitions."""
    dealt = []
    real = S._map_segments
    monkeypatch.setattr(S, "_map_segments", lambda length, parts: dealt.append(parts) or real(length, parts))
    rows = corpus(random.Random(4))
    want = brute(rows)
    assert run(spark, rows) == want
    monkeypatch.setattr(S, "PART_BYTES", 1000)
    assert run(spark, rows) == want
    few, many = dealt
    assert few == max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))) and many > few


def test_hot_anchors_that_every_task_meets_once(spark, monkeypatch):
    """An anchor found once per batch everywhere is split, on a table of any number of rows."""
    rng = np.random.default_rng(8)

    def noise(n):
        return bytes(rng.integers(97, 123, n, np.uint8)).decode()
    passage, twice = noise(130), noise(150)
    rows = [(i, noise(60) + passage + noise(40) + (twice if i % 100 == 0 else "")) for i in range(300)]
    rows.append((300, " ".join(noise(30) + passage for _ in range(100))))  # and a long text
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(S, "HOT", 250)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        n_bytes = sum(len(t) for _, t in rows)
        hot = S._hot_anchors(df.select("text"), 100, n_bytes)
        assert 0 < len(hot) < 40  # those of the passage alone
        assert len(S._hot_anchors(df.filter("doc_id < 200").select("text"), 100, n_bytes)) == 0
        got = {r.doc_id: (r.n_removed, r.n_spans, r.kept) for r in S.remove_repeats(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute_marks(rows)


def brute_marks(rows, length=100):
    """(bytes removed, spans, kept bytes) by id, by a dictionary of all strings."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = text.encode()
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - length + 1):
            piece = data[p:p + length]
            if piece in seen:
                gone[p:p + length] = True
            seen.add(piece)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out[i] = int(gone.sum()), spans, bytes(b for b, g in zip(data, gone) if not g)
    return out
