"""Containment search: edits, long documents, edge rows."""

import random

import pyarrow as pa

from labelrank.llm import decontaminate as D
from tests.llm.helpers import same_as_sql


def frames(spark, docs, items):
    d = spark.createDataFrame([(*r, 5, "h") for r in docs], "doc_id long, text string, item int, hash string")
    return d, spark.createDataFrame(items, "item_id long, text string")


def test_against_sql(spark):
    rng = random.Random(8)

    def some(n):
        return [rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([3, 5, 6, 9, 14, 40, 120])))) for i in range(40)] + [(40, ""), (41, None), (3, "a b c d e f")]
    docs = []
    for i in range(150):
        words = some(rng.choice([0, 2, 30, 3000]))
        for _ in range(rng.randint(0, 3)):
            passage = (rng.choice(items)[1] or "").split()
            passage = [w if rng.random() > 0.03 else "edit" for w in passage]
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() + "," for w in passage] if rng.random() < 0.5 else passage
        docs.append((i, " ".join(words)))
    docs += [(200, None), (201, ""), (1, docs[1][1]), (202, items[5][1])]
    d, b = frames(spark, docs, items)
    docs = list(dict.fromkeys(docs))
    got = same_as_sql(D.contained_items(d.distinct(), b), D.ORACLE,
                      documents=pa.table({"doc_id": [r[0] for r in docs], "text": [r[1] for r in docs]}),
                      benchmark=pa.table({"item_id": [r[0] for r in items], "text": [r[1] for r in items]}))
    assert len(got) > 50


def test_shuffled_sides(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    d, b = frames(spark, [(1, "x a b c d e f y"), (None, "a b c d e f"), (1, "x a b c d e f y")], [(7, "a b c d e f"), (None, "a b c d e")])
    got = sorted(map(tuple, D.contained_items(d, b).collect()), key=repr)
    assert got == sorted([(1, 7, 2, 2), (1, 7, 2, 2), (None, 7, 2, 2), (1, None, 1, 1), (1, None, 1, 1), (None, None, 1, 1)], key=repr)


def test_empty_tables(spark):
    d, b = frames(spark, [], [(1, "a b c d e")])
    assert D.contained_items(d, b).collect() == []
    d, b = frames(spark, [(1, "a b c d e")], [])
    assert D.contained_items(d, b).collect() == []


def test_only_shingles_in_reach_of_a_class_are_joined(spark, monkeypatch):
    """A document is searched with the classes that it is long enough for, each with its own threshold."""
    seen = []
    real = D.shingles_in_reach

    def spy(words, classes, k, percent):
        out = real(words, classes, k, percent)
        seen.append((dict(classes), out.select(D.F.size("words").alias("n"), "hash").collect()))
        return out
    monkeypatch.setattr(D, "shingles_in_reach", spy)
    words = [f"w{i}" for i in range(600)]
    d, b = frames(spark, [(1, " ".join(words)), (2, " ".join(words[:30])), (3, " ".join(words[:12]))],
                  [(1, " ".join(words[:14])), (2, " ".join(words[100:400]))])
    assert sorted((r[0], r[1]) for r in D.contained_items(d, b).collect()) == [(1, 1), (1, 2), (2, 1), (3, 1)]
    classes, hits = seen[0]
    assert sorted(classes) == [10, 296]
    for n in (600, 30, 12):
        limit = max(top for least, top in classes.items() if 100 * (n - 4) >= 80 * least)
        assert all(r["hash"] <= limit for r in hits if r.n == n)
    seen.clear()
    short, _ = frames(spark, [(4, " ".join(words[:11]))], [(0, "")])
    assert D.contained_items(short, b).collect() == []
    assert seen[0][1] == []


def test_words_are_made_once(spark):
    """The plan holds the regular expression once, however many size classes there are."""
    d, _ = frames(spark, [(1, "a b c d e f g h")], [])
    words = d.select("doc_id", D.normal_words(D.F.col("text")).alias("words"))
    hits = D.shingles_in_reach(words, [(3, 10), (20, 99), (70, 500), (300, 9000)], 5, 80)
    hits = hits.join(spark.range(9).select(D.F.col("id").alias("hash")), "hash")
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(D.STRIP) == 1


def test_item_shingles_have_their_own_bound(spark, monkeypatch):
    d, b = frames(spark, [(1, "x a b c d e f y"), (2, "none of it here at all")], [(7, "a b c d e f")])
    want = [(1, 7, 2, 2)]
    assert [tuple(r) for r in D.contained_items(d, b).collect()] == want
    monkeypatch.setattr(D, "BROADCAST_CHARS", 0)
    assert [tuple(r) for r in D.contained_items(d, b).collect()] == want
