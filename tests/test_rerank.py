"""Window re-ranking against a plain loop over lists."""

import random

import pandas as pd
import pytest

from labelrank.models import OverlapRanker
from labelrank.plans.rerank import rerank_windows, window_starts


def test_windows():
    assert window_starts(100, 20, 10) == [80, 70, 60, 50, 40, 30, 20, 10, 0]
    assert window_starts(25, 20, 10) == [5, 0] and window_starts(20, 20, 20) == [0] and window_starts(5, 20, 10) == [0]
    assert window_starts(0, 20, 10) == []
    with pytest.raises(ValueError):
        window_starts(10, 4, 5)


def shared(query, passage):
    return len(set(query.lower().split(" ")) & set(passage.lower().split(" ")))


def loop(query, hits, depth, window, step):
    """Order each window by shared words, from the tail to the head."""
    hits = list(hits)
    end = min(depth, len(hits)) if len(hits) >= depth else depth
    while True:
        start = max(0, end - window)
        part = hits[start:min(start + window, depth)]
        hits[start:start + len(part)] = sorted(part, key=lambda h: -shared(query, h[1]))
        if start == 0:
            return hits
        end -= step


@pytest.mark.parametrize("depth,window,step", [(100, 20, 10), (95, 20, 7), (30, 40, 5)])
def test_against_a_loop(spark, depth, window, step):
    rnd, rows, want = random.Random(depth), [], {}
    queries = [(q, " ".join(rnd.sample("abcdefghij", 5))) for q in range(6)]
    for q, text in queries:
        n = [100, 110, 57, 20, 3, 1][q]
        hits = [(1000 * q + i, " ".join(rnd.choices("abcdefghijklmnop", k=6))) for i in range(n)]
        rows += [(q, i, i + 1, 1.0 / (i + 1), *h) for i, h in enumerate(hits)]
        want[q] = loop(text, hits, depth, window, step)
    df = spark.createDataFrame(rows, "qid long, slot long, rank long, score double, pid long, passage string").repartition(3)
    out = rerank_windows(df, spark.createDataFrame(queries, "qid long, query string"), OverlapRanker, depth, window, step).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.qid, r.slot)):
        assert r["rank"] == r.slot + 1 and r.score == 1.0 / (r.slot + 1)
        got.setdefault(r.qid, []).append((r.pid, r.passage))
    assert got == want


class Silent:
    def generate(self, batch: pd.DataFrame) -> pd.Series:
        return pd.Series(["no order"] * len(batch), index=batch.index)


def test_replies_without_numbers_and_missing_queries(spark, tmp_path):
    rows = [(q, i, f"d{q}-{i}", f"x {i}") for q in (1, None) for i in range(7)]
    df = spark.createDataFrame(rows, "qid long, slot long, pid string, passage string")
    none = spark.createDataFrame([], "qid long, query string")
    for ledger in (None, str(tmp_path / "l")):
        out = rerank_windows(df.filter("qid is not null"), none, Silent, 6, 3, 2, ledger=ledger)
        assert sorted(map(tuple, out.collect())) == sorted(r for r in rows if r[0] is not None)
    assert rerank_windows(df.limit(0), none, Silent, 6, 3, 2).collect() == []
