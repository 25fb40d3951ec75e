"""Quality classifier: held-out accuracy, Gumbel top-k, edge rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import xxhash

from labelrank.llm import quality as Q


def test_held_out_labels(spark):
    """Fitted on half of the labels, judged by the other half."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fit = labels.filter("doc_id % 2 = 0")
    kept = {r[0] for r in Q.quality_sample(docs, fit).select("doc_id").collect()}
    held = labels.filter("doc_id % 2 = 1").collect()
    good = [r.doc_id in kept for r in held if r.quality == 1 and r.toxic == 0]
    toxic = [r.doc_id not in kept for r in held if r.toxic == 1]
    junk = [r.doc_id not in kept for r in held if r.quality == 0]
    print(np.mean(good), np.mean(toxic), np.mean(junk))
    assert np.mean(good) >= 0.98 and np.mean(toxic) >= 0.9 and np.mean(junk) >= 0.9


def test_gumbel_top_k(spark):
    rows = [(i, float(i % 7)) for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, log_weight double")
    keyed = df.withColumn("g", Q.F.col("log_weight") / 2 + Q.gumbel(Q.F.col("doc_id"), 1)).collect()
    want = {r.doc_id for r in sorted(keyed, key=lambda r: -r.g)[:1234]}
    got = Q.gumbel_top_k(df, 1234, "doc_id", temperature=2, seed=1)
    assert {r.doc_id for r in got.collect()} == want
    assert Q.gumbel_top_k(df, 0, "doc_id").count() == 0 and Q.gumbel_top_k(df, 9000, "doc_id").count() == 5000
    noise = np.array([r[0] for r in spark.range(20000).select(Q.gumbel(Q.F.col("id"))).collect()])
    assert abs(noise.mean() - 0.5772) < 0.03 and abs(noise.var() - np.pi ** 2 / 6) < 0.06


def test_edge_rows(spark):
    rows = [(1, None, "a", 1.0), (2, "", "b", 1.0), (None, "some words here", "c", 1.0), (3, "w " * 50_000, "d", 1.0),
            (3, "w " * 50_000, "d", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slice string, good double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 0), (2, None, 1), (3, 1, None)],
                                   "doc_id long, quality int, toxic int")
    out = Q.quality_sample(docs, labels)
    assert out.columns == ["doc_id", "text", "slice", "good", "log_weight"] and out.count() == 5
    clash = docs.withColumnRenamed("text", "body").withColumn("text", Q.F.lit(1)).withColumn("log_weight", Q.F.lit("x"))
    got = Q.quality_sample(clash, labels, text_col="body")
    assert got.count() == 5 and dict(got.dtypes)["log_weight"] == "double"
    assert Q.quality_sample(docs, labels.limit(0)).count() == 5
    assert Q.quality_sample(docs.limit(0), labels).count() == 0
    assert Q.quality_sample(docs, labels, k=2).count() == 2


def test_ratios_drop_chance():
    c = np.zeros((4, Q.BUCKETS), np.int64)
    c[0], c[1], c[2], c[3] = 100, 50, 20, 5
    c[:, 0] = 1000, 2, 1, 60     # much rarer in the target, and in bad documents
    c[:, 1] = 1000, 2, 40, 10    # rarer, but no more frequent in bad documents
    c[:, 2] = 100, 40, 1, 60     # not rarer
    r = Q.log_ratios(c, 800, 200)
    assert r[0] < -5 and not r[1:].any()
    assert not Q.log_ratios(c * 0, 0, 0).any()
    assert Q.best_cut(np.array([0.0, -1, -9, -8]), np.array([True, True, False, False])) == -4.5


def test_weight_0_survives_a_cut_close_to_0(spark, monkeypatch, caplog):
    """The noise does not drop rows that nothing speaks against."""
    monkeypatch.setattr(Q, "best_cut", lambda weights, good: -0.001)
    docs = spark.createDataFrame([(i, None if i % 3 == 0 else "" if i % 3 == 1 else f"clean words {i}") for i in range(300)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    with caplog.at_level("INFO", logger=Q.__name__):
        kept = Q.quality_sample(docs, labels).collect()
    assert len(kept) == 300 and {r.log_weight for r in kept} == {0.0}
    assert "cut -0.001" in caplog.text
    monkeypatch.setattr(Q, "best_cut", lambda weights, good: 0.5)
    assert Q.quality_sample(docs, labels).count() < 50


def plain_grams(text):
    """N-grams as strings and tuples, with no hashing."""
    def kind(c):
        marks = "!.,?|#$%&*"
        return ("lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if "0" <= c <= "9"
                else c if c in marks else "other")
    out, shapes, last = [], [], None
    for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        low, upper, size = word.lower(), sum("A" <= c <= "Z" for c in word), len(word)
        out.append(("word", low))
        out += [("begin", n, low[:n]) for n in (4, 6, 8) if size > n]
        case = "none" if not upper else "most" if 2 * upper >= size else "some"
        shapes.append((kind(word[0]), kind(word[-1]), case, sum(size > x for x in (2, 5, 10, 30)), low == last))
        last = low
    return out + [("shapes", *t) for t in zip(shapes, shapes[1:], shapes[2:])]


def spark_hash(seed, i):
    """xxhash64(seed, i) of an int or string and a long, in Python."""
    first = seed.encode() if isinstance(seed, str) else seed.to_bytes(4, "little")
    return xxhash.xxh64_intdigest(i.to_bytes(8, "little"), xxhash.xxh64_intdigest(first, 42))


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def test_sample_against_plain_python(spark):
    """Weights, cut, k and the draw from strings and sorted lists; nothing of the operator's own code."""
    rng = random.Random(5)
    good = [f"{a}{b}" for a in ("stone", "River", "cloud", "ash") for b in ("", "s", "like", "wards")]
    bad = ["BUY!", "now!!", "FREE$$$", "click", "winner#1"]
    docs, labels = [], []
    for i in range(600):
        share = rng.choice([0, 0, 0, 0, 0.02, 0.3, 0.8])
        text = " ".join(rng.choice(bad if rng.random() < share else good) for _ in range(rng.randint(0, 90)))
        docs.append((i, text))
        if i % 2:
            labels.append((i, int(share < 0.1), int(share == 0.3 and rng.random() < 0.5)))
    target = {i: q == 1 and t == 0 for i, q, t in labels}
    held = {i for i in target if signed(spark_hash("fold", i)) % 5 == 0}
    raw, tgt, in_good, in_bad, grams = Counter(), Counter(), Counter(), Counter(), {}
    for i, text in docs:
        grams[i] = plain_grams(text)
        raw.update(grams[i])
        if i in target and i not in held:
            (in_good if target[i] else in_bad).update(set(grams[i]))
            if target[i]:
                tgt.update(grams[i])
    n_good = sum(target[i] for i in target if i not in held)
    n_bad = len(target) - len(held) - n_good
    ratio = {}
    for g, n in raw.items():
        b, a, share = in_bad[g], in_good[g], n_bad / (n_good + n_bad)
        log = math.log((tgt[g] + 0.5) / (n * sum(tgt.values()) / sum(raw.values()) + 0.5))
        chance = 2 * ((b * math.log(b / ((a + b) * share)) if b else 0)
                      + (a * math.log(a / ((a + b) * (1 - share))) if a else 0))
        if chance >= 15 and b > (a + b) * share and log <= -1.6:
            ratio[g] = log
    weight = {i: 100 * math.fsum(ratio.get(g, 0) for g in gs) / max(20, len(gs)) for i, gs in grams.items()}
    values = sorted({weight[i] for i in held})
    cuts = [values[0] - 1] + [(x + y) / 2 for x, y in zip(values, values[1:])]
    ok, junk = [weight[i] for i in held if target[i]], [weight[i] for i in held if not target[i]]
    gain = [2 * sum(w >= c for w in ok) / len(ok) + sum(w < c for w in junk) / len(junk) for c in cuts]
    best = [c for c, x in zip(cuts, gain) if x >= max(gain) - 1e-12]
    cut = best[len(best) // 2]
    assert cut < 0 and ratio
    k, temperature = sum(w > cut for w in weight.values()), min(0.02, -cut / 20)

    def key(i):
        u = (signed(spark_hash(42, i)) % (1 << 53) + 0.5) / (1 << 53)
        return weight[i] / temperature - math.log(-math.log(u))
    want = set(sorted(weight, key=key, reverse=True)[:k])
    report = {}
    got = Q.quality_sample(spark.createDataFrame(docs, "doc_id long, text string"),
                           spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), report=report).collect()
    assert abs(report["cut"] - cut) < 1e-6 and 0 < k < len(docs)
    assert {r.doc_id for r in got} == want
    assert all(abs(r.log_weight - weight[r.doc_id]) < 1e-6 for r in got)
    assert all(i in want for i, w in weight.items() if w == 0)
