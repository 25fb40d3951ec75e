"""N-gram Jaccard join against brute force."""

import random
import re

import pytest
from pyspark.sql import Row

from labelrank.llm.ngram_join import bands_upto, ngram_jaccard_join, plan_bands
from labelrank.llm import ngram_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k=4):
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = WORD.findall(text)
    if not w:
        return frozenset()
    if len(w) < k:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(rows, percent=85):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b:
                if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
                    continue
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        low[r] = min([x for x in (low.get(r), d) if x is not None], default=None)
    return sorted(((d, len(s), low[find(i)]) for i, (d, s) in enumerate(sets)), key=repr)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, ngram_jaccard_join(df).collect()), key=repr)


def edited(rng, words, rate):
    return [rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.random())[:5] if rng.random() < rate else w
            for w in words]


def test_random_groups_match_brute_force(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for g in range(24):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([1, 2, 3, 4, 6, 8, 10, 14, 30, 90, 240]))]
        for _ in range(rng.choice([1, 2, 6, 12])):
            rows.append((n, " ".join(edited(rng, base, rng.choice([0, 0.004, 0.01, 0.02, 0.03])))))
            n += 1
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("group", [7, 8192])
def test_blocks_and_deletions(spark, monkeypatch, group):
    """Small blocks and forced one-deletion segments give the same components."""
    monkeypatch.setattr(J, "BLOCK", 5)
    monkeypatch.setattr(J, "GROUP", group)
    monkeypatch.setattr(J, "CHANCE", 1.0)
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 400)}" for _ in range(60)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0, 0.01, 0.02, 0.04])))) for i in range(70)]
    assert run(spark, rows) == brute(rows)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one"), (4, "One two"),
            (None, "a b c d e f"), (9, "A b c d e f"), (None, "lonely words here now"), (None, None),
            (10, "x " * 30000), (11, "é É"), (12, "é é")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([Row(doc_id=2, text="a b c d", id="x", fp=1, n=3, part=2, a=1, b=1),
                                Row(doc_id=1, text="a b c d", id="y", fp=1, n=3, part=2, a=1, b=1)])
    out = sorted(map(tuple, ngram_jaccard_join(df).collect()))
    assert out == [(1, 1, 1), (2, 1, 1)]


def test_bands_and_plan():
    b = bands_upto(5000, 85)
    assert b[0][:2] == (1, 1) and all(y[0] == x[1] + 1 for x, y in zip(b, b[1:]))
    for low, high, h in b:
        for r in {low, high}:
            s = 100 * r // 85
            assert r + s - 2 * -(-85 * (r + s) // 185) <= h
    cheap, dear = plan_bands({}, 5000, 85), plan_bands({i: 10 ** 12 for i in range(99)}, 5000, 85)
    assert all(m == h + 1 and d == 0 for (_, _, m, d), (_, _, h) in zip(cheap, b))
    assert all(m + d == h + 1 for (_, _, m, d), (_, _, h) in zip(dear, b)) and any(p[3] for p in dear)


def test_sketches_never_rule_out_a_link():
    import numpy as np
    rng = np.random.default_rng(3)
    for n, m in ((5, 5), (60, 66), (300, 330), (1000, 1100)):
        union = rng.integers(0, (1 << 64) - 1, m, dtype=np.uint64)
        x, y = (np.frombuffer(J.parity_sketch(s), np.uint8) for s in (union[:n], union))
        while len(y) > len(x):
            y = y[:len(y) // 2] ^ y[len(y) // 2:]
        assert np.bitwise_count(x ^ y).sum() <= m - n


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, ngram_jaccard_join(docs).collect()), key=repr) == brute(rows)


def test_linked_sets_always_share_a_signature():
    """Every pair of linked sets meets in a bucket, small sizes and empty segments included."""
    import numpy as np
    rng = np.random.default_rng(12)
    for percent, forced in ((85, None), (80, None), (85, 1), (80, 1)):
        plan = plan_bands({i: 10 ** 13 * (forced or 0) for i in range(99)}, 400, percent)
        for _ in range(700):
            n = int(rng.integers(1, 70))
            union = rng.integers(0, (1 << 64) - 1, n, dtype=np.uint64) >> np.uint64(rng.integers(0, 2))
            both = -(-percent * n // 100)
            a = union[:both + int(rng.integers(0, n - both + 1))]
            b = np.concatenate([union[:both], union[len(a):]])
            sets = [np.sort(a), np.sort(b)]
            flat, offs = np.concatenate(sets), np.array([0, len(a), len(a) + len(b)])
            fp = np.array([3, 5], np.uint64)
            sig = J.signatures(flat, offs, fp, plan)
            whole = {i: set(sig["key"][sig["fp"] == i].tolist()) for i in (3, 5)}
            short = {i: set(sig["key"][sig["fp"] == i - 1].tolist()) for i in (3, 5)}
            assert whole[3] & (whole[5] | short[5]) or whole[5] & short[3], (percent, forced, n)


def test_a_signature_travels_in_eight_bytes():
    import numpy as np
    flat = np.sort(np.random.default_rng(1).integers(0, (1 << 64) - 1, 200, dtype=np.uint64))
    sig = J.signatures(flat, np.array([0, 200]), np.array([(7 << 33) + 1], np.uint64), plan_bands({}, 400, 85))
    words = J.packed(sig)
    assert words.nbytes == 8 * len(sig)
    assert (words >> np.uint64(32) == sig["key"] & np.uint64(0xFFFFFFFF)).all()
    assert set((words & np.uint64(0xFFFFFFFF)).tolist()) <= {14, 15}


def test_sets_of_one_short_fingerprint_keep_their_links(spark, monkeypatch):
    """Short fingerprints that nearly all collide add candidates and lose no link."""
    monkeypatch.setattr(J, "packed", lambda sig: (sig["key"] << J.U(32)) | (sig["fp"] >> J.U(62) << J.U(1)) | (sig["fp"] & J.U(1)))
    monkeypatch.setattr(J, "short", lambda fp="fp": J.F.shiftrightunsigned(fp, 62) * 2 + 1)
    rng = random.Random(8)
    rows = []
    for _ in range(8):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([2, 4, 9, 30, 90]))]
        rows += [(len(rows) + i, " ".join(edited(rng, base, rng.choice([0, 0.01, 0.02])))) for i in range(rng.choice([1, 3, 9]))]
    assert run(spark, rows) == brute(rows)


def test_buckets_in_several_passes(spark, monkeypatch):
    """Signatures beyond a budget are shuffled in turns; the buckets are the same."""
    rng = random.Random(5)
    rows = []
    for i in range(60):
        w = [f"w{rng.randrange(200)}" for _ in range(60)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:-1] + ["x"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    turns, made = [], J.bucket_members

    def counted(*a):
        turns.append(a[5:])
        return made(*a)
    monkeypatch.setattr(J, "bucket_members", counted)
    once = sorted(map(tuple, ngram_jaccard_join(docs).collect()))
    assert turns == [(0, 1)]
    monkeypatch.setattr(J, "PASS_WORDS", 0.1)
    assert sorted(map(tuple, ngram_jaccard_join(docs).collect())) == once
    assert len(turns) > 3 and [t[0] for t in turns[1:]] == list(range(turns[1][1]))
    assert len({c for _, _, c in once}) == 60
