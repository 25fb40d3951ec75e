"""Every pipeline stage against brute force on what the stage before it kept."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as P
from labelrank.llm import kernels as K
from labelrank.llm import quality as Q
from labelrank.llm import secrets as S
from labelrank.session import scratch_path
from tests.llm.test_bpe import PATH, PATTERN, oracle  # noqa: F401
from tests.llm.test_ngram_join import shingle_set
from tests.llm.test_secrets import brute as secret_spans

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in P.STAGES:
        path = scratch_path(spark, f"test-{name}")
        stage(spark, docs, SF).write.parquet(path)
        done = spark.read.parquet(path)
        if name != P.STAGES[-1][0]:
            assert done.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out[name] = (docs.collect(), done.collect())
        docs = done
    return out


def test_quality(spark, stages):
    before, after = stages["quality"]
    labels = {r.doc_id: 1 if r.quality == 1 and r.toxic == 0 else 2 for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = {r[0] for r in spark.createDataFrame([(i,) for i in labels], "id long").filter(
        "pmod(xxhash64('fold', id), 5) = 0").collect()}
    counts, grams = np.zeros((4, Q.BUCKETS), np.int64), {}
    for r in before:
        data, offs = K.text_parts(pa.array([r.text]))
        b, _ = Q.ngram_buckets(data, offs)
        grams[r.doc_id] = b
        np.add.at(counts[0], b, 1)
        kind = 0 if r.doc_id in held else labels.get(r.doc_id, 0)
        if kind == 1:
            np.add.at(counts[1], b, 1)
        if kind:
            counts[1 + kind][np.unique(b)] += 1
    fit = [k for i, k in labels.items() if i not in held]
    ratios = Q.log_ratios(counts, fit.count(1), fit.count(2))
    weight = {i: Q.PER * ratios[b].sum() / max(Q.LEAST_GRAMS, len(b)) for i, b in grams.items()}
    known = [i for i in held if i in weight]
    cut = Q.best_cut(np.array([weight[i] for i in known]), np.array([labels[i] == 1 for i in known]))
    noise = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i in weight], "id long")
             .select("id", Q.gumbel(Q.F.col("id"))).collect()}
    k, temperature = sum(w > cut for w in weight.values()), min(Q.TEMPERATURE, -cut / Q.MARGIN)
    want = set(sorted(weight, key=lambda i: -(weight[i] / temperature + noise[i]))[:k])
    assert {r.doc_id for r in after} == want and len(want) < len(before)


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    sets = [(r.doc_id, shingle_set(r.text, 5)) for r in before]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert {r.doc_id for r in after} == {i for i, _ in sets if find(i) == i}
    assert len(after) < len(before)


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]

    def grams(t):
        w = re.sub(r"[^\w \t\n\r]+|_", "", (t or "").lower()).split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    items = [g for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (g := grams(r.text))]
    want = {r.doc_id for r in before if not any(100 * len(g & d) >= 80 * len(g) for d in [grams(r.text)] for g in items)}
    assert {r.doc_id for r in after} == want


def test_secrets(stages):
    before, after = stages["secrets"]
    clean = {r.doc_id: r for r in after}
    assert len(after) == len(before)
    for r in before:
        text, end, out = r.text, 0, ""
        for start, _, _, stop in secret_spans(text, S.BASE_RULES + S.MORE_RULES):
            if start >= end:
                out += text[end:start] + "[SECRET]"
            end = max(end, stop)
        want = out + text[end:]
        assert clean[r.doc_id].text == want
        assert clean[r.doc_id].n_chars == (len(want) if want != text else r.n_chars)


def test_tokens(stages, oracle):  # noqa: F811
    before, after = stages["tokens"]
    got = {r.doc_id: r for r in after}
    assert len(after) == len(before)
    for r in before:
        ids = np.array(oracle.encode_ordinary(r.text), "<u4").tobytes()
        assert bytes(got[r.doc_id].ids) == ids
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(r.doc_id for r in P.run(spark, SF).collect()) == sorted(r.doc_id for r in stages["tokens"][1])


def test_odd_rows_pass_every_stage(spark):
    """Nulls, empty and repeated rows, an extra column, an empty table."""
    rows = [(None, None, None, None, None, 1), (None, "null id", "en", "s", 7, 2), (1, None, "en", None, 0, 3), (2, "", "en", "s", 0, 4),
            (3, "a b c d e f g", "en", "s", 13, 5), (3, "a b c d e f g", "en", "s", 13, 5), (4, "a b c d e f g", "en", "s", 13, 6),
            (5, "word " * 20_000, "en", "s", 100_000, 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key long"
    for data, want in ((rows, [None, None, 1, 2, 3, 5]), ([], [])):
        docs = spark.createDataFrame(data, schema)
        for name, stage in P.STAGES:
            docs = stage(spark, docs, SF)
            if name != "tokens":
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "key"]
        assert sorted((r.doc_id for r in docs.collect()), key=repr) == sorted(want, key=repr)


def test_decisions_reach_their_own_rows(spark):
    """A repeated id with other texts, and rows without an id: each row is judged by its text."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    a = " ".join(f"a{i}" for i in range(40))
    b, c, d = (a.replace("a", x) for x in "bcd")
    rows = [(3, a), (5, a), (5, b), (6, c), (None, c), (None, d), (None, d), (7, ""), (None, ""), (None, ""),
            (8, item), (8, "x " + b.replace("b", "y")), (None, "so " + item), (9, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), n) for n, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long, key long")
    kept = P.near_duplicate_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    want = [(3, a), (5, b), (6, c), (None, d), (7, ""), (None, ""), (None, ""), (8, item), (8, rows[11][1]), (9, None),
            (None, None)]
    assert len(item.split()) > 10  # one word more is a near duplicate
    assert got == sorted(want, key=repr)
    clean = P.decontamination_stage(spark, docs, SF)
    assert clean.columns == docs.columns
    assert sorted(r.key for r in clean.collect()) == [n for n in range(len(rows)) if n not in (10, 12)]
