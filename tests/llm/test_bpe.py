"""BPE against the tiktoken library, and exact round trips."""

import base64
import hashlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from labelrank.llm import bpe

PATH, PATTERN = bpe.tokenizer_defaults()


@pytest.fixture(scope="module")
def oracle():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


VOCAB = bpe.Vocabulary.load(PATH, PATTERN)


def encode(texts):
    import regex
    return [x.tolist() for x in bpe.encode_block(texts, VOCAB, regex.compile(PATTERN).findall)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(
    st.text(max_size=60), st.text(alphabet="aabbé \n\t'sItheré!1\x1c\x85　", max_size=80),
    st.text(alphabet="ab", max_size=200)), max_size=6))
def test_like_the_library(oracle, texts):
    assert encode(texts) == [oracle.encode_ordinary(t) for t in texts]


def test_documents(spark, oracle):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in bpe.bpe_round_trip(docs, PATH, PATTERN).collect()}
    for r in docs.collect():
        ids = oracle.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                                 hashlib.sha256((r.text or "").encode()).hexdigest())


def test_edge_rows(spark, oracle):
    rows = [(1, None, 7, "x"), (2, "", 7, "x"), (None, "the end", 7, "x"), (3, "a" * 70000, 7, "x"),
            (4, "same text", 7, "x"), (4, "same text", 7, "x"), (5, "<|endoftext|>", 7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    out = bpe.bpe_decode(bpe.bpe_encode(df, PATH, PATTERN), PATH).collect()
    assert len(out) == len(rows)
    assert sorted(((r[0], bytes(r.decoded).decode()) for r in out), key=repr) == sorted(
        ((r[0], r[1] or "") for r in rows), key=repr)
    long = next(r for r in out if r[0] == 3)
    assert np.frombuffer(long.ids, "<u4").tolist() == oracle.encode_ordinary("a" * 70000)
    assert bpe.bpe_round_trip(df.limit(0), PATH, PATTERN).collect() == []


def test_words_out_of_rank_order_are_encoded_alone():
    """A vocabulary in which a merge makes a pair of lower rank."""
    tokens = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257, b"bcbc": 258}
    pairs = {}
    for whole, rank in tokens.items():
        for i in range(1, len(whole)):
            if whole[:i] in tokens and whole[i:] in tokens:
                pairs[tokens[whole[:i]] << 32 | tokens[whole[i:]]] = rank
    keys = sorted(pairs)
    v = bpe.Vocabulary(tokens, "", np.array(keys), np.array([pairs[k] for k in keys]), np.arange(256))
    words = [b"xabcbc", b"abcabc", b"bcbcbc", b"zabc", b"abc"]
    ids, offs = bpe.replay_merges(words, v)
    enc = tiktoken.Encoding("t", pat_str=r"(?s:.+)", mergeable_ranks=tokens, special_tokens={})
    assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:])] == [enc.encode_ordinary(w.decode()) for w in words]
