"""Byte-level BPE by merge replay over the word dictionary of a block of the corpus.

A task takes the texts of a block (an Arrow batch), splits them by the pattern into words and
keeps each distinct word once.  Over all these words together an inverted index from token pair
to word positions is built, and the merges are applied in rank order: each merge takes its
positions from the index, joins the symbols there, and enters only the pairs with the two touched
neighbours into the index again.  The documents are then put together from the encoded words.
The dictionary is per block, so no word is shuffled, a very frequent word costs nothing extra,
and a lost task repeats its block only.  Ranks are read on the driver (a vocabulary has a fixed
size, about 1 MB) and broadcast.
"""

from __future__ import annotations

import base64
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelrank.llm import kernels as K
from labelrank.llm.registry import register
from labelrank.session import ship_package, table

#: Texts of about so many characters share a dictionary; bounds a task's memory.
BLOCK_CHARS = 4 << 20


@dataclass
class Vocabulary:
    """Ranks of a byte-level vocabulary and the merges that they allow."""
    tokens: dict[bytes, int]
    pattern: str
    pair_keys: np.ndarray   # left id << 32 | right id, sorted
    pair_rank: np.ndarray   # id of the joined token
    byte_rank: np.ndarray   # id of each single byte

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        pairs = {}
        for whole, rank in tokens.items():
            for i in range(1, len(whole)):
                left, right = tokens.get(whole[:i]), tokens.get(whole[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.array(sorted(pairs), np.int64)
        return cls(tokens, pattern, keys, np.array([pairs[k] for k in keys.tolist()], np.int64),
                   np.array([tokens[bytes([b])] for b in range(256)], np.int64))

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the token that each pair joins to; -1 where no merge exists."""
        if not len(self.pair_keys) or not len(left):
            return np.full(len(left), -1, np.int64)
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], -1)


def _encode_alone(word: bytes, vocab: Vocabulary) -> list[int]:
    """One word by repeated merging of its leftmost pair of lowest rank."""
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = vocab.tokens.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [vocab.tokens[p] for p in parts]


def replay_merges(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, flat, and the offsets of each word's ids."""
    n_words = len(words)
    lens = np.fromiter(map(len, words), np.int64, n_words)
    offs = np.concatenate([[0], np.cumsum(lens)])
    size = int(offs[-1])
    sym = vocab.byte_rank.astype(np.int32)[np.frombuffer(b"".join(words), np.uint8)]
    ends = offs[1:][lens > 0] - 1
    nxt = np.arange(1, size + 1, dtype=np.int32)
    nxt[ends] = -1
    prv = np.arange(-1, size - 1, dtype=np.int32)
    prv[offs[:-1][lens > 0]] = -1
    alive = np.ones(size, dtype=bool)
    # A word that is itself a token is that token at once.
    whole = np.fromiter((vocab.tokens.get(w, -1) for w in words), np.int64, n_words)
    known = np.flatnonzero(whole >= 0)
    open_pos = np.ones(size, dtype=bool)
    if len(known):
        mark = np.zeros(size + 1, np.int32)
        np.add.at(mark, offs[:-1][known], 1)
        np.add.at(mark, offs[1:][known], -1)
        open_pos = np.cumsum(mark[:-1]) == 0
        alive[~open_pos] = False
        alive[offs[:-1][known]] = True
        sym[offs[:-1][known]] = whole[known]

    rank = np.full(size, -1, np.int32)
    first = np.flatnonzero(open_pos & (nxt >= 0))
    rank[first] = vocab.rank_of(sym[first], sym[nxt[first]])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(positions: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        bounds = [0, *cut.tolist(), len(ranks)]
        for lo, hi in zip(bounds, bounds[1:]):
            r = int(ranks[lo])
            if r in index:
                index[r].append(positions[lo:hi])
            else:
                index[r] = [positions[lo:hi]]
                heapq.heappush(heap, r)

    start = first[rank[first] >= 0]
    if len(start):
        enter(start, rank[start])
    odd: set[int] = set()
    while heap:
        r = heapq.heappop(heap)
        held = index.pop(r)
        pos = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
        pos = pos[rank[pos] == r]
        if not len(pos):
            continue
        if len(pos) > 1:  # of overlapping pairs every second one, from the left
            touch = nxt[pos[:-1]] == pos[1:]
            if touch.any():
                run = np.concatenate([[True], ~touch])
                ordinal = np.arange(len(pos))
                inside = ordinal - np.maximum.accumulate(np.where(run, ordinal, 0))
                pos = pos[inside % 2 == 0]
        gone = nxt[pos]
        after = nxt[gone]
        sym[pos] = r
        alive[gone] = False
        rank[gone] = -1
        nxt[pos] = after
        has = after >= 0
        prv[after[has]] = pos[has]
        before = prv[pos]
        rank[pos[~has]] = -1
        touched = np.unique(np.concatenate([pos[has], before[before >= 0]]))
        if not len(touched):
            continue
        new = vocab.rank_of(sym[touched], sym[nxt[touched]])
        rank[touched] = new
        lower = touched[(new >= 0) & (new < r)]
        if len(lower):  # order within these words may matter: they are encoded alone below
            odd.update(np.searchsorted(offs, lower, side="right").tolist())
        ok = new >= 0
        if ok.any():
            enter(touched[ok], new[ok])

    count = np.concatenate([[0], np.cumsum(alive)])
    out_offs, ids = count[offs], sym[alive]
    if odd:
        parts = np.split(ids, out_offs[1:-1])
        for w in odd:
            parts[w - 1] = np.array(_encode_alone(words[w - 1], vocab), np.int64)
        ids = np.concatenate(parts)
        out_offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return ids, out_offs


class _Dictionary(dict):
    """Numbers words in the order in which they first come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def encode_block(texts: list[str], vocab: Vocabulary, find) -> list[np.ndarray]:
    """Ids (unsigned 32-bit) of every text of a block."""
    numbers = _Dictionary()
    docs = [np.fromiter(map(numbers.__getitem__, find(t)), np.int32) for t in texts]
    if not numbers:
        return [np.zeros(0, "<u4") for _ in texts]
    ids, offs = replay_merges([w.encode() for w in numbers], vocab)
    ids, lens = ids.astype("<u4"), np.diff(offs)
    out = []
    for seq in docs:
        n = lens[seq]
        total = int(n.sum())
        at = np.repeat(offs[seq] - (np.cumsum(n) - n), n) + np.arange(total)
        out.append(ids[at])
    return out


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text", decoded: str | None = None) -> DataFrame:
    """``(<id_col>, n_tokens, ids)``: the whole text of each row as token ids, without special tokens.

    ``ids`` is binary: little-endian unsigned 32-bit integers.  Each match of ``pattern`` is
    encoded by itself.  Null and empty texts give no ids; repeated rows and null keys are kept as
    they are; other columns are ignored; an empty table gives no rows.  With ``decoded`` a column of
    that name holds the bytes that the ids stand for, as :func:`bpe_decode` gives them, from the same task."""
    import regex

    ship_package(docs.sparkSession)
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path, pattern))

    @K.tidy
    def run(batches):
        find = regex.compile(vocab.value.pattern).findall
        strings = {r: t for t, r in vocab.value.tokens.items()} if decoded else {}
        for batch in batches:
            texts, i = batch.column("text"), 0
            while i < len(texts):
                block, size = [], 0
                while i < len(texts) and (not block or size < BLOCK_CHARS):
                    block.append(texts[i].as_py() or "")
                    size += len(block[-1])
                    i += 1
                ids = encode_block(block, vocab.value, find)
                columns = {"id": batch.column("id").slice(i - len(block), len(block)),
                           "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                           "ids": pa.array([x.tobytes() for x in ids], pa.binary())}
                if decoded:
                    columns[decoded] = pa.array([_bytes_of(x, strings) for x in ids], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    more = f", `{decoded}` binary" if decoded else ""
    return (src.mapInArrow(run, f"id {kind}, n_tokens long, ids binary{more}")
            .withColumnRenamed("id", id_col))


def _bytes_of(ids: np.ndarray, strings: dict[int, bytes]) -> bytes:
    return b"".join(map(strings.__getitem__, ids.tolist()))


def bpe_decode(encoded: DataFrame, path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids of each row stand for; null ids count as none.

    An id that the vocabulary lacks fails the job."""
    ship_package(encoded.sparkSession)
    vocab = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(path, ""))

    def run(batches):
        strings = {r: t for t, r in vocab.value.tokens.items()}
        for batch in batches:
            out = [_bytes_of(np.frombuffer(x.as_py() or b"", "<u4"), strings) for x in batch.column(ids_col)]
            yield batch.append_column(name, pa.array(out, pa.binary()))

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{columns}, `{name}` binary")


def tokenizer_defaults() -> tuple[str, str]:
    """Path of the public 50k rank file and its pattern."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Encode, decode, and the digests of both."""
    out = bpe_encode(docs, path, pattern, id_col, decoded="decoded")
    return out.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op4_byte_bpe")
def op4_byte_bpe(spark, sf_dir):
    """Whole ``documents`` through the 50k byte-level vocabulary and back."""
    return bpe_round_trip(table(spark, sf_dir, "documents"), *tokenizer_defaults())
