"""Vectorised text kernels used inside tasks: words and shingles of Arrow text columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  Words and shingles are
represented by 64-bit hashes (two different shingles of one document collide with
probability about 1e-11 at 20,000 shingles).
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa

U = np.uint64
MULT = 0x9E3779B97F4A7C15
INV = pow(MULT, -1, 1 << 64)
CHUNK = 1 << 21


def tidy(task):
    """A task over batches that gives its freed memory back when it ends: Python workers live on
    between stages, and what they keep is missing in later stages that need none."""
    @functools.wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)
    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (every input bit reaches every output bit)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _byte_table(fold: bool) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=U) * U(MULT))
    t[[9, 10, 11, 12, 13, 32]] = 0
    if fold:
        t[65:91] = t[97:123]
    return t


TABLES = {True: _byte_table(True), False: _byte_table(False)}
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) <= n:
        size = 1 << n.bit_length()
        for name, base in (("p", MULT), ("i", INV)):
            a = np.full(size, base, dtype=U)
            a[0] = 1
            _POW[name] = np.cumprod(a)
    return _POW["p"], _POW["i"]


def text_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    if len(col) == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32)
    offs = offs[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, offs


def chunks(data: np.ndarray, offs: np.ndarray, limit: int = CHUNK):
    """Runs of whole documents of about ``limit`` bytes: (first, last, bytes, offsets from 0)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray, fold: bool = True):
    """Word hashes in order, and per document the offset of its first word.

    ``fold`` lower-cases A-Z.  Documents never share a word."""
    n_docs = len(offs) - 1
    if len(data) == 0:
        return np.zeros(0, U), np.zeros(n_docs + 1, np.int64)
    solid = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offs] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    if len(starts) == 0:
        return np.zeros(0, U), np.zeros(n_docs + 1, np.int64)
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    p, inv = _powers(len(data))
    h = np.add.reduceat(TABLES[fold][data] * p[:len(data)], starts)
    h = mix(h * inv[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))
    return h, np.searchsorted(starts, offs, side="left")


_SLOT = mix(np.arange(101, 164, dtype=U) * U(MULT)) | U(1)


def shingles(h: np.ndarray, woffs: np.ndarray, k: int, short_whole: bool = True):
    """Hashes of the k-word shingles of each document, in order, and their offsets.

    A document with 1..k-1 words has its whole sequence as one shingle when
    ``short_whole``, else none."""
    n = np.diff(woffs)
    count = np.maximum(n - k + 1, 0)
    whole = (n > 0) & (n < k) if short_whole else np.zeros(len(n), bool)
    out_n = np.where(whole, 1, count)
    offs = np.concatenate([[0], np.cumsum(out_n)]).astype(np.int64)
    out = np.zeros(int(offs[-1]), U)
    if len(h) >= k:
        s = h[:len(h) - k + 1] * _SLOT[0]
        for j in range(1, k):
            s = s + h[j:len(h) - k + 1 + j] * _SLOT[j]
        s = mix(s + U(k))
        docs = np.flatnonzero(count > 0)
        c = count[docs]
        src = np.repeat(woffs[:-1][docs] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
        dst = np.repeat(offs[:-1][docs] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
        out[dst] = s[src]
    for d in np.flatnonzero(whole):
        w = h[woffs[d]:woffs[d + 1]]
        out[offs[d]] = mix(np.array([(w * _SLOT[:len(w)]).sum() + U(len(w))], dtype=U))[0]
    return out, offs


def distinct_sorted(values: np.ndarray, offs: np.ndarray):
    """Sorted distinct values of each document and their offsets."""
    parts, n = [], np.zeros(len(offs) - 1, np.int64)
    for d in range(len(offs) - 1):
        v = values[offs[d]:offs[d + 1]]
        if len(v) > 1:
            v = np.sort(v)
            keep = np.empty(len(v), dtype=bool)
            keep[0] = True
            np.not_equal(v[1:], v[:-1], out=keep[1:])
            v = v[keep]
        if len(v):
            parts.append(v)
            n[d] = len(v)
    flat = np.concatenate(parts) if parts else np.zeros(0, U)
    return flat, np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def binary_column(blobs: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Binary column whose i-th value is the raw bytes of ``blobs[offs[i]:offs[i+1]]``."""
    size = blobs.dtype.itemsize
    return pa.Array.from_buffers(
        pa.large_binary(), len(offs) - 1,
        [None, pa.py_buffer((offs * size).astype(np.int64).tobytes()), pa.py_buffer(blobs.tobytes())],
    ).cast(pa.binary())
