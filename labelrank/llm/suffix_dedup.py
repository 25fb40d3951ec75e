"""Removal of repeated substrings by column-wise construction of a multi-document suffix order.

Every 100-byte string has an anchor, its 24-byte substring of smallest hash, at the same place in
every occurrence.  The text around an anchor that can hold such a string is a segment of 176
bytes.  Segments of equal anchors meet in one task and are read column by column from the right:
each round puts one symbol in front of every segment, and updates the order of the suffixes (the
collection's Burrows-Wheeler order at that column) and the common prefixes of neighbours by
sequential passes over the arrays of the round before.  Neighbours with a common prefix of 100
bytes or more are occurrences of one string; all but the first in the corpus are removed.

Built over whole documents the construction would take as many rounds, each rewriting the whole
order, as the longest document has bytes; over aligned segments it takes 176.

Equal segments collapse to their first occurrence before bytes are shipped, already in the map
tasks.  Anchors whose segments would fill a part of their own (estimated from a sample, which only
chooses the route) are split by the hash of each of their 100-byte strings instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelrank.llm import kernels as K
from labelrank.llm.components import write_scratch
from labelrank.llm.registry import register
from labelrank.session import ship_package, table

U = np.uint64
GRAM = 24
PAD = 0xFF  # never a byte of UTF-8 text
#: Estimated occurrences from which an anchor is split: so many segments of 176 bytes fill a part.
HOT = 95_000
#: Bytes of text sampled for the estimate at least, and occurrences that it rests on at least.
SAMPLE_BYTES, LEAST = 256 << 20, 100
_BYTE = K.mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
ANCHOR = [("anchor", "<u8"), ("seg", "<u8"), ("uid", "<i8"), ("pos", "<i4"), ("left", "u1"), ("right", "u1")]
WINDOW = [("hash", "<u8"), ("uid", "<i8"), ("pos", "<i4")]
MARK = [("uid", "<i8"), ("start", "<i4"), ("end", "<i4")]
WANT = [("uid", "<i8"), ("pos", "<i4"), ("deal", "<i4")]
#: Bytes of text whose anchors, and of segments, that a part has on average at most; held in memory.
PART_BYTES = 16 << 20


def pack(columns, arrays) -> bytes:
    return b"".join(np.ascontiguousarray(a, dtype=t).tobytes() for (_, t), a in zip(columns, arrays))


def unpack(columns, blobs) -> list[np.ndarray]:
    """Columns of packed blocks, one after the other."""
    width, parts = sum(np.dtype(t).itemsize for _, t in columns), [[] for _ in columns]
    for blob in blobs:
        n, at = len(blob) // width, 0
        for i, (_, t) in enumerate(columns):
            parts[i].append(np.frombuffer(blob, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(p) if p else np.zeros(0, t) for p, (_, t) in zip(parts, columns)]


def anchors(part: np.ndarray, offs: np.ndarray, length: int):
    """(prefix hashes, inverse powers, gram hashes, anchor positions, their documents) of a chunk."""
    n, span = len(part), length - GRAM + 1
    p, inv = K._powers(n)
    prefix = np.concatenate([np.zeros(1, U), np.cumsum(_BYTE[part] * p[:n])])
    none = np.zeros(0, np.int64)
    if n < length:
        return prefix, inv, np.zeros(0, U), none, none
    h = K.mix((prefix[GRAM:] - prefix[:-GRAM]) * inv[:n - GRAM + 1])
    place = np.arange(len(h)).astype(U)
    bits = U(max(1, int(n).bit_length()))
    low = (h >> bits << bits) | place  # smallest hash, then leftmost
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
    size = np.diff(offs)
    inside = np.zeros(n + 1, np.int32)
    ok = size >= length
    np.add.at(inside, offs[:-1][ok], 1)
    np.add.at(inside, offs[1:][ok] - length + 1, -1)
    at = (low[np.cumsum(inside[:-1])[:len(low)] > 0] & ((U(1) << bits) - U(1))).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    return prefix, inv, h, at, np.searchsorted(offs, at, side="right") - 1


def _by_part(kind: int, columns, arrays, part: np.ndarray, parts: int):
    """Rows (kind, part, packed block) of arrays dealt out by ``part``."""
    order = np.argsort(part, kind="stable")
    arrays = [a[order] for a in arrays]
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    full = np.flatnonzero(np.diff(cut))
    if len(full):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(full), kind, np.int32)), pa.array(full.astype(np.int32)),
             pa.array([pack(columns, [a[cut[i]:cut[i + 1]] for a in arrays]) for i in full], pa.binary())],
            ["kind", "part", "blob"])


def _first_of(keys: list[np.ndarray], uid: np.ndarray, pos: np.ndarray):
    """Order by keys, then (uid, pos); and which rows are the first of their key."""
    order = np.lexsort((pos, uid, *reversed(keys)))
    first = np.ones(len(order), dtype=bool)
    if len(order) > 1:
        first[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, first


def _map_anchors(length: int, parts: int, hot: np.ndarray):
    """Anchors of a batch, first of each (anchor, segment); the others are marked at once."""
    reach = length - GRAM

    def run(batches):
        for batch in batches:
            data, offs = K.text_parts(batch.column("text"))
            uids = batch.column("uid").to_numpy()
            rows, wins = [], []
            for i, j, part, rel in K.chunks(data, offs):
                prefix, inv, h, at, doc = anchors(part, rel, length)
                if not len(at):
                    continue
                key, uid = h[at], uids[i:j][doc]
                is_hot = np.isin(key, hot) if len(hot) else np.zeros(len(at), bool)
                lo, hi = np.maximum(at - reach, rel[doc]), np.minimum(at + length, rel[doc + 1])
                seg = K.mix((prefix[hi] - prefix[lo]) * inv[lo]
                            + ((at - lo).astype(U) << U(32)) + (hi - lo).astype(U))
                c = ~is_hot
                rows.append((key[c], seg[c], uid[c], (at - rel[doc])[c], (at - lo)[c], (hi - at)[c]))
                if is_hot.any():
                    w = np.flatnonzero(is_hot)
                    last = np.minimum(at[w], rel[doc[w] + 1] - length)
                    n = last - lo[w] + 1
                    s = np.repeat(lo[w] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    s = np.unique(s)
                    d = np.searchsorted(rel, s, side="right") - 1
                    wins.append((K.mix((prefix[s + length] - prefix[s]) * inv[s] + U(3)), uids[i:j][d], s - rel[d]))
            if rows:
                a = [np.concatenate(x) for x in zip(*rows)]
                order, first = _first_of([a[0], a[1]], a[2], a[3])
                a = [x[order] for x in a]
                yield from _by_part(0, ANCHOR, [x[first] for x in a],
                                    (a[0][first] % U(parts)).astype(np.int64), parts)
                u, p, l, r = (x[~first] for x in a[2:])
                yield from _by_part(1, MARK, [u, p - l, p + r], (u % parts).astype(np.int64), parts)
            if wins:
                w = [np.concatenate(x) for x in zip(*wins)]
                order, first = _first_of([w[0]], w[1], w[2])
                w = [x[order] for x in w]
                yield from _by_part(2, WINDOW, [x[first] for x in w],
                                    (w[0][first] % U(parts)).astype(np.int64), parts)
                u, p = (x[~first] for x in w[1:])
                yield from _by_part(1, MARK, [u, p, p + length], (u % parts).astype(np.int64), parts)
    return run


def _per_uid(kind: int, columns, arrays) -> list[tuple[int, int, bytes]]:
    """Rows (kind, uid, packed block without the uid), one per document."""
    order = np.lexsort((arrays[1], arrays[0]))
    arrays = [a[order] for a in arrays]
    uid = arrays[0]
    cut = np.concatenate([[0], np.flatnonzero(uid[1:] != uid[:-1]) + 1, [len(uid)]]) if len(uid) else [0]
    return [(kind, int(uid[x]), pack(columns[1:], [a[x:y] for a in arrays[1:]])) for x, y in zip(cut, cut[1:])]


def _merged(uid, start, end):
    """Overlapping or touching intervals of each document, merged."""
    if not len(uid):
        return uid, start, end
    order = np.lexsort((start, uid))
    uid, start, end = uid[order], start[order].astype(np.int64), end[order].astype(np.int64)
    doc = np.cumsum(np.concatenate([[0], uid[1:] != uid[:-1]]))
    shift = doc * (int(end.max()) + 2)  # documents apart from each other
    far = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], (start + shift)[1:] > far[:-1]])
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], len(uid)) - 1
    return uid[begin], start[begin], far[stop] - shift[stop]


OUT = pa.schema([("kind", pa.int32()), ("uid", pa.int64()), ("blob", pa.binary())])


def _rows(rows) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[], [], []]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, OUT)], schema=OUT)


def _blobs(t: pa.Table, name: str = "blob"):
    return (x.as_py() for c in t.column(name).chunks for x in c)


def _reduce_anchors(length: int):
    """Marks of all but first segments; and the segments whose anchor has several of them."""
    def run(t: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _rows([])
        kind = t.column("kind")[0].as_py()
        if kind == 1:
            return _rows(_per_uid(0, MARK, _merged(*unpack(MARK, _blobs(t)))))
        if kind == 2:
            h, uid, pos = unpack(WINDOW, _blobs(t))
            order, first = _first_of([h], uid, pos)
            uid, pos = uid[order][~first], pos[order][~first]
            return _rows(_per_uid(0, MARK, _merged(uid, pos, pos + length)))
        a = unpack(ANCHOR, _blobs(t))
        order, first = _first_of([a[0], a[1]], a[2], a[3])
        key, _, uid, pos, left, right = (x[order] for x in a)
        rest = ~first
        marks = _merged(uid[rest], pos[rest] - left[rest].astype(np.int64), pos[rest] + right[rest].astype(np.int64))
        key, uid, pos = key[first], uid[first], pos[first]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(new) - 1
        several = (np.bincount(group) > 1)[group]
        deal = (K.mix(key[several]) >> U(33)).astype(np.int32)
        return _rows(_per_uid(0, MARK, marks) + _per_uid(1, WANT, [uid[several], pos[several], deal]))
    return run


def _map_segments(length: int, parts: int):
    """Bytes of the wanted segments of each document, dealt out by anchor."""
    reach = length - GRAM
    width = reach + length
    columns = [("uid", "<i8"), ("pos", "<i4"), ("left", "u1"), ("right", "u1"), ("bytes", f"V{width}")]

    def run(batches):
        for batch in batches:
            data, offs = K.text_parts(batch.column("text"))
            found = []
            for i, (uid, blobs) in enumerate(zip(batch.column("uid").to_pylist(), batch.column("blobs").to_pylist())):
                pos, deal = unpack(WANT[1:], blobs)
                pos = pos.astype(np.int64)
                text = data[offs[i]:offs[i + 1]]
                padded = np.concatenate([np.full(reach, PAD, np.uint8), text, np.full(length, PAD, np.uint8)])
                rows = np.lib.stride_tricks.sliding_window_view(padded, width)[pos]
                found.append((deal % parts, np.full(len(pos), uid), pos, np.minimum(pos, reach),
                              np.minimum(len(text) - pos, length),
                              np.ascontiguousarray(rows).view(f"V{width}").ravel()))
            if found:
                part, *arrays = (np.concatenate(x) for x in zip(*found))
                yield from _by_part(0, columns, arrays, part.astype(np.int64), parts)
    return run, columns


def repeated_windows(segments: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """For each segment (rows, by first occurrence) and column: whether the string of ``length``
    bytes that starts there also starts at that column of an earlier row.

    One round per column, from the right: a stable sort by the symbol before each suffix gives
    the next order; the common prefix of two neighbours with one symbol is one more than the
    least common prefix between their places in the order before."""
    n, width = segments.shape
    reach = width - length
    columns = np.ascontiguousarray(segments.T)
    order = np.arange(n)
    common = np.zeros(n + 1, np.uint8)
    again = np.zeros((reach + 1, n), dtype=bool)
    for c in range(width - 1, -1, -1):
        symbol = columns[c][order]
        step = np.argsort(symbol, kind="stable")
        order, symbol = order[step], symbol[step]
        new = np.zeros(n + 1, np.uint8)
        same = np.flatnonzero(symbol[1:] == symbol[:-1])
        if len(same):
            between = np.empty(2 * len(same), np.int64)
            between[0::2], between[1::2] = step[same] + 1, step[same + 1] + 1
            new[same + 1] = np.minimum(np.minimum.reduceat(common, between)[::2] + 1, length)
        common = new
        if c <= reach and (common >= length).any():
            begin = np.flatnonzero(common[:-1] < length)
            group = np.cumsum(common[:-1] < length) - 1
            valid = (c >= reach - left[order].astype(np.int64)) & (c + GRAM <= right[order].astype(np.int64))
            earliest = np.minimum.reduceat(np.where(valid, order, n), begin)
            again[c, order] = valid & (order != earliest[group])
    return again.T


def _reduce_segments(length: int, columns):
    reach = length - GRAM

    def run(t: pa.Table) -> pa.Table:
        uid, pos, left, right, data = unpack(columns, _blobs(t))
        order = np.lexsort((pos, uid))
        uid, pos = uid[order], pos[order].astype(np.int64)
        segments = data[order].view(np.uint8).reshape(len(order), reach + length)
        row, column = np.nonzero(repeated_windows(segments, left[order], right[order], length))
        start = pos[row] - reach + column
        return _rows(_per_uid(0, MARK, _merged(uid[row], start, start + length)))
    return run


def _with_uid(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(uid, id, text), and whether every row has its own uid: uid orders documents by id (null first), then by a hash of the text.

    Where ids are unique and not null they serve themselves.  Rows with equal id and text
    are one document."""
    src = docs.select(F.col(id_col).cast("long").alias("id"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    plain = src.groupBy("id").count().filter("id is null or count > 1").isEmpty()
    if plain:
        return src.select(F.col("id").alias("uid"), "id", "text"), True
    from labelrank.operators.ranking import global_index

    src = src.withColumn("hash", F.sha2("text", 256))
    keys = src.select("id", "hash").distinct().select("id", "hash", F.coalesce("id", F.lit(-2 ** 63)).alias("o"),
                                                      F.col("id").isNotNull().alias("known"))
    index = write_scratch(global_index(keys, ["o", "known", "hash"], "uid"), "document-order")
    index = index.select("uid", F.col("id").alias("id2"), F.col("hash").alias("hash2"))
    return (src.join(index, F.col("id").eqNullSafe(F.col("id2")) & (F.col("hash") == F.col("hash2")))
            .select("uid", "id", "text")), False


def _hot_anchors(texts: DataFrame, length: int, n_bytes: int) -> np.ndarray:
    """Anchors with an estimated HOT occurrences or more; the sample decides only their route.

    Every occurrence in the sampled texts counts.  The sample is of SAMPLE_BYTES, or larger where HOT
    occurrences would leave fewer than LEAST in it; so the result has at most its anchors / LEAST
    entries, whatever the input."""
    if n_bytes < HOT:  # fewer places than that
        return np.zeros(0, U)
    share = min(1.0, max(SAMPLE_BYTES / n_bytes, LEAST / HOT))

    def run(batches):
        for batch in batches:
            data, offs = K.text_parts(batch.column("text"))
            for _, _, part, rel in K.chunks(data, offs):
                _, _, h, at, _ = anchors(part, rel, length)
                a, n = np.unique(h[at], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n)], ["a", "n"])

    rows = ((texts if share == 1 else texts.sample(share, seed=7)).mapInArrow(run, "a long, n long")
            .groupBy("a").agg(F.sum("n").alias("n")).filter(F.col("n") >= share * HOT).select("a"))
    return np.array([r[0] for r in rows.collect()], np.int64).view(U)


def _parts(spark, n_bytes: int) -> int:
    """Parts into which so many bytes are dealt."""
    return max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PART_BYTES))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   length: int = 100) -> DataFrame:
    """``(<id_col>, n_bytes, n_removed, n_spans, kept)`` per row; ``kept`` is binary (UTF-8).

    Every byte goes that is covered by a string of ``length`` bytes that also starts earlier: in a
    row of smaller id, or before in the same text.  Overlaps count; strings are judged on the
    input.  Matches lie within texts.  Null texts count as empty; texts shorter than ``length``
    stay whole.  Rows of one id are ordered by a hash of their text; rows with null id come first;
    rows with equal id and text are one document and get the same result.  Other columns are
    ignored; an empty table gives no rows."""
    if not GRAM < length < 256 - GRAM:
        raise ValueError("length must lie between 25 and 231")
    spark = docs.sparkSession
    ship_package(spark)
    source, unique = _with_uid(docs, id_col, text_col)
    plain = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n_bytes = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = _parts(spark, n_bytes)
    hot = _hot_anchors(plain, length, n_bytes)
    texts = source.select("uid", "text")
    one_each = texts if unique else texts.dropDuplicates(["uid"])
    schema = "kind int, uid long, blob binary"
    first = write_scratch(
        one_each.mapInArrow(_map_anchors(length, parts, hot), "kind int, part int, blob binary")
        .groupBy("kind", "part").applyInArrow(_reduce_anchors(length), schema), "anchors")
    wanted = first.filter("kind = 1").groupBy("uid").agg(F.collect_list("blob").alias("blobs"))
    packed = first.filter("kind = 1").agg(F.coalesce(F.sum(F.length("blob")), F.lit(0))).first()[0]
    segments = packed // sum(np.dtype(t).itemsize for _, t in WANT[1:])
    run, columns = _map_segments(length, _parts(spark, segments * (2 * length - GRAM)))
    second = write_scratch(
        one_each.join(wanted, "uid").mapInArrow(run, "kind int, part int, blob binary")
        .groupBy("part").applyInArrow(_reduce_segments(length, columns), schema), "segments")
    marks = (first.filter("kind = 0").unionByName(second).groupBy("uid")
             .agg(F.collect_list("blob").alias("blobs")))

    def cut(batches):
        for batch in batches:
            data, offs = K.text_parts(batch.column("text"))
            removed, spans, kept = [], [], []
            for i, blobs in enumerate(batch.column("blobs").to_pylist()):
                text = data[offs[i]:offs[i + 1]]
                start, end = unpack(MARK[1:], blobs or [])
                _, start, end = _merged(np.zeros(len(start), np.int64), start, end)
                gone = np.zeros(len(text) + 1, np.int32)
                np.add.at(gone, start, 1)
                np.add.at(gone, end, -1)
                keep = np.cumsum(gone[:-1]) == 0
                removed.append(int(len(text) - keep.sum()))
                spans.append(len(start))
                kept.append(text[keep].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(offs)), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return (source.join(marks, "uid", "left").select("id", "text", "blobs")
            .mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
            .withColumnRenamed("id", id_col))


ORACLE = """
WITH e AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, length(h) // 2 AS n, unnest(range(0, greatest(length(h) // 2 - 99, 0), 500)) AS b, h FROM e),
k AS (SELECT doc_id, n, b, substr(h, 2 * b + 1, 1200) AS piece FROM c),
q AS (SELECT doc_id, b, n, piece, unnest(range(0, least(500, n - 99 - b))) AS j FROM k),
o AS (SELECT doc_id, b + j AS p, row_number() OVER (PARTITION BY md5(substr(piece, 2 * j + 1, 200)) ORDER BY doc_id, b + j) AS r FROM q),
m AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM o WHERE r > 1),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM m),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM g GROUP BY doc_id, g),
t AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM s),
x AS (SELECT t.doc_id, sum(z - a) AS gone, count(*) AS spans, max(z) AS tail,
  string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS kept FROM t JOIN e USING (doc_id) GROUP BY t.doc_id)
SELECT e.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM e LEFT JOIN x USING (doc_id)"""


@register("op9_suffix_dedup", ORACLE)
def op9_suffix_dedup(spark, sf_dir):
    """Repeated strings of 100 bytes removed from whole ``documents``."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
