"""Phrase collocations by top-order marginalisation.

Each word of a piece opens one window: itself and its four lead words, padded with empty strings
beyond the piece.  Only these longest windows are counted.  Spark's ROLLUP over the five columns
then sums them to every shorter prefix, and a phrase of k words occurs as often as the prefix of k
columns that spells it; the sum of a language is its number of words.

A window need not go on past two or three words in a row that are rarer than the least count asked
for, because no phrase with them is a candidate; it is padded there as at the end of a piece.  Words
and pairs, then triples of frequent pairs, are counted by 64-bit hash beforehand, and bit tables tell
the frequent ones: a hash that collides lets a window run on, so the tables can make work but can't
change a count that is reported.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelrank.llm import kernels as K
from labelrank.llm.components import write_scratch
from labelrank.llm.registry import register
from labelrank.session import ship_package, table

U = np.uint64
LONGEST = 5
COLUMNS = [f"w{j}" for j in range(1, LONGEST + 1)]
#: Bytes of text that are counted together in a task, cut between pieces.
CHUNK = 1 << 21
#: Rows of windows that a task adds up before it passes them on.
WINDOW_ROWS = 500_000
#: Bytes of text for each part of the hash counts, so that a part has about a million entries.
PART_BYTES = 1 << 23
#: A bit table has 32 bits per frequent hash within these bounds (128 MB at most), in slices; two are set.
LEAST_BITS, MOST_BITS, SLICE_BITS = 20, 30, 18
#: Broadcast the word counts of this many languages at most; beyond it, shuffle.
BROADCAST_LANGS = 100_000
#: A language's ranking is first cut in so many shares, so that no task sorts a whole language.
RANK_SHARES = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] = np.arange(97, 123)
WORD_BYTE, SPACE_BYTE, BREAK_BYTE = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[9, 32]] = SPACE_BYTE
KIND[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = BREAK_BYTE
#: Hash values of bytes; those between words count nothing.
VALUE = np.where(KIND == WORD_BYTE, K.TABLES[False], U(0))


def _count_type(least: int) -> np.dtype:
    return np.dtype([("key", "<u8"), ("n", "<u1" if least < 256 else "<u4")])


def _chunks(batch, limit):
    """(lower-cased bytes, document starts, index of the first document) of runs of whole pieces."""
    data, offs = K.text_parts(batch.column("text"))
    at, end = (int(offs[0]), int(offs[-1])) if len(offs) > 1 else (0, 0)
    while at < end:
        stop = min(at + limit, end)
        if stop < end:  # back to the last piece that ends, or on to the first one
            kind = KIND[data[at:stop]]
            breaks = np.flatnonzero(kind == BREAK_BYTE)
            docs = offs[np.searchsorted(offs, at, side="right"):np.searchsorted(offs, stop, side="right")]
            last = max(int(breaks[-1]) + at + 1 if len(breaks) else at, int(docs[-1]) if len(docs) else at)
            if last <= at:
                last = int(offs[np.searchsorted(offs, stop, side="left")])
                for lo in range(stop, last, limit):
                    breaks = np.flatnonzero(KIND[data[lo:min(lo + limit, last)]] == BREAK_BYTE)
                    if len(breaks):
                        last = lo + int(breaks[0]) + 1
                        break
            stop = last
        first = int(np.searchsorted(offs, at, side="right")) - 1
        edges = offs[first + 1:np.searchsorted(offs, stop, side="left")] - at
        yield LOWER[data[at:stop]], np.concatenate([[0], edges]), first
        at = stop


class _Words:
    """Words of a chunk: starts, ends, document, whether one opens a piece, and hashes with its language."""

    def __init__(self, data, edges, first, seeds):
        kind = KIND[data]
        solid, edge = kind == WORD_BYTE, np.zeros(len(data) + 1, bool)
        edge[edges] = True
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        self.data = data
        self.starts = np.flatnonzero(solid & (~before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        n = len(self.starts)
        if not n:
            return
        self.doc = first + np.searchsorted(edges, self.starts, side="right") - 1
        breaks = np.cumsum(kind == BREAK_BYTE, dtype=np.int64)[self.starts]
        self.opens = np.ones(n, bool)
        self.opens[1:] = (breaks[1:] != breaks[:-1]) | (self.doc[1:] != self.doc[:-1])
        p, inverse = K._powers(len(data))
        h = np.add.reduceat(VALUE[data] * p[:len(data)], self.starts)
        h = K.mix(h * inverse[self.starts] + (self.ends - self.starts).astype(U) * U(0xD6E8FEB86659FD93))
        self.hash = K.mix(h + seeds[self.doc])
        self.pair = K.mix(self.hash[:-1] * U(3) + K.mix(self.hash[1:]))
        self.joined = ~self.opens[1:]

    def frequent_pairs(self, bits):
        """Per pair of neighbours of one piece: words and pair are in the first bit table."""
        known = _is_set(bits[0], self.hash)
        return self.joined & known[:-1] & known[1:] & _is_set(bits[0], self.pair)

    def triples(self):
        return K.mix(self.pair[:-1] * U(5) + K.mix(self.hash[2:] + U(1)))

    def keys(self, bits):
        """Hashes to count: words and pairs, or, where their table is known, triples of frequent pairs."""
        if not bits:
            return np.concatenate([self.hash, self.pair[self.joined]])
        pairs = self.frequent_pairs(bits)
        return self.triples()[pairs[:-1] & pairs[1:]] if len(pairs) > 1 else np.zeros(0, U)


def _seeds(langs) -> np.ndarray:
    known = {x: zlib.crc32(x.encode()) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for x in set(langs)}
    return np.array([known[x] for x in langs], U)


def frequent_hashes(docs: DataFrame, least: int, parts: int, bits=None) -> DataFrame:
    """``(n, keys)``: packed hashes, of words and word pairs (of a language), or of triples where
    ``bits`` holds the table of those, with ``least`` or more occurrences, and their number.  Counts
    travel as packed blocks per chunk and part."""
    entry = _count_type(least)

    def count(batches):
        for batch in batches:
            seeds = _seeds(batch.column("lang").to_pylist())
            for chunk in _chunks(batch, CHUNK):
                w = _Words(*chunk, seeds)
                if not len(w.starts):
                    continue
                keys, n = np.unique(w.keys(bits.value if bits else None), return_counts=True)
                if not len(keys):
                    continue
                part = (keys % U(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                block = np.empty(len(keys), entry)
                block["key"], block["n"] = keys[order], np.minimum(n[order], least)
                offs = np.searchsorted(part[order], np.arange(parts + 1))
                full = np.flatnonzero(np.diff(offs))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full.astype(np.int32)), K.binary_column(block, np.append(offs[:-1][full], offs[-1]))], ["part", "block"])

    def add_up(t: pa.Table) -> pa.Table:
        block = np.concatenate([np.frombuffer(x.as_py(), entry) for c in t.column("block").chunks for x in c])
        order = np.argsort(block["key"], kind="stable")
        key, n = block["key"][order], block["n"][order].astype(np.int64)
        run = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        keys = key[run][np.add.reduceat(n, run) >= least]
        return pa.table({"n": pa.array([len(keys)], pa.int64()), "keys": pa.array([keys.tobytes()], pa.binary())})

    return (docs.mapInArrow(count, "part int, block binary").groupBy("part")
            .applyInArrow(add_up, "n long, keys binary"))


def bit_table(hashes: DataFrame) -> np.ndarray:
    """Bits as bytes, set at two places of every hash; the size of the table is bounded (MOST_BITS)."""
    total = hashes.agg(F.sum("n")).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, int(32 * total).bit_length()))

    def deal(batches):
        for batch in batches:
            for keys in batch.column("keys"):
                keys = np.frombuffer(keys.as_py(), U)
                at = np.sort(np.concatenate([keys, keys >> U(32)]) & U((1 << bits) - 1))
                part = (at >> U(SLICE_BITS)).astype(np.int64)
                offs = np.searchsorted(part, np.arange((1 << bits - SLICE_BITS) + 1))
                full = np.flatnonzero(np.diff(offs))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full.astype(np.int32)), K.binary_column(at, np.append(offs[:-1][full], offs[-1]))], ["slice", "at"])

    def gather(t: pa.Table) -> pa.Table:
        here = np.zeros(1 << SLICE_BITS, bool)
        for c in t.column("at").chunks:
            for x in c:
                here[(np.frombuffer(x.as_py(), U) & U((1 << SLICE_BITS) - 1)).astype(np.int64)] = True
        return pa.table({"slice": t.column("slice")[:1].cast(pa.int32()), "bits": pa.array([np.packbits(here).tobytes()], pa.binary())})

    rows = hashes.mapInArrow(deal, "slice int, at binary").groupBy("slice").applyInArrow(gather, "slice int, bits binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << SLICE_BITS) // 8
    for r in rows.toLocalIterator():
        out[r["slice"] * size:(r["slice"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def _is_set(bits, keys):
    def probe(at):
        at = at & U(len(bits) * 8 - 1)
        return (bits[(at >> U(3)).astype(np.int64)] >> (U(7) - (at & U(7))).astype(np.uint8) & 1).astype(bool)
    return probe(keys) & probe(keys >> U(32))


def _add_up(batches: list[pa.RecordBatch]) -> pa.Table:
    """Equal windows of one language summed."""
    keys = [c for c in batches[0].schema.names if c != "n"]
    t = pa.Table.from_batches(batches).group_by(keys).aggregate([("n", "sum")])
    return t.select([*keys, "n_sum"]).rename_columns([*keys, "n"]).combine_chunks()


def lead_windows(docs: DataFrame, bits, parts: int) -> DataFrame:
    """``(lang, w1..w5, n)``: the distinct windows and how many words open them; see the module.

    A task sums its windows while they are few and sends them packed, by part; the blocks of a part
    are summed again, so ROLLUP starts from distinct windows."""
    def windows(batches):
        table_bits = bits.value
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs], np.int64)
            seeds = _seeds(langs)
            for chunk in _chunks(batch, CHUNK):
                w = _Words(*chunk, seeds)
                if len(w.starts):
                    yield _chunk_windows(w, code, names, table_bits, parts)

    def packed(held):
        t = _add_up(held).sort_by("part")
        part = t.column("part").to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
        rows, t = t.drop_columns("part").combine_chunks(), None
        blocks = []
        for lo, hi in zip(cut[:-1], cut[1:]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_table(rows.slice(lo, hi - lo))
            blocks.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]], pa.int32()), pa.array(blocks, pa.binary())], ["part", "block"])

    def run(batches):
        held, rows = [], 0
        for found in windows(batches):
            held.append(found)
            rows += found.num_rows
            if rows > WINDOW_ROWS:
                held = _add_up(held).to_batches()
                rows = sum(b.num_rows for b in held)
                if rows > WINDOW_ROWS // 2:
                    yield packed(held)
                    held, rows = [], 0
        if held:
            yield packed(held)

    def unpack(t: pa.Table) -> pa.Table:
        found = [b for c in t.column("block").chunks for x in c for b in pa.ipc.open_stream(x.as_buffer())]
        return _add_up(found)

    columns = ", ".join(["lang string", *[f"{c} string" for c in COLUMNS], "n long"])
    return docs.mapInArrow(run, "part int, block binary").groupBy("part").applyInArrow(unpack, columns)


def _chunk_windows(w, code, names, bits, parts):
    n = len(w.starts)
    known = _is_set(bits[0], w.hash)
    pair, triple = np.zeros(n, bool), np.zeros(n, bool)  # the next one or two words go with this one
    pair[:-1] = w.frequent_pairs(bits)
    if n > 2:
        triple[:-2] = _is_set(bits[1], w.triples())
    # Strings of the frequent words, each once; 0 is the empty string
    some = np.flatnonzero(known)
    size = w.ends[some] - w.starts[some]
    offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    at = np.repeat(w.starts[some] - offs[:-1], size) + np.arange(offs[-1])
    strings = pa.Array.from_buffers(pa.large_string(), len(some), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(w.data[at].tobytes())])
    coded = strings.dictionary_encode()
    words = pa.concat_arrays([pa.array([""], pa.string()), coded.dictionary.cast(pa.string())])
    ids = np.zeros(n + LONGEST, np.int64)
    ids[some] = coded.indices.to_numpy() + 1
    # Lead columns, and their rows numbered exactly, one column after the other
    row, columns, runs = code[w.doc], [], np.ones(n, bool)
    for j in range(LONGEST):
        lead = np.where(runs, ids[j:j + n], 0)
        columns.append(lead)
        row = np.unique(row * (len(words) + 1) + lead, return_inverse=True)[1]
        runs[:n - j] &= pair[j:] & (triple[j - 1:n - 1] if j else True)
        runs[n - j:] = False
    first, counts = np.unique(row, return_index=True, return_counts=True)[1:]
    arrays = [pa.array(names, pa.string()).take(pa.array(code[w.doc[first]]))]
    arrays += [words.take(pa.array(c[first])) for c in columns]
    # Equal windows go to one part: that of their first two words, of the first alone, or of none
    key = np.where(pair, np.append(w.pair, U(0)), np.where(known, w.hash, U(0)))[first]
    arrays.append(pa.array((key % U(parts)).astype(np.int32)))
    return pa.RecordBatch.from_arrays([*arrays, pa.array(counts.astype(np.int64))], ["lang", *COLUMNS, "part", "n"])


def phrase_counts(docs: DataFrame, least: int, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """``(phrases, words)``: (lang, phrase, k, f) of phrases of up to 5 words with ``least`` occurrences
    or more, and (lang, n), all word occurrences."""
    ship_package(docs.sparkSession)
    src = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = src.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts, context = max(8, size // PART_BYTES), docs.sparkSession.sparkContext
    pairs = bit_table(write_scratch(frequent_hashes(src, least, parts), "phrase-hashes"))
    bits = context.broadcast([pairs])
    triples = bit_table(write_scratch(frequent_hashes(src, least, parts, bits), "phrase-hashes"))
    bits = context.broadcast([pairs, triples])
    level = F.grouping_id()
    rolled = lead_windows(src, bits, parts).rollup("lang", *COLUMNS).agg(F.sum("n").alias("f"), level.alias("level"))
    # the level has a bit per column, set where the column is summed away
    depth = LONGEST - F.bit_count("level")
    last = F.element_at(F.array(*COLUMNS), F.greatest(depth, F.lit(1)).cast("int"))
    counted = write_scratch(
        rolled.withColumn("k", depth.cast("int")).filter(F.col("k") >= 0)
        .filter((F.col("k") == 0) | ((last != "") & (F.col("f") >= least)))
        .select("lang", F.concat_ws(" ", *COLUMNS).alias("phrase"), "k", "f"), "phrases")
    return counted.filter("k > 0"), counted.filter("k = 0").select("lang", F.col("f").alias("n"))


def collocations(docs: DataFrame, least: int = 100, first: int = 2000, text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """Each language's ``first`` phrases: (lang, rank, phrase, a, l, r, n, score).

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and into words at blanks
    and tabs.  Candidates have 2 to 5 words and a >= ``least`` occurrences.  The score is the least
    over all cuts in two parts, with l and r occurrences, of floor(1000 * a * n / (l * r)), n being
    all words of the language; the first such cut gives l and r.  Candidates inside a longer one that
    occurs as often are left out.  Ranks go by score and a, both descending, then by phrase in byte
    order, which leaves no ties.  Null languages count as ``und``, null or empty texts as no words;
    repeated rows count again; other columns are ignored; an empty table gives no rows.
    """
    phrases, words = phrase_counts(docs, least, text_col, lang_col)
    few = words.count() <= BROADCAST_LANGS
    candidates = phrases.filter("k > 1").withColumnRenamed("f", "a")
    at = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at")
    cuts = candidates.select("lang", "phrase", "k", "a", at)
    cuts = (cuts.withColumn("left", F.expr("substring_index(phrase, ' ', at)"))
            .withColumn("right", F.expr("substring_index(phrase, ' ', at - k)")))
    part = phrases.select("lang", "phrase", "f")
    cuts = (cuts.join(part.toDF("lang", "left", "l"), ["lang", "left"]).join(part.toDF("lang", "right", "r"), ["lang", "right"])
            .join(F.broadcast(words) if few else words, "lang"))
    big = {c: F.col(c).cast("decimal(19,0)") for c in "alrn"}
    cuts = cuts.withColumn("over", big["a"] * big["n"] * F.lit(1000)).withColumn("under", big["l"] * big["r"])
    scored = (cuts.withColumn("score", F.expr("over div under")).groupBy("lang", "phrase")
              .agg(F.min(F.struct("score", "at", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("n").alias("n")))
    # Contiguous parts of two words or more of the longer candidates
    longer = candidates.filter("k > 2").select("lang", "a", "k", F.split("phrase", " ").alias("words"))
    inner = (longer.select("lang", "a", "k", "words", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
             .select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("from"))
             .select("lang", "a", F.array_join(F.expr("slice(words, from, size)"), " ").alias("phrase"))
             .groupBy("lang", "phrase").agg(F.max("a").alias("inside")))
    kept = (scored.join(inner, ["lang", "phrase"], "left").filter("inside is null or 100 * inside < 100 * a")
            .select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SHARES)))
    top = (shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order)))
           .filter(F.col("rank") <= first))
    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _sql(least: int, first: int) -> str:
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
total AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
sizes AS (SELECT unnest(range(1, 6)) AS k),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
    FROM w, sizes WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {least}),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cut AS (SELECT c.*, unnest(range(1, k)) AS pos FROM c),
s AS (SELECT cut.lang, cut.phrase, a, x.f AS l, y.f AS r, n, pos,
    (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score FROM cut
    JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(ws[1:pos], ' ')
    JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(ws[pos + 1:], ' ')
    JOIN total ON total.lang = cut.lang),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, pos) = 1),
part AS (SELECT lang, a, k, ws, unnest(range(2, k)) AS m FROM c),
inner_part AS (SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (
    SELECT *, unnest(range(1, k - m + 2)) AS i FROM part)),
kept AS (SELECT low.* FROM low WHERE NOT EXISTS (
    SELECT 1 FROM inner_part i WHERE i.lang = low.lang AND i.phrase = low.phrase AND 100 * i.a >= 100 * low.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= {first}"""


@register("op13_phrase_collocations", _sql(100, 2000))
def op13_phrase_collocations(spark, sf_dir):
    """All ``documents``, per language: 100 occurrences at least, 2,000 phrases at most."""
    return collocations(table(spark, sf_dir, "documents"))
