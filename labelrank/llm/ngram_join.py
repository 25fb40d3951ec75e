"""N-gram Jaccard join by universe partition and pigeonhole.

Each document is the set of its distinct 4-word shingles (64-bit hashes).  For every band of
set sizes the hash universe is cut into segments.  Two sets of a band within the allowed
difference H must agree in a segment, or differ by one element in a segment that also indexes
its one-deletion neighbourhood: the weights of the segments (1 for the whole subset, 2 with
deletions) add up to H + 1.  How many segments get weight 2 is decided per band by the cost of
signatures against the cost of chance candidates (:func:`plan_bands`).  Candidates are verified
by exact intersection of the shingle sets.

A bucket knows its members by 31 bits of their fingerprint; the fingerprints come back when the
sizes and sketches of candidates are joined.

Skew and size: equal sets collapse to one fingerprint first, so copies never meet each other.
A bucket of a signature gives links to its first member only (linear).  What is still in
different components afterwards is verified in bounded blocks of a bucket, inside tasks; only
real links between components leave them.  No pair table of a group is ever emitted.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelrank.llm import kernels as K
from labelrank.llm.components import connected_components, remove_scratch, write_scratch
from labelrank.llm.registry import register
from labelrank.session import scratch_path, ship_package, table

U = np.uint64
SIG = np.dtype([("key", "<u8"), ("fp", "<u8")])
#: Broadcast a table of ids only up to this many rows (16 bytes each); beyond it, shuffle.
BROADCAST_ROWS = 2_000_000
#: Members, and elements of their sets, of a block that one task compares with another block.
BLOCK, BLOCK_ELEMENTS = 1024, 2_000_000
#: A group of the candidate graph is compared as a whole up to this many members, else by bucket.
GROUP = 8192
#: Bytes of text that a task works on at a time.
TEXT_BYTES = 1 << 20
#: Bytes of signatures in a part, about.
PART_BYTES = 2 << 20
#: A signature travels as one word: the low half of its key and the short fingerprint (31 bits, and
#: the bit of a whole subset).  Sets that share one by chance only become candidates of each other.
WORD_BYTES, LOW = 8, U(0xFFFFFFFF)
#: Signatures that are shuffled at once, for each shingle of the texts; where larger tables need more of them
#: (see plan_bands), their buckets are made in several passes over the texts, and the disk stays in proportion.
PASS_WORDS = 1.0
#: Chance that an element of one set lies in an unrelated set, for the cost model only.
CHANCE = 0.1


def bands_upto(max_size: int, percent: int) -> list[tuple[int, int, int]]:
    """Size bands (low, high, H): a set links only into its own band or the one below.

    H bounds the symmetric difference of linked sets r <= s with r in the band."""
    out, low = [], 1
    while low <= max_size:
        high = 100 * low // percent
        s = 100 * high // percent
        out.append((low, high, (100 - percent) * (high + s) // (100 + percent)))
        low = high + 1
    return out


def plan_bands(sizes: dict[int, int], max_size: int, percent: int) -> list[tuple[int, int, int, int]]:
    """(low, high, segments, segments with deletions) per band.

    ``sizes``: estimated sets per band.  With d segments of weight 2, H + 1 - d segments
    remain; larger d makes larger, more selective segments and more signatures."""
    plan = []
    for i, (low, high, h) in enumerate(bands_upto(max_size, percent)):
        n_docs, best = sizes.get(i, 0) + sizes.get(i + 1, 0), None
        for share in (0, 0.125, 0.25, 0.5):
            d = int((h + 1) * share)
            m = h + 1 - d
            per = (low + high) / 2 / m
            cost = n_docs * (m + d * per) + n_docs * n_docs / 2 * m * CHANCE ** min(per, 300)
            if best is None or cost < best[0]:
                best = (cost, m, d)
        plan.append((low, high, best[1], best[2]))
    return plan


def signature_count(plan: list[tuple[int, int, int, int]], sizes: dict[int, int]) -> float:
    """Signatures of ``sizes`` sets per band under ``plan``, about: one per segment and one per element of those with deletions."""
    count = 0.0
    for band, n_docs in sizes.items():
        low, high = plan[band][:2]
        for _, _, m, d in plan[max(0, band - 1):band + 1]:
            count += n_docs * (m + d * (low + high) / 2 / m)
    return count


def _segment_sums(flat, offs, docs, m):
    """Sum of element hashes per (document, segment), the segment of each element."""
    n = np.diff(offs)[docs]
    src = np.repeat(offs[:-1][docs] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    e = flat[src]
    seg = ((e >> U(32)) * np.repeat(m, n).astype(U)) >> U(32)
    base = np.cumsum(m) - m
    gseg = np.repeat(base, n) + seg.astype(np.int64)
    sums, count = np.zeros(int(m.sum()), U), np.zeros(int(m.sum()), np.int64)
    code = K.mix(e * U(0xA24BAED4963EE407) + U(0x9FB21C651E98DF25))
    run = np.flatnonzero(np.concatenate([[True], gseg[1:] != gseg[:-1]]))
    sums[gseg[run]] = np.add.reduceat(code, run)
    count[gseg[run]] = np.diff(np.append(run, len(gseg)))
    return sums, count, base, gseg, code


def signatures(flat, offs, fp, plan) -> np.ndarray:
    """Signature rows (key, fingerprint) of sorted sets, for their own band and the one below.

    An empty segment would put unrelated sets into one bucket.  Its signature is dropped when
    it and the next segment have weight 1 and the next segment of the same set is not empty; the
    next segment gets weight 2 whenever it may have been dropped.  Of two sets that are both empty there, either both keep the signature, or
    the weight lost is regained in the next segment, which both index with deletions."""
    lows = np.array([p[0] for p in plan])
    n = np.diff(offs)
    own = np.searchsorted(lows, n, side="right") - 1
    out = []
    for shift in (0, 1):
        docs = np.flatnonzero((n > 0) & (own - shift >= 0))
        if len(docs) == 0:
            continue
        band = own[docs] - shift
        m = np.array([p[2] for p in plan])[band]
        d = np.array([p[3] for p in plan])[band]
        sums, count, base, gseg, code = _segment_sums(flat, offs, docs, m)
        doc_of = np.repeat(np.arange(len(docs)), m)
        at = np.arange(len(sums)) - base[doc_of]
        after = base[doc_of] + (at + 1) % m[doc_of]
        tag = K.mix((band[doc_of].astype(U) << U(32)) + at.astype(U) + U(77))
        empty = count == 0
        double = at < d[doc_of]
        lost = empty & ~double & ~double[after]
        double[after[lost]] = True
        keep = double | ~lost | (count[after] == 0)
        ids = fp[docs]
        out.append((K.mix(sums[keep] + tag[keep]), ids[doc_of[keep]]))
        e = np.flatnonzero(double[gseg])
        if len(e):
            g = gseg[e]
            # a shortened subset must meet a whole one: the even fingerprint tells them apart
            out.append((K.mix(sums[g] - code[e] + tag[g]), ids[doc_of[g]] & ~U(1)))
    if not out:
        return np.zeros(0, SIG)
    sig = np.empty(sum(len(k) for k, _ in out), SIG)
    sig["key"] = np.concatenate([k for k, _ in out])
    sig["fp"] = np.concatenate([f for _, f in out])
    return sig


def _fingerprints(flat, offs) -> np.ndarray:
    """64-bit fingerprint of each sorted set; 0 for the empty set."""
    n = np.diff(offs)
    fp = np.zeros(len(n), U)
    full = np.flatnonzero(n > 0)
    if len(full):
        code = K.mix(flat + U(0x2545F4914F6CDD1D))
        sums = np.add.reduceat(code, offs[:-1][full])
        fp[full] = K.mix(sums + n[full].astype(U) * U(0x9E3779B97F4A7C15)) | U(1)
    return fp


def _sets_of(batch, k):
    """Chunks of a batch: (first row, last row, sorted shingle sets, offsets, fingerprints)."""
    data, offs = K.text_parts(batch.column("text"))
    for i, j, part, rel in K.chunks(data, offs, TEXT_BYTES):
        h, wo = K.words(part, rel)
        flat, fo = K.distinct_sorted(*K.shingles(h, wo, k))
        yield i, j, flat, fo, _fingerprints(flat, fo)


def shingle_sizes(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, fp, sketch) of every row: distinct shingles, fingerprint (0: empty set) and parity sketch of the set."""
    @K.tidy
    def run(batches):
        for batch in batches:
            n, fps, sketch = [], [], []
            for _, _, flat, fo, fp in _sets_of(batch, k):
                n.append(np.diff(fo))
                fps.append(fp.view(np.int64))
                sketch += [parity_sketch(flat[x:y]) for x, y in zip(fo, fo[1:])]
            if n:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(np.concatenate(n)), pa.array(np.concatenate(fps)), pa.array(sketch, pa.binary())],
                    ["id", "n", "fp", "sketch"])
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n long, fp long, sketch binary")


def packed(sig: np.ndarray) -> np.ndarray:
    """Signatures as words, see WORD_BYTES."""
    return (sig["key"] << U(32)) | (sig["fp"] >> U(33) << U(1)) | (sig["fp"] & U(1))


def short(fp="fp") -> Column:
    """The short fingerprint under which a set is a member of buckets."""
    return F.shiftrightunsigned(fp, 33) * 2 + 1


def bucket_members(docs: DataFrame, k: int, plan, parts: int, text_col: str, turn: int = 0, turns: int = 1) -> DataFrame:
    """Rows (kind, a, b): kind 0, candidate (first member, other member) of a bucket; kind 1,
    (bucket, member) of buckets with three members or more.  Members are short fingerprints.
    Of the parts, those that fall on ``turn`` of ``turns``.

    Signatures travel as packed blocks, one per task batch and part, and are sorted in numpy."""
    @K.tidy
    def emit(batches):
        for batch in batches:
            sig = [signatures(flat, fo, fp, plan) for _, _, flat, fo, fp in _sets_of(batch, k)]
            sig = np.concatenate(sig) if sig else np.zeros(0, SIG)
            if not len(sig):
                continue
            part = ((sig["key"] >> U(33)) % U(parts)).astype(np.int64)
            if turns > 1:
                own = part % turns == turn
                sig, part = sig[own], part[own]
            order = np.argsort(part, kind="stable")
            offs = np.searchsorted(part[order], np.arange(parts + 1))
            full = np.flatnonzero(np.diff(offs))
            if not len(full):
                continue
            blobs = K.binary_column(packed(sig[order]), np.append(offs[:-1][full], offs[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), blobs], ["part", "blob"])

    def gather(t: pa.Table) -> pa.Table:
        word = np.concatenate([np.frombuffer(x.as_py(), U) for c in t.column("blob").chunks for x in c])
        word.sort()
        key, fp = word >> U(32), word & LOW
        run = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        whole = np.repeat(np.add.reduceat((fp & U(1)).astype(np.int64), run) > 0, np.diff(np.append(run, len(key))))
        key, fp = key[whole], fp[whole] | U(1)
        if not len(key):
            return pa.table({"kind": pa.array([], pa.int32()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])])
        key, fp = key[new], fp[new]
        run = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(run, len(key)))
        rep = np.repeat(run, size)
        other = np.flatnonzero((np.arange(len(key)) != rep))
        pairs = np.unique(np.stack([fp[rep[other]], fp[other]], axis=1), axis=0)
        names = np.add.reduceat(K.mix(fp + U(5)), run) if len(run) else np.zeros(0, U)
        big = np.repeat(size >= 3, size)
        rows = np.unique(np.stack([np.repeat(names, size)[big], fp[big]], axis=1), axis=0)
        both = np.concatenate([pairs, rows]).view(np.int64)
        kind = np.repeat(np.array([0, 1], np.int32), [len(pairs), len(rows)])
        return pa.table({"kind": kind, "a": both[:, 0].copy(), "b": both[:, 1].copy()})

    return (docs.select(F.col(text_col).cast("string").alias("text"))
            .mapInArrow(emit, "part int, blob binary").groupBy("part")
            .applyInArrow(gather, "kind int, a long, b long"))


def _common(x: np.ndarray, y: np.ndarray) -> int:
    z = np.sort(np.concatenate([x, y]))
    return int((z[1:] == z[:-1]).sum())


def plausible_pairs(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets whose short fingerprints are in ``pairs`` and that neither the sizes
    nor the parity sketches rule out; two sets of one short fingerprint come once."""
    left = sketches.toDF("a", "na", "sa").withColumn("ka", short("a"))
    right = sketches.toDF("b", "nb", "sb").withColumn("kb", short("b"))

    @K.tidy
    def run(batches):
        for batch in batches:
            most = ((batch.column("na").to_numpy() + batch.column("nb").to_numpy()) * (100 - percent)) // (100 + percent)
            ok = [int(np.bitwise_count(x ^ y).sum()) <= m
                  for (x, y), m in zip(map(_folded, zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())), most)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return (pairs.toDF("ka", "kb").join(right, "kb").join(left, "ka").filter("ka <> kb or a < b").drop("ka", "kb")
            .filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
            .mapInArrow(run, "a long, b long"))


def verify_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity, by exact intersection."""
    sets = sets.select("fp", "n", "shingles")
    left, right = sets.toDF("a", "na", "sa"), sets.toDF("b", "nb", "sb")

    @K.tidy
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)
                both = _common(x, y)
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return (pairs.join(right, "b").join(left, "a")
            .filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
            .select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"))


def _block_links(t: pa.Table, percent: int) -> pa.Table:
    """One link per pair of components between the members of a block."""
    fp, first = np.unique(t.column("fp").to_numpy(), return_index=True)
    comp = t.column("comp").to_numpy()[first]
    blobs = t.column("shingles")
    sets = [np.frombuffer(blobs[int(i)].as_py(), U) for i in first]
    n = np.array([len(s) for s in sets])
    elements, code = np.unique(np.concatenate(sets), return_inverse=True)
    member = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(code, kind="stable")
    posting = member[order]
    poffs = np.searchsorted(code[order], np.arange(len(elements) + 1))
    names, tally = np.unique(comp, return_counts=True)
    main = names[np.argmax(tally)]
    offs = np.concatenate([[0], np.cumsum(n)])
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for i in np.flatnonzero(comp != main):
        c = code[offs[i]:offs[i + 1]]
        lens = poffs[c + 1] - poffs[c]
        at = np.repeat(poffs[c] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
        both = np.bincount(posting[at], minlength=len(sets))
        ok = (100 * both >= percent * (n[i] + n - both)) & (comp != comp[i])
        for j in np.flatnonzero(ok):
            pair = (min(comp[i], comp[j]), max(comp[i], comp[j]))
            found.setdefault(pair, (fp[i], fp[j]))
    rows = np.array(list(found.values()), np.int64).reshape(-1, 2)
    return pa.table({"a": rows[:, 0].copy(), "b": rows[:, 1].copy()})


def parity_sketch(s: np.ndarray) -> bytes:
    """One bit per hash value modulo a power of two (64 or more, about the set's size): set where
    an odd number of elements fall.  Two sketches differ in at most as many bits as the sets
    differ in elements; halves fold by exclusive or."""
    bits = max(64, 1 << int(max(1, len(s)) - 1).bit_length())
    odd = np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(sketches) -> list[np.ndarray]:
    """Sketches brought to the length of the shortest, as 64-bit words."""
    size, out = min(map(len, sketches)), []
    for b in sketches:
        x = np.frombuffer(b, U)
        while len(x) * 8 > size:
            x = x[:len(x) // 2] ^ x[len(x) // 2:]
        out.append(x)
    return out


def _near_members(t: pa.Table, percent: int) -> pa.Table:
    """Per unit, a spanning forest of the pairs of members of different components whose sketches
    do not rule out the similarity: at most one row per member."""
    t = t.sort_by([("unit", "ascending"), ("i", "ascending"), ("j", "ascending")])
    keys = [t.column(c).to_numpy() for c in ("unit", "i", "j")]
    fp, comp, n = (t.column(c).to_numpy() for c in ("fp", "comp", "n"))
    blobs = t.column("sketch").to_pylist()
    cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    bounds, out = [0, *cut.tolist(), len(fp)], []
    for lo, hi in zip(bounds, bounds[1:]):
        if hi - lo < 2 or (comp[lo:hi] == comp[lo]).all():
            continue
        m = np.stack(_folded(blobs[lo:hi]))
        root = list(range(hi - lo))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        c, k = comp[lo:hi], n[lo:hi]
        for a in range(hi - lo - 1):
            apart = np.bitwise_count(m[a + 1:] ^ m[a]).sum(axis=1, dtype=np.int64)
            ok = (c[a + 1:] != c[a]) & (apart <= (100 - percent) * (k[a] + k[a + 1:]) // (100 + percent))
            for b in np.flatnonzero(ok) + a + 1:
                x, y = find(a), find(int(b))
                if x != y:
                    root[y] = x
                    out.append((fp[lo + a], fp[lo + b]))
    rows = np.array(out, np.int64).reshape(-1, 2)
    return pa.table({"a": rows[:, 0].copy(), "b": rows[:, 1].copy()})


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Every member of a unit, once per pair of blocks (i, j) that its own block takes part in."""
    return (rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
            .drop("own", "other", "blocks"))


def remaining_links(buckets: DataFrame, comps: DataFrame, sketches: DataFrame, sets_of, percent: int, folder: str) -> DataFrame:
    """Links between members of a bucket that lie in different components so far.

    ``buckets`` are those of three members or more, by short fingerprint; in smaller ones the pair of members has been
    verified.  ``sets_of`` gives the shingle sets of a frame of fingerprints.  In buckets that hold several components, small sketches rule out most pairs; the
    pairs left join the members to groups.  The unit of exact comparison is such a group, where a
    member's set travels once per block of the group, or, for groups of more than GROUP members,
    each bucket.  A unit is cut into blocks of bounded size and every two blocks meet in a task,
    so each pair of a bucket is compared somewhere."""
    held = (buckets.select(F.col("a").alias("bucket"), F.col("b").alias("short")).distinct()
            .join(sketches.select(short().alias("short"), "fp", "n"), "short").drop("short")
            .join(comps.toDF("fp", "comp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp")))
    several = (held.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("size"))
               .filter("c0 <> c1").select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    held = write_scratch(held.join(several, "bucket"), "open-buckets", folder)
    parts = max(8, 4 * int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    units = _block_pairs(held.withColumnRenamed("bucket", "unit")).join(sketches.select("fp", "sketch"), "fp")
    near = (units.withColumn("part", F.pmod(F.xxhash64("unit", "i", "j"), F.lit(parts))).groupBy("part")
            .applyInArrow(lambda t: _near_members(t, percent), "a long, b long"))
    groups = connected_components(near, folder=folder)
    rows = write_scratch(held.select("fp", "comp", "n").distinct().join(groups.toDF("fp", "unit"), "fp"), "groups", folder)

    def mixed(t):
        return (t.groupBy("unit").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"),
                                      F.count("*").alias("size"), F.sum("n").alias("total"))
                .filter("c0 <> c1")
                .select("unit", "size", F.greatest(F.ceil(F.col("size") / BLOCK),
                                                   F.ceil(F.col("total") / BLOCK_ELEMENTS)).cast("int").alias("blocks")))

    units = mixed(rows)
    small = rows.join(units.filter(F.col("size") <= GROUP), "unit")
    in_large = rows.join(units.filter(F.col("size") > GROUP).select("unit"), "unit", "left_semi")
    by_bucket = (held.select(F.col("bucket").alias("unit"), "fp", "comp", "n")
                 .join(in_large.select("fp"), "fp", "left_semi"))
    large = by_bucket.join(mixed(by_bucket), "unit")
    tasks = _block_pairs(small.select("unit", "fp", "comp", "blocks")
                         .unionByName(large.select("unit", "fp", "comp", "blocks")))
    sets = sets_of(rows.select("fp").distinct())
    return (tasks.join(sets.select("fp", "shingles"), "fp").groupBy("unit", "i", "j")
            .applyInArrow(lambda t: _block_links(t, percent), "a long, b long"))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       k: int = 4, percent: int = 85) -> DataFrame:
    """Component of every document under links of Jaccard similarity >= percent / 100.

    Returns ``(<id_col>, n_shingles, component_id)``, one row per input row: the size of its
    set of distinct ``k``-word shingles (fewer words: the whole sequence is one shingle; A-Z
    lower-cased) and the smallest id reachable by links, its own included.  Null or empty texts,
    and texts of white space, have an empty set and stand alone.  Rows with a null id take part;
    their component is the smallest non-null id reachable, or null.  Repeated rows and equal
    sets share a component.  Other columns are ignored.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    folder = scratch_path(spark, "jaccard-join")  # what only the search reads
    sizes = write_scratch(shingle_sizes(docs, k, id_col, text_col), "shingle-sizes")
    seen = sizes.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    found = seen["most"] or 1
    bands = bands_upto(found, percent)
    lows = ", ".join(f"{low}L" for low, _, _ in bands)
    band = F.expr(f"size(filter(array({lows}), x -> x <= n)) - 1")
    per_band = {r[0]: r[1] for r in sizes.filter("n > 0").groupBy(band.alias("band")).count().collect()}
    plan = plan_bands(per_band, found, percent)
    # about one signature per shingle; a part is sorted in memory, whatever the size of the table
    parts = max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), (seen["all"] or 0) * WORD_BYTES // PART_BYTES)
    turns = max(1, math.ceil(signature_count(plan, per_band) / (PASS_WORDS * max(1, seen["all"] or 0))))
    members = [write_scratch(bucket_members(docs, k, plan, parts, text_col, i, turns), "buckets", folder) for i in range(turns)]
    members = reduce(DataFrame.unionByName, members)
    full = sizes.filter("n > 0").withColumn("short", short())
    twins = full.groupBy("short").agg(F.min("fp").alias("f0"), F.max("fp").alias("f1")).filter("f0 <> f1")
    pairs = write_scratch(members.filter("kind = 0").select("a", "b").distinct()
                          .union(twins.select("short", "short")), "candidates", folder)

    # One document per fingerprint that is a candidate.
    wanted = write_scratch(
        full.join(pairs.select(F.col("a").alias("short")).union(pairs.select("b")).distinct(), "short")
        .groupBy("fp").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "wanted", folder)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    @K.tidy
    def shingle_set(batches):
        for batch in batches:
            for _, _, flat, fo, fp in _sets_of(batch, k):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp.view(np.int64)), pa.array(np.diff(fo)), K.binary_column(flat, fo)], ["fp", "n", "shingles"])

    def sets_of(fps):
        chosen = write_scratch(wanted.select("fp", "id").join(fps, "fp"), "chosen", folder)
        few = chosen.count() <= BROADCAST_ROWS
        ids = chosen.select("id").distinct()
        texts = source.join(F.broadcast(ids) if few else ids, "id", "left_semi").select("text")
        if not chosen.filter("id is null").isEmpty():  # sets that only rows without an id have
            texts = texts.unionByName(source.filter("id is null").select("text"))
        return write_scratch(texts.mapInArrow(shingle_set, "fp long, n long, shingles binary")
                             .join(chosen.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]), "sets", folder)

    # Sizes and sketches rule most chance candidates out before any set is written or travels.
    sketches = wanted.select("fp", "n", "sketch")
    pairs = write_scratch(plausible_pairs(pairs, sketches, percent), "plausible", folder)
    sets = sets_of(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct())
    links = write_scratch(verify_pairs(pairs, sets, percent), "links", folder)
    comps = write_scratch(connected_components(links, folder=folder), "components", folder)
    more = write_scratch(remaining_links(members.filter("kind = 1"), comps, sketches, sets_of, percent, folder), "links", folder)
    if not more.isEmpty():
        comps = connected_components(links.union(more), folder=folder)
    comps = write_scratch(comps, "components")
    remove_scratch(spark, folder)
    labels = (sizes.join(comps.toDF("fp", "root"), "fp", "left")
              .withColumn("root", F.coalesce("root", "fp")))
    low = labels.filter("n > 0").groupBy("root").agg(F.min("id").alias("low"))
    return (labels.join(low, "root", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("id")).alias("component_id")))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.k >= 85 * (x.n + y.n - p.k)),
r(doc_id, other) AS (SELECT a, b FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles,
  least(w.doc_id, coalesce(min(r.other), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY w.doc_id"""


@register("op1_ngram_jaccard_join", ORACLE)
def op1_ngram_jaccard_join(spark, sf_dir):
    """Four-word shingles of whole ``documents``, similarity 0.85 or more."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))
