"""Exact inner-product search and pairwise scoring.

``knn_exact`` is a blocked matrix product: queries are split into QB blocks and
passages into PB blocks by a hash of their id; every (query block, passage
block) pair meets once in a ``cogroup``, where numpy multiplies the query block by a few
hundred passages at a time and keeps the running top-k of every query.  Only those candidates
(at most ~k per query per passage block) are shuffled to the final
``row_number`` merge.  No pair table is ever materialised, nothing passes
through the driver, and block sizes are parameters, so every task's memory is
bounded whatever the size of either side.

A shuffle would hold the passages once per query block.  With more than ``COPIES`` query blocks the
sorted passages are therefore written once, some thousand vectors a row, and every query block reads
those rows as a stream (:func:`_streamed`): a task keeps the running top-k of its queries over all
passages, ranks them itself, and nothing is left to shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelrank.operators.ranking import rank_by_score
from labelrank.session import scratch_path, shuffles_removed, ship_package

#: Passages of a block where k is as large or larger.
SMALL_BLOCK = 65_536
#: Query blocks up to which the passages are shuffled, a copy for each; more read written passages.
COPIES = 8
#: Bytes of vectors in a row and in a file of written passages.
ROW_BYTES, FILE_BYTES = 4 << 20, 16 << 20
#: Passages whose ids a task keeps while it reads them.
TASK_PASSAGES = 4_000_000
#: Queries whose rows a task makes and queries that it multiplies at once.
SLAB = 256
#: Number in a place that holds no passage.
NO_PASSAGE = np.iinfo(np.int32).max


def dot(a: Column, b: Column) -> Column:
    """Inner product of two numeric arrays, in double, JVM-side."""
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def _sound(vec: Column) -> Column:
    """The vector; fails the job where it is null or has a null or NaN component."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.when(F.coalesce(ok, F.lit(False)), vec).otherwise(
        F.raise_error(F.lit("a vector is null or has a null or NaN component")))


def plain(vec: Column, kind) -> Column:
    """The sound vector as floats or doubles, which Arrow hands to numpy without objects."""
    return _sound(vec) if kind.simpleString() == "array<float>" else _sound(vec).cast("array<double>")


def passage_block_rows(k: int, dim: int, block_bytes: int) -> int:
    """Passages of a block.  A k that keeps most of a block anyway gets smaller ones: they add no
    candidates then, and a query's running top-k stays small."""
    rows = max(1024, block_bytes // (4 * dim))
    return min(rows, SMALL_BLOCK) if k >= SMALL_BLOCK else rows


def query_block_rows(take: int, dim: int, work_bytes: int) -> int:
    """Queries of a block, from the bytes of each: its vector, the running best and the rows found."""
    return max(16, work_bytes // (16 * dim + 12 * (take + _room(take)) + 32 * take))


def _room(take: int) -> int:
    """Passages that are multiplied at once, and places for new scores behind the running best."""
    return max(256, take // 2)


def matrix(vectors: pa.ChunkedArray, rows: np.ndarray | None = None) -> np.ndarray:
    """The vectors, the i-th in row ``rows[i]`` (default i); vectors of several lengths fail."""
    sizes = pc.min_max(pc.list_value_length(vectors)).as_py()
    if sizes["min"] != sizes["max"]:
        raise ValueError(f"vectors of {sizes['min']} and {sizes['max']} components")
    out, start = None, 0
    for chunk in vectors.chunks:
        part = chunk.flatten().to_numpy(zero_copy_only=False).reshape(len(chunk), sizes["max"])
        if out is None:
            out = np.empty((len(vectors), sizes["max"]), part.dtype)
        out[slice(start, start + len(chunk)) if rows is None else rows[start:start + len(chunk)]] = part
        start += len(chunk)
    return out


def sorted_block(block: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Vectors and ids of a passage block in order of id, so that equal scores go by id."""
    order = pc.sort_indices(block["__p"], null_placement="at_start")
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return matrix(block["__pv"], place), pc.take(block["__p"], order).combine_chunks()


class RunningTop:
    """Scores and numbers of the ``take`` best passages of ``n`` queries, by score desc, then number asc.

    What beats a query's ``take``-th score so far is put behind its running best, and the two are sorted
    when that room is full.  With ``floor`` only scores that reach the query's value count; ``every`` keeps
    all scores (no more passages than places).  Passages may come in any order of their numbers."""

    def __init__(self, n: int, take: int, tile_bytes: int = 64 << 20, floor: np.ndarray | None = None, every: bool = False):
        self.take, self.every = take, every
        self.room = min(_room(take), max(1, tile_bytes // (8 * n)))
        self.best = np.full((n, take + self.room), -np.inf)
        self.at = np.full((n, take + self.room), NO_PASSAGE, np.int32)
        self.fill = np.zeros(n, np.int64)
        self.bar = np.full(n, -np.inf) if floor is None else np.nextafter(floor, -np.inf)
        self.last = np.full(n, -1)  # the passage at the bar
        self.end, self.in_order = 0, True

    def settle(self, rows: np.ndarray) -> None:
        take, slab = self.take, max(1, (8 << 20) // (8 * self.best.shape[1]))
        for i in range(0, len(rows), slab):
            r = rows[i:i + slab]
            best, at = self.best[r], self.at[r]
            order = np.argsort(-best, axis=1, kind="stable")  # equal scores: the earlier place first
            if not self.in_order:
                top = np.take_along_axis(best, order[:, :take + 1], 1)
                tied = np.nonzero(((top[:, 1:] == top[:, :-1]) & (top[:, 1:] > -np.inf)).any(axis=1))[0]
                order[tied] = np.lexsort((at[tied], -best[tied]), axis=1)
            order = order[:, :take]
            kept, where = np.take_along_axis(best, order, 1), np.take_along_axis(at, order, 1)
            self.best[r, take:], self.at[r, take:] = -np.inf, NO_PASSAGE
            self.best[r, :take], self.at[r, :take] = kept, where
            full = self.fill[r] >= take
            self.last[r] = np.where(full & (kept[:, -1] >= self.bar[r]), where[:, -1], self.last[r])
            self.bar[r] = np.where(full, np.maximum(self.bar[r], kept[:, -1]), self.bar[r])
            self.fill[r] = np.minimum(self.fill[r], take)

    def add(self, qm: np.ndarray, pm: np.ndarray, start: int = 0) -> None:
        """Passages ``start``, ``start + 1``, ... with the vectors ``pm``."""
        self.in_order &= start >= self.end
        self.end = max(self.end, start + len(pm))
        pm = pm.astype(np.float64)
        for q in range(0, len(qm), SLAB):
            asked = slice(q, q + SLAB)
            for p in range(0, len(pm), self.room):
                s = qm[asked] @ pm[p:p + self.room].T
                if self.every:
                    over = np.ones(s.shape, bool)
                else:
                    # a passage before the one at the bar also beats it with the same score
                    bar = self.bar[asked]
                    bar = bar if self.in_order else np.where(start < self.last[asked], np.nextafter(bar, -np.inf), bar)
                    over = s > bar[:, None]
                rows, cols = np.divmod(np.flatnonzero(over), s.shape[1])
                if not len(rows):
                    continue
                new = np.bincount(rows, minlength=len(s))
                self.settle(np.nonzero(self.fill[asked] + new > self.take + self.room)[0] + q)
                place = self.fill[rows + q] + np.arange(len(rows)) - (np.cumsum(new) - new)[rows]
                self.best[rows + q, place] = s[rows, cols]
                self.at[rows + q, place] = cols + (p + start)
                self.fill[asked] += new

    def result(self, sort: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.settle(np.nonzero(self.fill > (0 if sort else self.take))[0])
        return self.best[:, :self.take], self.at[:, :self.take], np.minimum(self.fill, self.take)


def running_top(qm: np.ndarray, pm: np.ndarray, k: int, tile_bytes: int = 64 << 20,
                floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, rows of ``pm``, number) of every query's k best, by score desc, then row asc, in any order.

    With ``floor`` only scores that reach the query's value count."""
    take = min(k, len(pm))
    top = RunningTop(len(qm), take, tile_bytes, floor, floor is None and len(pm) == take)
    top.add(qm, pm)
    return top.result()


def found_rows(qids, pids, scores) -> pa.Table:
    return pa.table([qids, pids, pa.array(scores)], names=["__q", "__p", "score"])


def gathered(qids: pa.ChunkedArray, pids: pa.Array, best: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.Table:
    """One row per score found: the query's first ``n`` of ``best``, with the ids."""
    kept = np.arange(best.shape[1]) < n[:, None]
    asked = pa.array(np.repeat(np.arange(len(n), dtype=np.int32), n))
    return found_rows(qids.combine_chunks().take(asked), pids.take(pa.array(at[kept])), best[kept])


def _block_counts(nq: int, np_: int, q_block_rows: int, p_block_rows: int, min_tasks: int,
                  k: int = 1000, dim: int = 768) -> tuple[int, int]:
    """Block counts from the memory budget, then widened to ``min_tasks`` tasks.

    Each widening step doubles the side that adds fewer shuffled bytes: another
    query split copies every passage vector once more (``N * dim * 8`` per
    existing query block); another passage split adds up to k candidates per
    query per new block (``Q * min(k, block) * 24``).  Blocks stay worth a
    matrix product (>= 128 queries, >= 512 passages).
    """
    qb = max(1, math.ceil(nq / q_block_rows))
    pb = max(1, math.ceil(np_ / p_block_rows))
    while qb * pb < min_tasks:
        can_q = nq / (qb * 2) >= 128
        can_p = np_ / (pb * 2) >= 512
        if not (can_q or can_p):
            break
        cost_q = np_ * dim * 8 * qb
        cost_p = nq * min(k, np_ / (pb * 2)) * 24 * pb
        if can_q and (not can_p or cost_q <= cost_p):
            qb *= 2
        else:
            pb *= 2
    return qb, pb


def _packed(df: DataFrame, key: str, vec: str, rows: int | None) -> tuple[DataFrame, type]:
    """Rows (part, first, n, ids, vectors) of ``rows`` (default: all) consecutive rows of a partition each; the
    type of the vectors' bytes."""
    kind = {"float": np.float32, "double": np.float64}[df.schema[vec].dataType.elementType.simpleString()]

    def pack(batches):
        part, held, n, first = TaskContext.get().partitionId(), [], 0, 0

        def packed(t):
            m = matrix(t[vec])
            ids = t[key].combine_chunks()
            ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([len(m)], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(m)], pa.int32()), ids),
                 pa.array([m.tobytes()], pa.binary())], ["part", "first", "n", "ids", "vectors"])
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while rows and n >= rows:
                t = pa.Table.from_batches(held)
                yield packed(t.slice(0, rows))
                held, n, first = t.slice(rows).to_batches(), n - rows, first + rows
        if n:
            yield packed(pa.Table.from_batches(held))
    id_type = df.schema[key].dataType.simpleString()
    return df.mapInArrow(pack, f"part int, first long, n long, ids array<{id_type}>, vectors binary"), kind


def _copy(a: pa.Array) -> pa.Array:
    return a.take(pa.array(np.arange(len(a))))


def _merged(first: np.ndarray, best: np.ndarray, at: np.ndarray, n: np.ndarray, k: int):
    """(row, rank, score, number) of every passage found, the lists of the queries that begin at the
    rows ``first`` put together and cut to ``k``; every list is sorted."""
    row = np.repeat(np.arange(len(n)), n)
    kept = np.arange(best.shape[1]) < n[:, None]
    score, number = best[kept], at[kept]
    own = (np.cumsum(first) - 1)[row]
    if not first.all():
        order = np.lexsort((number, -score, own))
        row, score, number, own = row[order], score[order], number[order], own[order]
    count = np.bincount(own)
    rank = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + 1
    ok = rank <= k
    return row[ok], rank[ok].astype(np.int32), score[ok], number[ok]


def _streamed(q: DataFrame, p: DataFrame, k: int, dim: int, np_: int, blocks: int, tile_bytes: int) -> DataFrame:
    """(__q, __p, rank, score) by queries of ``blocks`` tasks, in order of query and rank over the partitions.

    The passages are sorted by id and written once; a row of that table holds vectors of ``ROW_BYTES``.
    Every task multiplies its queries with these rows as they come from the reader, in any order, and
    keeps the running top-k and the ids.  Where there are more than ``TASK_PASSAGES`` ids, several tasks share
    them and a query's candidates are merged by a shuffle; they are then in no order."""
    spark = q.sparkSession
    row = max(1, ROW_BYTES // (4 * dim))
    path = scratch_path(spark, "passages")
    files = -(-np_ * 4 * dim // FILE_BYTES)
    packed, p_kind = _packed(p.repartitionByRange(files, "__p").sortWithinPartitions("__p"), "__p", "__pv", row)
    with shuffles_removed(spark):
        packed.write.parquet(path)
    written = spark.read.schema(packed.schema).parquet(path)
    # one small row per file: the number of its first passage
    sizes = sorted(written.groupBy("part").agg(F.sum("n")).collect())
    ends = np.cumsum([n for _, n in sizes]).tolist()
    starts = spark.createDataFrame([(part, end - n) for (part, n), end in zip(sizes, ends)], "part int, start long")
    slices = -(-np_ // TASK_PASSAGES)
    passages = (written.join(F.broadcast(starts), "part")
                .select((F.col("start") + F.col("first")).alias("start"), F.col("ids").alias("p_ids"),
                        F.col("vectors").alias("p_vectors")).coalesce(slices))
    asked, q_kind = _packed(q.repartitionByRange(blocks, "__q").sortWithinPartitions("__q"), "__q", "__qv", None)
    asked = asked.select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    total = ends[-1]

    def search(batches):
        top, ids = None, {}
        for batch in batches:
            q_of, p_of = (batch.column(f"{x}_vectors") for x in "qp")
            for i in range(batch.num_rows):
                if top is None:
                    asked = _copy(batch.column("q_ids")[i].values)
                    qm = np.frombuffer(q_of[i].as_buffer(), q_kind).reshape(len(asked), -1).astype(np.float64)
                    top = RunningTop(len(asked), min(k, total), tile_bytes, None, total <= k)
                start, found = batch.column("start")[i].as_py(), batch.column("p_ids")[i].values
                ids[start] = _copy(found)  # the batch goes
                top.add(qm, np.frombuffer(p_of[i].as_buffer(), p_kind).reshape(len(found), -1), start)
        if top is None:
            return
        firsts = np.array(sorted(ids))
        lengths = np.array([len(ids[x]) for x in firsts])
        places = np.cumsum(lengths) - lengths
        pool = pa.concat_arrays([ids[x] for x in firsts])
        best, at, n = top.result(sort=True)
        codes = asked.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        first = np.concatenate([[True], codes[1:] != codes[:-1]])
        heads = np.append(np.flatnonzero(first), len(first))
        done = 0
        while done < len(first):  # whole queries, SLAB rows or one query at a time
            end = heads[max(np.searchsorted(heads, done + SLAB, "right") - 1, np.searchsorted(heads, done, "right"))]
            r, rank, score, number = _merged(first[done:end], best[done:end], at[done:end], n[done:end], k)
            chunk = np.searchsorted(firsts, number, "right") - 1
            pids = pool.take(pa.array(places[chunk] + number - firsts[chunk]))
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(r + done)), pids, pa.array(rank), pa.array(score)],
                                             ["__q", "__p", "rank", "score"])
            done = end

    q_type, p_type = q.schema["__q"].dataType.simpleString(), p.schema["__p"].dataType.simpleString()
    # a row is a block on either side: as many pairs of rows as of query blocks and passage rows
    found = (passages.hint("shuffle_replicate_nl").crossJoin(asked)
             .mapInArrow(search, f"__q {q_type}, __p {p_type}, rank int, score double"))
    return found if slices == 1 else rank_by_score(found.drop("rank"), k, group="__q", item="__p", score="score", rank_col="rank")


def knn_exact(queries: DataFrame, passages: DataFrame, k: int = 1000, *,
              q_id: str = "qid", p_id: str = "pid", vec: str = "embedding",
              q_vec: str | None = None, p_vec: str | None = None,
              q_block_rows: int | None = None, p_block_rows: int | None = None,
              block_bytes: int = 176 << 20, work_bytes: int = 192 << 20, tile_bytes: int = 64 << 20,
              min_tasks: int | None = None, n_queries: int | None = None, n_passages: int | None = None,
              dim: int | None = None, ordered: bool = False) -> DataFrame:
    """Exact top-k by inner product for every query.

    Returns ``(q_id, p_id, rank, score)``; ranks from 1 ordered by score desc
    then passage id asc; fewer than k rows when the corpus is smaller than k.
    Null vectors and vectors with a null or NaN component fail the job.

    Block sizes default to a memory budget: a passage block holds about
    ``block_bytes`` of float32 vectors (twice, in arrival order and in order of id), the
    running top-k and the rows found of a query block ``work_bytes``, and a score tile at
    most ``tile_bytes``.  Row counts and the vector length are parameters
    so that inputs that are expensive to compute are not run again to be counted; they
    default to jobs over the inputs.  Larger passage blocks mean fewer
    candidates to merge (about k per query per passage block); more query
    blocks mean more copies of the passages, or readers of them beyond ``COPIES`` blocks.

    With ``ordered`` the rows are in order of query and rank over the partitions, as files are written.
    """
    spark = queries.sparkSession
    ship_package(spark)
    q_vec = q_vec or vec
    p_vec = p_vec or vec
    q = queries.select(F.col(q_id).alias("__q"), plain(F.col(q_vec), queries.schema[q_vec].dataType).alias("__qv"))
    p = passages.select(F.col(p_id).alias("__p"), plain(F.col(p_vec), passages.schema[p_vec].dataType).alias("__pv"))
    q_type = q.schema["__q"].dataType.simpleString()
    p_type = p.schema["__p"].dataType.simpleString()
    # two counts and one vector length size the blocks (single-row results)
    nq = queries.count() if n_queries is None else n_queries
    np_ = passages.count() if n_passages is None else n_passages
    if nq == 0 or np_ == 0:
        return spark.createDataFrame([], f"{q_id} {q_type}, {p_id} {p_type}, rank int, score double")
    dim = max(1, dim or p.select(F.size("__pv")).first()[0])
    p_block_rows = p_block_rows or passage_block_rows(int(k), dim, block_bytes)
    q_block_rows = q_block_rows or query_block_rows(min(int(k), p_block_rows, np_), dim, work_bytes)
    min_tasks = min_tasks or spark.sparkContext.defaultParallelism
    names = [F.col("__q").alias(q_id), F.col("__p").alias(p_id), F.col("rank"), F.col("score")]
    if math.ceil(nq / q_block_rows) > COPIES:
        found = _streamed(q, p, int(k), dim, np_, max(math.ceil(nq / q_block_rows), min(min_tasks, nq // 128)), tile_bytes)
        return (found.orderBy("__q", "rank") if ordered and np_ > TASK_PASSAGES else found).select(*names)
    qb, pb = _block_counts(nq, np_, q_block_rows, p_block_rows, min_tasks, int(k), dim)
    q_rep = (q.withColumn("qb", F.pmod(F.xxhash64("__q"), F.lit(qb)))
             .withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(pb - 1)).cast("array<bigint>"))))
    p_rep = (p.withColumn("pb", F.pmod(F.xxhash64("__p"), F.lit(pb)))
             .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)).cast("array<bigint>"))))
    kk = int(k)

    def block_topk(qt: pa.Table, pt: pa.Table) -> pa.Table:
        if qt.num_rows == 0 or pt.num_rows == 0:
            return found_rows(qt["__q"].slice(0, 0), pt["__p"].slice(0, 0), np.zeros(0))
        pm, pids = sorted_block(pt)
        best, at, n = running_top(matrix(qt["__qv"]).astype(np.float64), pm, kk, tile_bytes)
        return gathered(qt["__q"], pids, best, at, n)

    cand = (q_rep.groupBy("qb", "pb")
            .cogroup(p_rep.groupBy("qb", "pb"))
            .applyInArrow(block_topk, f"__q {q_type}, __p {p_type}, score double"))
    ranked = rank_by_score(cand, kk, group="__q", item="__p", score="score", rank_col="rank")
    return (ranked.orderBy("__q", "rank") if ordered else ranked).select(*names)


def score_pairs(queries: DataFrame, passages: DataFrame, key: str, *,
                q_vec: str = "q_vec", p_vec: str = "p_vec", temperature: float = 1.0) -> DataFrame:
    """Every query against every passage that shares ``key`` (e.g. the batch id),
    dot product divided by the temperature.  The key bounds the pair count
    (B queries x B*G passages per batch)."""
    joined = queries.join(passages, key)
    return joined.withColumn("score", dot(F.col(q_vec), F.col(p_vec)) / F.lit(float(temperature))) \
                 .drop(q_vec, p_vec)
