"""Exact top-k search by inner product as a Voronoi kNN join.

Pivots are a bounded sample of the vectors; every vector belongs to the cell of its nearest pivot.
From the summaries of the cells (count, radius, largest norm; one row per cell) follow, for each
query, an upper bound of the score in every cell and a lower bound of its k-th best score.  Queries
travel, in groups of near cells, only to cells that can still hold one of their k best; a cell's
vectors travel only to groups that need them.  Large cells are cut into blocks, so that the task
of a (group, block) is bounded even if a third of the rows are one vector; it multiplies matrices
and keeps k rows per query, and a partial top-k merge ends the search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelrank.llm.components import write_scratch
from labelrank.llm.registry import register
from labelrank.session import ship_package, table

#: Queries of a group and vectors of a block.
GROUP, BLOCK = 4096, 32768
MOST_PIVOTS = 256


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def _cells(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each row and the distance to it."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0)
    d = (pivots * pivots).sum(1) - 2 * (x @ pivots.T)
    cell = np.argmin(d, axis=1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(1))


def needed(q: np.ndarray, pivots, count, radius, norm, k: int, own: int = 1) -> np.ndarray:
    """Which cells can hold one of the ``k`` best scores of each query (rows), from summaries.

    A cell's scores lie within |q| radius of q . pivot, and within |q| norm of 0.  Walking the
    cells by their lower bounds until k + own vectors (so many may have the query's id) are passed
    gives a score that the k-th best reaches."""
    size = np.sqrt((q * q).sum(1))[:, None]
    middle = q @ pivots.T
    slack = 1e-9 * (1 + np.abs(middle) + size * (radius + norm))
    high = np.minimum(middle + size * radius, size * norm) + slack
    low = np.maximum(middle - size * radius, -size * norm) - slack
    low = np.where(count > 0, low, -np.inf)
    order = np.argsort(-low, axis=1, kind="stable")
    passed = np.cumsum(count[order], axis=1)
    at = np.argmax(passed >= k + own, axis=1)
    bound = np.where(passed[:, -1] >= k + own,
                     np.take_along_axis(low, np.take_along_axis(order, at[:, None], 1), 1)[:, 0], -np.inf)
    return (high >= bound[:, None]) & (count > 0)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    top = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if top < 2 ** 53:
        return (q @ x.T).astype(np.int64)
    ints = [[int(v) for v in row] for row in x.tolist()]
    return np.array([[sum(int(a) * b for a, b in zip(row, y)) for y in ints] for row in q.tolist()],
                    dtype=object).astype(np.int64).reshape(len(q), len(x))


def _local(k: int, dim: int):
    """The k best of a block for every query of a group."""
    width = 8 * (dim + 1)

    def rows(t, kind):
        blobs = [b.as_py() for c, b in zip(t.column("kind"), t.column("blob")) if c.as_py() == kind]
        raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width)
        ids = np.ascontiguousarray(raw[:, :8]).view(np.int64).ravel()
        return ids, np.ascontiguousarray(raw[:, 8:]).view(np.float64).reshape(len(ids), dim)

    def run(t: pa.Table) -> pa.Table:
        qid, q = rows(t, 0)
        vid, x = rows(t, 1)
        out = []
        order = np.argsort(vid, kind="stable")
        vid, x = vid[order], x[order]
        tile = max(1, (64 << 20) // (8 * max(1, len(vid))))
        for lo in range(0, len(qid) if len(vid) else 0, tile):
            s = _scores(q[lo:lo + tile], x)
            for i, row in enumerate(s):
                take = min(len(row), k + int((vid == qid[lo + i]).sum()))
                best = np.argpartition(-row, take - 1)[:take] if take < len(row) else np.arange(len(row))
                worst = row[best].min()
                tied = np.flatnonzero(row >= worst)          # with all that tie, then by id
                tied = tied[vid[tied] != qid[lo + i]]
                tied = tied[np.argsort(-row[tied], kind="stable")][:k]
                out.append((np.full(len(tied), qid[lo + i]), vid[tied], row[tied]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})
    return run


def scaled_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                   scale: int = 256) -> DataFrame:
    """(id, x): floor(scale * component) as double; vectors null, empty or with a null or
    non-finite component, and rows with a null id, take no part."""
    x = F.transform(F.col(vec_col).cast("array<double>"), lambda v: F.floor(v * scale).cast("double"))
    ok = F.forall(F.col(vec_col).cast("array<double>"),
                  lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return (df.filter(F.col(id_col).isNotNull() & (F.size(vec_col) > 0) & ok)
            .select(F.col(id_col).cast("long").alias("id"), x.alias("x")))


def voronoi_knn_join(queries: DataFrame, data: DataFrame, k: int = 5, pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest inner products, exact.

    Both frames are (id long, x array<double>) with integer values.  Rows of ``data`` with the
    query's id are left out; ties go to the smaller id; with fewer candidates all are returned.
    Repeated rows count separately.  Vectors of unlike lengths fail the job.  Empty frames give
    no rows."""
    spark = data.sparkSession
    ship_package(spark)
    data, queries = write_scratch(data, "vectors"), write_scratch(queries, "queries")
    n, dims = data.agg(F.count("*"), F.max(F.size("x"))).first()
    out = "query_id long, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    many = pivots or int(min(MOST_PIVOTS, max(1, n ** 0.5 // 4)))
    share = min(1.0, 4 * many / n)
    sample = data.sample(share, seed=11).limit(4 * many).select("x").collect() or data.limit(1).select("x").collect()
    centres = np.unique(np.array([r[0] for r in sample]), axis=0)
    centres = centres[np.random.default_rng(3).permutation(len(centres))[:many]]

    def assign(batches):
        for batch in batches:
            x = _matrix(batch.column("x"))
            cell, far = _cells(x, centres)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(far), pa.array(np.sqrt((x * x).sum(1)))], ["cell", "far", "norm"])

    stats = (data.select("x").mapInArrow(assign, "cell long, far double, norm double").groupBy("cell")
             .agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm"))).collect()
    count, radius, norm = (np.zeros(len(centres)) for _ in range(3))
    for r in stats:
        count[r.cell], radius[r.cell], norm[r.cell] = r.n, r.far, r.norm
    blocks = np.maximum(1, np.ceil(count / BLOCK)).astype(np.int64)
    own = data.groupBy("id").count().agg(F.max("count")).first()[0]  # rows of one id at most

    # Groups of queries: near cells together, about GROUP queries each.
    n_queries = queries.count()
    n_groups = max(1, -(-n_queries // GROUP))
    line = np.argsort(centres @ (centres[0] - centres.mean(0)), kind="stable")
    place = np.empty(len(centres), np.int64)
    place[line] = np.arange(len(centres)) * min(n_groups, len(centres)) // len(centres)
    salts = max(1, -(-n_groups // len(centres)))

    def query_rows(batches):
        for batch in batches:
            q, ids = _matrix(batch.column("x")), batch.column("id").to_numpy()
            cell, _ = _cells(q, centres)
            group = place[cell] * salts + ids % salts
            use = needed(q, centres, count, radius, norm, k, own)
            raw = np.concatenate([ids.view(np.uint8).reshape(-1, 8), q.view(np.uint8).reshape(len(q), -1)], 1)
            keys, blobs = [], []
            for g in np.unique(group):
                mine = group == g
                for c in np.flatnonzero(use[mine].any(0)):
                    blob = raw[mine & use[:, c]].tobytes()
                    for b in range(blocks[c]):
                        keys.append((int(g), int(c), b))
                        blobs.append(blob)
            yield _keyed(0, keys, blobs)

    parts = "kind int, grp long, cell long, block int, blob binary"
    asked = write_scratch(queries.mapInArrow(query_rows, parts), "query-blocks")
    pairs = asked.select("grp", "cell").distinct().collect()  # at most groups x pivots rows
    groups_of: dict[int, list[int]] = {}
    for g, c in pairs:
        groups_of.setdefault(c, []).append(g)

    def data_rows(batches):
        for batch in batches:
            x, ids = _matrix(batch.column("x")), batch.column("id").to_numpy()
            cell, _ = _cells(x, centres)
            raw = np.concatenate([ids.view(np.uint8).reshape(-1, 8), x.view(np.uint8).reshape(len(x), -1)], 1)
            # a mixed id spreads the rows of a cell over its blocks
            block = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks[cell]
            keys, blobs = [], []
            for c in np.unique(cell):
                for b in np.unique(block[cell == c]) if int(c) in groups_of else ():
                    blob = raw[(cell == c) & (block == b)].tobytes()
                    for g in groups_of[int(c)]:
                        keys.append((g, int(c), int(b)))
                        blobs.append(blob)
            yield _keyed(1, keys, blobs)

    local = (asked.unionByName(data.mapInArrow(data_rows, parts)).groupBy("grp", "cell", "block")
             .applyInArrow(_local(k, dims), out))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _keyed(kind: int, keys, blobs) -> pa.RecordBatch:
    g, c, b = zip(*keys) if keys else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(keys), pa.int32()), pa.array(g, pa.int64()), pa.array(c, pa.int64()),
         pa.array(b, pa.int32()), pa.array(blobs, pa.binary())], ["kind", "grp", "cell", "block", "blob"])


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.x, v.x)::BIGINT AS score
  FROM v q, v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@register("op6_voronoi_topk", ORACLE)
def op6_voronoi_topk(spark, sf_dir):
    """The 5 best of all ``embeddings`` for every vector whose id is divisible by 50."""
    vectors = scaled_vectors(table(spark, sf_dir, "embeddings"))
    return voronoi_knn_join(vectors.filter("id % 50 = 0"), vectors, 5)
