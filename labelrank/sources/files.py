"""Readers/writers.  Text formats are read with ``spark.read.text``
(never the CSV reader: quotes are data), split with built-in expressions, and
validated with ``raise_error`` so a malformed line fails the job, as in the
reference.  File order, where it matters, is recovered from
``_metadata.file_path`` / ``file_block_start`` (see :func:`line_numbers`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelrank.functions.text import PY_WHITESPACE, py_strip
from labelrank.session import shuffles_removed

PASSAGE = T.StructType([T.StructField("docid", T.StringType()), T.StructField("title", T.StringType()),
                        T.StructField("text", T.StringType())])
CORPUS_JSONL = PASSAGE
CANDIDATES = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("query", T.StringType()),
                           T.StructField("passages", T.ArrayType(PASSAGE))])
TRAIN_RECORDS = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("query", T.StringType()),
                              T.StructField("positive_passages", T.ArrayType(PASSAGE)),
                              T.StructField("negative_passages", T.ArrayType(PASSAGE))])
ANNOTATION = T.StructType([T.StructField("query_id", T.StringType()),
                           T.StructField("passages_ids", T.ArrayType(T.StringType())),
                           T.StructField("relevance_output", T.StringType()),
                           T.StructField("answer_output", T.StringType()),
                           T.StructField("utility_output", T.StringType()),
                           T.StructField("utility_ranking", T.StringType())])

SPLIT = pa.schema([("up", pa.bool_())] + [(c, pa.int64()) for c in ("q0", "r0", "q1", "r1")])


def _fail(msg: str, line) -> F.Column:
    return F.raise_error(F.concat(F.lit(f"malformed {msg} line: "), F.coalesce(line, F.lit("null"))))


def _checked(df: DataFrame, ok: F.Column, what: str) -> DataFrame:
    """Fails the job for a line that is not ``ok`` (null counts as not)."""
    good = F.when(F.coalesce(ok, F.lit(False)), True).otherwise(_fail(what, F.col("value")).cast("boolean"))
    return df.filter(good)


def _fields(lines: DataFrame, sep: str) -> DataFrame:
    """``lines`` with ``__f``, the fields of the stripped line.

    The fields are an exploded list of one element: a plain column would be put into every filter and
    column that uses it, and each of them would strip and split the line again.  Only a line with white
    space at an end goes through the pattern."""
    ends = F.concat(F.substring("value", 1, 1), F.substring("value", -1, 1))
    line = F.when(ends.rlike(PY_WHITESPACE), py_strip("value")).otherwise(F.col("value"))
    return lines.withColumn("__f", F.explode(F.array(F.split(line, sep, -1))))


def line_numbers(lines: DataFrame, name: str = "line_no") -> DataFrame:
    """Dense 0-based line numbers in file order (files by path, then position).

    Each input split is numbered inside its task with ``monotonically_increasing_id``
    (rows of one split are contiguous in a task).  Prefix sums go in two steps: over the
    splits of a file, partitioned by file, and over the files, of which there is one row
    each.  The splits, one small row each, are broadcast: a shuffle by file would carry all lines.
    """
    t = (lines.withColumn("__f", F.col("_metadata.file_path")).withColumn("__b", F.col("_metadata.file_block_start"))
         .withColumn("__m", F.monotonically_increasing_id()))
    splits = t.groupBy("__f", "__b").agg(F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__base"))
    in_file = Window.partitionBy("__f").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("__in", F.coalesce(F.sum("__n").over(in_file), F.lit(0)))
    files = splits.groupBy("__f").agg(F.sum("__n").alias("__fn"))
    before = Window.orderBy("__f").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("__f", F.coalesce(F.sum("__fn").over(before), F.lit(0)).alias("__fs"))
    splits = (splits.join(files, "__f")
              .select("__f", "__b", "__base", (F.col("__fs") + F.col("__in")).alias("__start")))
    return (t.join(F.broadcast(splits), ["__f", "__b"])
            .withColumn(name, F.col("__start") + F.col("__m") - F.col("__base"))
            .drop("__f", "__b", "__m", "__base", "__start"))


def read_lines(spark: SparkSession, path, numbered: bool = False) -> DataFrame:
    df = spark.read.text(path)
    return line_numbers(df) if numbered else df


def read_corpus_tsv(spark: SparkSession, path, with_offset: bool = True) -> DataFrame:
    """``id \\t text`` or ``id \\t title \\t text`` (extra fields ignored); ``offset`` = line order."""
    df = read_lines(spark, path, numbered=with_offset)
    f = F.split(F.col("value"), "\t", -1)
    df = _checked(df, F.size(f) >= 2, "corpus")
    two = F.size(f) == 2
    out = df.select(F.get(f, 0).alias("id"), F.when(two, F.lit(None)).otherwise(F.get(f, 1)).alias("title"),
                    F.when(two, F.get(f, 1)).otherwise(F.get(f, 2)).alias("text"),
                    *([F.col("line_no").alias("offset")] if with_offset else []))
    return out


def _read_json(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """One JSON object per line; a line that does not parse fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_corpus_jsonl(spark: SparkSession, path, with_offset: bool = False) -> DataFrame:
    """JSON lines; with ``with_offset`` also the line order (``offset``)."""
    if not with_offset:
        return _read_json(spark, path, CORPUS_JSONL)
    df = read_lines(spark, path, numbered=True)
    row = F.from_json("value", CORPUS_JSONL, {"mode": "FAILFAST"})
    return df.select(row.alias("r"), "line_no").select("r.*", F.col("line_no").alias("offset"))


def read_candidates(spark: SparkSession, path) -> DataFrame:
    return _read_json(spark, path, CANDIDATES)


def read_train_records(spark: SparkSession, path) -> DataFrame:
    """A missing ``title`` reads as null."""
    return _read_json(spark, path, TRAIN_RECORDS)


def _int(c):
    return c.try_cast("bigint")


def read_qrels(spark: SparkSession, path) -> DataFrame:
    """Two-column qrels ``qid \\t pid`` (ints, qid repeats); a malformed line fails the job."""
    df = _fields(read_lines(spark, path), "\t")
    f = F.col("__f")
    q, p = _int(F.get(f, 0)), _int(F.get(f, 1))
    return df.select(F.when(q.isNull() | p.isNull(), _fail("qrels", F.col("value"))).otherwise(q).alias("qid"),
                     p.alias("pid"))


def read_qrels_trec(spark: SparkSession, path, min_rel: int | None = None) -> DataFrame:
    """``qid Q0 docid rel`` (space separated) -> (qid, docid, rel).  By default every
    judged row is kept (grade 0 included, as the reference writes them); ``min_rel``
    keeps grades >= it."""
    df = _fields(read_lines(spark, path), " ")
    f = F.col("__f")
    df = _checked(df, (F.size(f) >= 4) & _int(F.get(f, 3)).isNotNull(), "TREC qrels")
    out = df.select(F.get(f, 0).alias("qid"), F.get(f, 2).alias("docid"), _int(F.get(f, 3)).cast("int").alias("rel"))
    return out if min_rel is None else out.filter(F.col("rel") >= min_rel)


def read_positives(spark: SparkSession, path) -> DataFrame:
    """``qid \\t a,b,c`` -> long (qid, idx = line order, pos, docid)."""
    df = read_lines(spark, path, numbered=True)
    f = F.split(F.col("value"), "\t", -1)
    df = _checked(df, F.size(f) == 2, "positives")
    return df.select(F.get(f, 0).alias("qid"), F.col("line_no").alias("idx"),
                     F.posexplode(F.split(F.get(f, 1), ",", -1)).alias("pos", "docid")) \
             .withColumn("pos", F.col("pos").cast("bigint"))


def read_negatives(spark: SparkSession, path, depth: int | None = None) -> DataFrame:
    """``qid \t n1,n2`` lines; lines of one qid concatenate in file order -> long
    (qid, pos, docid).  With ``depth`` only the first ``depth`` per qid are kept
    (a ``row_number <= depth`` top-k, partially applied before the shuffle);
    without it positions come from :func:`position_within` (no per-qid window)."""
    from labelrank.operators.ranking import position_within
    df = read_lines(spark, path, numbered=True)
    f = F.split(F.col("value"), "\t", -1)
    df = _checked(df, F.size(f) == 2, "negatives")
    ex = df.select(F.get(f, 0).alias("qid"), "line_no", F.posexplode(F.split(F.get(f, 1), ",", -1)).alias("i", "docid"))
    if depth is not None:
        w = Window.partitionBy("qid").orderBy("line_no", "i")
        out = ex.withColumn("pos", (F.row_number().over(w) - 1).cast("bigint")).filter(F.col("pos") < depth)
    else:
        out = position_within(ex, "qid", ["line_no", "i"], "pos").withColumn("pos", F.col("pos").cast("bigint"))
    return out.select("qid", "pos", "docid")


def read_teacher_scores(spark: SparkSession, paths: list[str] | str) -> DataFrame | None:
    """Whitespace ``qid did score`` (score may be wrapped in ``[]``) from several
    files; a later line (and a later file) overrides.  A missing file -> None
    (no teacher scores at all)."""
    if isinstance(paths, str):
        paths = paths.split(",")
    for p in paths:
        if not path_exists(spark, p):
            return None
    parts = []
    for i, p in enumerate(paths):
        d = read_lines(spark, p, numbered=True).withColumn("file_no", F.lit(i))
        parts.append(d)
    df = parts[0]
    for d in parts[1:]:
        df = df.unionByName(d)
    df = _fields(df, r"\s+")
    f = F.col("__f")
    score = F.regexp_replace(F.get(f, 2), r"^[\[\]]+|[\[\]]+$", "").try_cast("double")
    rows = df.select(F.get(f, 0).alias("qid"), F.get(f, 1).alias("did"),
                     F.when(score.isNull() | (F.size(f) != 3), _fail("teacher score", F.col("value"))).otherwise(score).alias("score"),
                     F.struct("file_no", "line_no").alias("__o"))
    return rows.groupBy("qid", "did").agg(F.max_by("score", "__o").alias("score"))


def _each_rank_once(lines: DataFrame, max_rank: int) -> bool:
    """Whether every split of a run ascends in (qid, rank) and no two splits overlap, as written in order: then
    no (qid, rank) has two lines.  Not so where a line is malformed.  One small row per split is collected."""
    def told(batches):
        done, at = [], None  # (ascends, first and last key) of the splits read; the split being read
        for batch in (b for b in batches if b.num_rows):
            split, block, q, r = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            sound = batch.column(2).null_count == 0 and batch.column(3).null_count == 0
            sound = bool(sound and ((r >= 1) & (r <= max_rank)).all())
            if not sound:
                q, r = np.zeros(len(split), np.int64), np.zeros(len(split), np.int64)
            cuts = [0, *(np.flatnonzero((split[1:] != split[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(split)]
            for i, j in zip(cuts, cuts[1:]):
                up = sound and bool(((q[i + 1:j] > q[i:j - 1]) | ((q[i + 1:j] == q[i:j - 1]) & (r[i + 1:j] > r[i:j - 1]))).all())
                first, last = (int(q[i]), int(r[i])), (int(q[j - 1]), int(r[j - 1]))
                if done and at == (split[i], block[i]):
                    done[-1] = [done[-1][0] and up and done[-1][2] < first, done[-1][1], last]
                else:
                    done.append([up, first, last])
                at = (split[i], block[i])
        yield pa.RecordBatch.from_pylist([{"up": u, "q0": a[0], "r0": a[1], "q1": b[0], "r1": b[1]} for u, a, b in done], SPLIT)

    df = _fields(lines.withColumn("__s", F.xxhash64("_metadata.file_path")).withColumn("__b", F.col("_metadata.file_block_start")), "\t")
    f = F.col("__f")
    p = _int(F.get(f, 1))
    keys = df.select("__s", "__b", F.when(p.isNotNull(), _int(F.get(f, 0))).alias("q"), _int(F.get(f, 2)).alias("r"))
    seen = sorted(keys.mapInArrow(told, "up boolean, q0 long, r0 long, q1 long, r1 long").collect(), key=lambda s: (s.q0, s.r0))
    return all(s.up for s in seen) and all((a.q1, a.r1) < (b.q0, b.r0) for a, b in zip(seen, seen[1:]))


def read_run(spark: SparkSession, path, max_rank: int = 1000) -> DataFrame:
    """``qid \\t pid \\t rank [\\t score]``; the last line of a (qid, rank) wins; ranks
    outside 1..max_rank or malformed lines fail the job.  Files in order, as ``write_ranking`` makes them, are
    read without a shuffle."""
    plain = read_lines(spark, path)
    once = _each_rank_once(plain, max_rank)
    df = _fields(plain if once else line_numbers(plain), "\t")
    f = F.col("__f")
    q, p, r = _int(F.get(f, 0)), _int(F.get(f, 1)), _int(F.get(f, 2))
    bad = q.isNull() | p.isNull() | r.isNull() | (r < 1) | (r > max_rank)
    rows = df.select(F.when(bad, _fail("run", F.col("value"))).otherwise(q).alias("qid"), p.alias("pid"),
                     r.alias("rank"), F.get(f, 3).try_cast("double").alias("score"), *([] if once else ["line_no"]))
    if once:
        return rows.select("qid", "rank", "pid", "score")
    # dealt by query, so that what follows per query needs no second shuffle
    return rows.repartition("qid").groupBy("qid", "rank").agg(F.max_by("pid", "line_no").alias("pid"),
                                                              F.max_by("score", "line_no").alias("score"))


def read_run_trec(spark: SparkSession, path) -> DataFrame:
    """``qid Q0 docid rank score tag`` -> (qid, docid, rank, score)."""
    df = _fields(read_lines(spark, path), r"\s+")
    f = F.col("__f")
    df = _checked(df, (F.size(f) == 6) & _int(F.get(f, 3)).isNotNull() & F.get(f, 4).try_cast("double").isNotNull(),
                  "TREC run")
    return df.select(F.get(f, 0).alias("qid"), F.get(f, 2).alias("docid"), _int(F.get(f, 3)).alias("rank"),
                     F.get(f, 4).try_cast("double").alias("score"))


def read_id_map(spark: SparkSession, path, reverse: bool = False) -> DataFrame:
    """``id \\t offset`` (or ``offset \\t id`` with ``reverse``) -> (id, offset)."""
    df = _fields(read_lines(spark, path), "\t")
    f = F.col("__f")
    a, b = (1, 0) if reverse else (0, 1)
    df = _checked(df, (F.size(f) == 2) & _int(F.get(f, b)).isNotNull(), "id map")
    return df.select(F.get(f, a).alias("id"), _int(F.get(f, b)).alias("offset"))


def write_lines(df: DataFrame, line: F.Column, path: str, order: list[str] | None = None,
                compression: str | None = None) -> None:
    """One text line per row; with ``order`` the files are written in that global
    order (range partitioned, so part files follow the order).  With ``compression`` (gzip) the files hold the
    same lines and are read in the same way, a file in one task."""
    out = df.select(line.alias("value"))
    if order:
        out = df.orderBy(*order).select(line.alias("value"))
    out = out.write.mode("overwrite")
    if compression:
        out = out.option("compression", compression).option("zlib.compress.level", "BEST_SPEED")
    with shuffles_removed(df.sparkSession):
        out.text(path)


def write_ranking(run: DataFrame, path: str, qid="qid", pid="pid", rank="rank", score="score", *,
                  in_order: bool = False, compression: str | None = None) -> None:
    """``qid \\t pid \\t rank \\t score`` lines, queries in order, ranks ascending.

    ``in_order``: the run's partitions are in this order already (``knn_exact(ordered=True)``)."""
    line = F.concat_ws("\t", F.col(qid).cast("string"), F.col(pid).cast("string"), F.col(rank).cast("string"),
                       F.col(score).cast("string"))
    write_lines(run, line, path, None if in_order else [qid, rank], compression)


def write_trec_run(run: DataFrame, path: str, tag: str = "labelrank", qid="qid", pid="pid", rank="rank",
                   score="score", *, in_order: bool = False, compression: str | None = None) -> None:
    """``qid Q0 docid rank score tag`` lines, in the order of :func:`write_ranking`."""
    line = F.concat_ws(" ", F.col(qid).cast("string"), F.lit("Q0"), F.col(pid).cast("string"),
                       F.col(rank).cast("string"), F.col(score).cast("string"), F.lit(tag))
    write_lines(run, line, path, None if in_order else [qid, rank], compression)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """``name: value`` lines in metric order (one small file)."""
    line = F.concat(F.col("metric"), F.lit(": "),
                    F.when(F.col("metric") == "QueriesRanked", F.col("value").cast("bigint").cast("string"))
                    .otherwise(F.col("value").cast("string")))
    metrics.select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_id_map(df: DataFrame, path: str, id_col: str = "id", offset: str = "offset", reverse: bool = False) -> None:
    cols = [F.col(offset).cast("string"), F.col(id_col).cast("string")]
    if not reverse:
        cols.reverse()
    write_lines(df, F.concat_ws("\t", *cols), path, [offset])


def write_annotations(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_vectors(df: DataFrame, path: str, id_col: str = "id", vec: str = "embedding") -> int:
    """Parquet ``(id, embedding array<float>)``; returns the row count, checked
    against the input (the reference asserts #vectors = #ids)."""
    out = df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<float>").alias("embedding"))
    seen = Observation()  # counts the input while it is written, without running it again
    out.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    n_in, n_out = seen.get["n"], out.sparkSession.read.parquet(path).count()
    if n_in != n_out:
        raise AssertionError(f"wrote {n_out} vectors for {n_in} ids")
    return n_out


def read_vectors(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the cluster file system (HDFS, object stores, local)."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def cached_dataset(spark: SparkSession, path: str, compute) -> DataFrame:
    """Reuse a completely written dataset at ``path`` (it has a ``_SUCCESS`` mark), else
    compute, write, then read."""
    if not path_exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
