"""``.npy`` matrices as a Spark data source: one vector per row, in the order of a row offset.

Reading plans byte ranges from the header, so one large file is read by many tasks; a folder of
matrices is read as one, in order of name.  Writing makes one file: its length is known from the
number of rows, so every task writes its rows at their own place.  Writing a row again, by a task
that is repeated after a lost executor, changes nothing.  The file gets its name when every row has
been written.
"""

from __future__ import annotations

import io
import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from labelrank.session import ship_package
from labelrank.sources.storage import file_system, files_in, local_path

#: Bytes of a file for each task, and of each Arrow batch that it yields.
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
#: Spark's element type for each kind of number; others are refused.
ELEMENTS = {"f2": ("float", "<f4"), "f4": ("float", "<f4"), "f8": ("double", "<f8"), "i1": ("tinyint", "<i1"),
            "i2": ("smallint", "<i2"), "i4": ("int", "<i4"), "i8": ("bigint", "<i8"), "u1": ("smallint", "<i2")}


@dataclass
class Header:
    dtype: np.dtype
    rows: int
    dim: int
    size: int  # bytes before the first row


def read_header(path: str) -> Header:
    """Header of a C-ordered matrix of numbers; anything else fails with ValueError."""
    fs, inner = file_system(path)
    with fs.open_input_file(inner) as f:
        head = io.BytesIO(f.read(1 << 16))
    try:
        version = np.lib.format.read_magic(head)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, dtype = read(head)
    except ValueError as e:
        raise ValueError(f"{path}: {e}") from e
    if len(shape) != 2 or (fortran and min(shape) > 1) or f"{dtype.kind}{dtype.itemsize}" not in ELEMENTS:
        raise ValueError(f"{path}: needs a matrix of numbers in C order, not {dtype} {shape}")
    size = fs.get_file_info(inner).size
    if size != head.tell() + shape[0] * shape[1] * dtype.itemsize:
        raise ValueError(f"{path}: {size} bytes do not hold {shape[0]} rows of {shape[1]} {dtype}")
    return Header(dtype, shape[0], shape[1], head.tell())


@dataclass
class RowRange(InputPartition):
    path: str
    header: Header
    first: int   # row of the file
    rows: int
    offset: int  # row of the whole


class NpySource(DataSource):
    """``spark.read.format("npy")``: (offset bigint, embedding array); options ``path``, ``partition_bytes``.
    ``df.write.format("npy")``: (offset, embedding) rows; options ``path``, ``rows``, ``dim``."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        heads = [read_header(p) for p in files_in(self.options["path"], ".npy")]
        if not heads:
            raise FileNotFoundError(f"no .npy file in {self.options['path']}")
        if len({(h.dtype.newbyteorder("="), h.dim) for h in heads}) > 1:
            raise ValueError(f"{self.options['path']}: matrices of different widths or types")
        h = heads[0].dtype
        return f"offset bigint, embedding array<{ELEMENTS[f'{h.kind}{h.itemsize}'][0]}>"

    def reader(self, schema) -> DataSourceReader:
        return NpyReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return NpyWriter(self.options)


class NpyReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))

    def partitions(self):
        out, offset = [], 0
        for path in files_in(self.path, ".npy"):
            h = read_header(path)
            step = max(1, self.partition_bytes // max(1, h.dim * h.dtype.itemsize))
            out += [RowRange(path, h, at, min(step, h.rows - at), offset + at) for at in range(0, h.rows, step)]
            offset += h.rows
        return out or [RowRange("", Header(np.dtype("<f4"), 0, 0, 0), 0, 0, 0)]

    def read(self, partition):
        h, done = partition.header, 0
        width = h.dim * h.dtype.itemsize
        step = max(1, BATCH_BYTES // max(1, width))
        if not partition.rows:
            return
        fs, inner = file_system(partition.path)
        native = ELEMENTS[f"{h.dtype.kind}{h.dtype.itemsize}"][1]
        with fs.open_input_file(inner) as f:
            f.seek(h.size + partition.first * width)
            while done < partition.rows:
                n = min(step, partition.rows - done)
                values = np.frombuffer(f.read(n * width), h.dtype).astype(native)
                if len(values) != n * h.dim:
                    raise EOFError(f"{partition.path} ends before row {partition.first + done + n}")
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * h.dim)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(n) + partition.offset + done), pa.ListArray.from_arrays(ends, pa.array(values))],
                    ["offset", "embedding"])
                done += n


@dataclass
class RowsWritten(WriterCommitMessage):
    rows: int


class NpyWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.rows, self.dim = options["path"], int(options["rows"]), int(options["dim"])
        self.target = local_path(self.path)
        if self.target is None:
            raise ValueError("a single .npy file is written in place; use write_vectors for object stores")
        head = io.BytesIO()
        np.lib.format.write_array_header_1_0(head, {"descr": "<f4", "fortran_order": False, "shape": (self.rows, self.dim)})
        self.head = head.getvalue()
        self.unfinished = f"{os.path.dirname(self.target)}/_{os.path.basename(self.target)}-{uuid.uuid4().hex}"
        os.makedirs(os.path.dirname(self.target), exist_ok=True)
        with open(self.unfinished, "wb") as f:
            f.write(self.head)
            f.truncate(len(self.head) + 4 * self.dim * self.rows)

    def write(self, batches):
        done, width = 0, 4 * self.dim
        with open(self.unfinished, "r+b") as f:
            for batch in batches:
                offset, vectors = batch.column("offset").to_numpy(), batch.column("embedding")
                if batch.num_rows and (vectors.null_count or not (vectors.value_lengths().to_numpy() == self.dim).all()
                                       or vectors.flatten().null_count):
                    raise ValueError(f"needs {self.dim} numbers in every vector")
                values = vectors.flatten().to_numpy().astype("<f4").tobytes()
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(offset) != 1) + 1, [len(offset)]]).astype(int)
                for lo, hi in zip(cuts[:-1], cuts[1:]):  # runs of neighbours
                    if hi > lo:
                        f.seek(len(self.head) + int(offset[lo]) * width)
                        f.write(values[lo * width:hi * width])
                done += len(offset)
            f.flush()
            os.fsync(f.fileno())
        return RowsWritten(done)

    def commit(self, messages):
        done = sum(m.rows for m in messages if m is not None)
        if done != self.rows:
            os.remove(self.unfinished)
            raise ValueError(f"wrote {done} of {self.rows} rows")
        os.replace(self.unfinished, self.target)

    def abort(self, messages):
        if os.path.exists(self.unfinished):
            os.remove(self.unfinished)


def read_npy(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """``(offset, embedding)`` of a matrix file, or of a folder of them counted through in order of name.

    Half floats become floats.  No rows give no rows; matrices that are no C-ordered numbers, or
    whose size does not fit their header, fail."""
    ship_package(spark)
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("partition_bytes", partition_bytes).load(path)


def read_npy_vectors(spark: SparkSession, path: str, id_map: DataFrame, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """``(id, embedding)`` through an id map (id, offset).  A row without an id, or an id whose offset
    has no row or stands twice, fails the job."""
    ids = id_map.select("id", "offset").groupBy("offset").agg(F.min("id").alias("id"), F.count("*").alias("__n"))
    both = read_npy(spark, path, partition_bytes).join(ids, "offset", "full")
    wrong = F.col("embedding").isNull() | F.col("id").isNull() | (F.col("__n") > 1)
    # the check stands on a column of the result, so it can't be pruned
    text = F.concat(F.lit("offset without one id and one vector: "), F.col("offset").cast("string"))
    return both.select(F.when(wrong, F.raise_error(text)).otherwise(F.col("id")).alias("id"), "embedding")


def write_npy(df: DataFrame, path: str, offset: str = "offset", vec: str = "embedding") -> int:
    """Writes float32 rows by their offset (0 to n - 1, each once) as one ``.npy`` file on a mounted
    shared file system; returns n.  Other offsets, and vectors that are null, hold nulls or differ in
    length, fail.  An existing file is replaced when all rows are written."""
    spark = df.sparkSession
    ship_package(spark)
    spark.dataSource.register(NpySource)
    rows = df.select(F.col(offset).cast("bigint").alias("offset"), F.col(vec).cast("array<float>").alias("embedding"))
    seen = rows.agg(F.count("*").alias("n"), F.min("offset").alias("low"), F.max("offset").alias("high"),
                    F.max(F.size("embedding")).alias("dim")).first()
    repeated = rows.groupBy("offset").count().filter("offset is null or count > 1")
    if seen.n and (seen.low != 0 or seen.high != seen.n - 1 or not repeated.isEmpty()):
        raise ValueError(f"offsets of {seen.n} rows are not 0 to {seen.n - 1}, each once")
    (rows.repartitionByRange("offset").sortWithinPartitions("offset").write.format("npy").mode("append")
     .option("rows", seen.n).option("dim", max(seen.dim or 0, 0)).save(path))
    return seen.n
