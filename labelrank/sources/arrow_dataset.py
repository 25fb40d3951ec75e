"""On-disk Arrow datasets as a Spark data source: a folder of Arrow streams that a state file lists.

The layout is the one that dataset libraries save: ``state.json`` names the shards in order
(``_data_files``), ``dataset_info.json`` the features, and each shard is an Arrow IPC stream.  A
stream has no index, so planning walks its message headers and skips the bodies; every record batch
can then be read alone.  Shards that are written by a lost or repeated task are never listed, because
the state file is written last, from the tasks that were committed.
"""

from __future__ import annotations

import json
import struct
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from labelrank.session import ship_package
from labelrank.sources.storage import file_system

#: Batches of a shard are put together up to this many bytes a task; 0 gives one batch a task.
PARTITION_BYTES = 64 << 20
#: Rows of a written record batch.
BATCH_ROWS = 1000
# Fixed values of the Arrow IPC format: mark before a message, kinds of message, and the slots of
# a message's flat table that hold its kind and the length of its body.
CONTINUATION, SCHEMA_KIND, DICTIONARY_KIND, BATCH_KIND = 0xFFFFFFFF, 1, 2, 3
KIND_SLOT, BODY_SLOT = 1, 3


def _field(meta: bytes, slot: int, code: str, default=0):
    """A scalar of the table at the root of a flat buffer."""
    at = struct.unpack_from("<I", meta, 0)[0]
    slots = at - struct.unpack_from("<i", meta, at)[0]
    place = 4 + 2 * slot
    if place >= struct.unpack_from("<H", meta, slots)[0]:
        return default
    shift = struct.unpack_from("<H", meta, slots + place)[0]
    return struct.unpack_from(code, meta, at + shift)[0] if shift else default


def stream_messages(path: str) -> list[tuple[int, int, int]]:
    """(kind, offset, length) of every message of an Arrow stream; bodies are skipped."""
    fs, inner = file_system(path)
    size, at, out = fs.get_file_info(inner).size, 0, []
    with fs.open_input_file(inner) as f:
        while at < size:
            f.seek(at)
            head = f.read(8)
            if len(head) < 8 and out:
                break  # a stream may end without its end mark
            if len(head) < 8 or struct.unpack("<I", head[:4])[0] != CONTINUATION:
                raise ValueError(f"{path}: no Arrow stream at byte {at}")
            length = struct.unpack("<I", head[4:])[0]
            if not length:
                break
            meta = f.read(length)
            whole = 8 + length + _field(meta, BODY_SLOT, "<q")
            if at + whole > size:
                raise ValueError(f"{path} ends inside the message at byte {at}")
            out.append((_field(meta, KIND_SLOT, "<B"), at, whole))
            at += whole
    if not out or out[0][0] != SCHEMA_KIND:
        raise ValueError(f"{path}: no Arrow schema")
    return out


def shards(path: str) -> list[str]:
    """Files that the state file lists, in order."""
    fs, inner = file_system(path)
    with fs.open_input_file(f"{inner}/state.json") as f:
        state = json.loads(f.read())
    if state.get("_indices_data_files"):
        raise ValueError(f"{path}: rows are chosen by an index; save the dataset flattened")
    return [f"{path.rstrip('/')}/{x['filename']}" for x in state["_data_files"]]


def _arrow_schema(path: str) -> pa.Schema:
    fs, inner = file_system(path)
    with fs.open_input_file(inner) as f:
        return pa.ipc.open_stream(f).schema


@dataclass
class Batches(InputPartition):
    path: str
    offset: int
    length: int
    whole: bool  # from the beginning of the stream (dictionaries), not single batches


class ArrowDataset(DataSource):
    """``spark.read.format("arrow_dataset")`` / ``df.write.format("arrow_dataset")``; options ``path``,
    ``partition_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "arrow_dataset"

    def schema(self):
        files = shards(self.options["path"])
        if not files:
            raise ValueError(f"{self.options['path']}: no shards, so no schema")
        return from_arrow_schema(_arrow_schema(files[0]))

    def reader(self, schema) -> DataSourceReader:
        return DatasetReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return DatasetWriter(self.options, schema)


class DatasetReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.schema = options["path"], schema
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))

    def partitions(self):
        out = []
        for path in shards(self.path):
            messages = stream_messages(path)
            if any(kind == DICTIONARY_KIND for kind, _, _ in messages):
                out.append(Batches(path, 0, 0, True))
                continue
            run = None
            for kind, at, length in messages:
                if kind != BATCH_KIND:
                    continue
                if run is not None and at - run.offset + length <= self.partition_bytes:
                    run.length = at - run.offset + length
                else:
                    run = Batches(path, at, length, False)
                    out.append(run)
        return out or [Batches("", 0, 0, False)]

    def read(self, partition):
        if not partition.path:
            return
        fs, inner = file_system(partition.path)
        target = to_arrow_schema(self.schema)
        with fs.open_input_file(inner) as f:
            stream = pa.ipc.open_stream(f)
            if partition.whole:
                for batch in stream:
                    yield self._as(batch, target)
                return
            schema = stream.schema
            f.seek(partition.offset)
            while f.tell() < partition.offset + partition.length:
                yield self._as(pa.ipc.read_record_batch(pa.ipc.read_message(f), schema), target)

    @staticmethod
    def _as(batch, target):
        columns = [batch.column(field.name) for field in target]
        columns = [c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in columns]
        return pa.RecordBatch.from_arrays([c.cast(field.type) for c, field in zip(columns, target)], schema=target)


@dataclass
class ShardWritten(WriterCommitMessage):
    partition: int
    name: str
    rows: int
    size: int


def _feature(kind: pa.DataType):
    if pa.types.is_struct(kind):
        return {f.name: _feature(f.type) for f in kind}
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return {"feature": _feature(kind.value_type), "_type": "Sequence"}
    return {"dtype": {"float": "float32", "double": "float64"}.get(str(kind), str(kind)), "_type": "Value"}


class DatasetWriter(DataSourceArrowWriter):
    def __init__(self, options, schema):
        self.path, self.arrow = options["path"], to_arrow_schema(schema)
        fs, inner = file_system(self.path)
        if fs.get_file_info(f"{inner}/state.json").type != pafs.FileType.NotFound:
            raise FileExistsError(f"{self.path} already holds a dataset")
        fs.create_dir(inner, recursive=True)

    def write(self, batches):
        fs, inner = file_system(self.path)
        part, rows = TaskContext.get().partitionId(), 0
        name = f"data-{part:05d}-{uuid.uuid4().hex}.arrow"
        features = {f.name: _feature(f.type) for f in self.arrow}
        schema = self.arrow.with_metadata({"huggingface": json.dumps({"info": {"features": features}})})
        with fs.open_output_stream(f"{inner}/{name}") as f, pa.ipc.new_stream(f, schema) as out:
            for batch in batches:
                table = pa.Table.from_batches([batch]).cast(self.arrow).replace_schema_metadata(schema.metadata)
                out.write_table(table, max_chunksize=BATCH_ROWS)
                rows += batch.num_rows
        return ShardWritten(part, name, rows, fs.get_file_info(f"{inner}/{name}").size)

    def commit(self, messages):
        fs, inner = file_system(self.path)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        done = [m for m in done if m.rows] or done[:1]
        features = {f.name: _feature(f.type) for f in self.arrow}
        info = {"features": features, "splits": None, "dataset_size": sum(m.size for m in done)}
        state = {"_data_files": [{"filename": m.name} for m in done], "_fingerprint": uuid.uuid4().hex[:16],
                 "_format_columns": None, "_format_kwargs": {}, "_format_type": None, "_output_all_columns": False, "_split": None}
        for name, value in (("dataset_info.json", info), ("state.json", state)):
            with fs.open_output_stream(f"{inner}/{name}") as f:
                f.write(json.dumps(value, indent=2).encode())

    def abort(self, messages):
        fs, inner = file_system(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{inner}/{m.name}")


def read_arrow_dataset(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Rows of a saved dataset.  A shard that the state file lists and that is missing, cut off or no
    Arrow stream fails the job, as does a dataset whose rows are chosen by an index file."""
    ship_package(spark)
    spark.dataSource.register(ArrowDataset)
    return spark.read.format("arrow_dataset").option("partition_bytes", partition_bytes).load(path)


def write_arrow_dataset(df: DataFrame, path: str) -> None:
    """Saves ``df`` as a new dataset folder, one shard per partition with rows, in order of partition;
    an existing dataset fails.  An empty frame leaves one shard with the schema."""
    ship_package(df.sparkSession)
    df.sparkSession.dataSource.register(ArrowDataset)
    df.write.format("arrow_dataset").mode("append").save(path)
