"""A dataset cache that is named by what it is made of.

The name is a hash of the result's schema, of the input files (path, length, time of change) and of
the parameters, so a changed input or parameter never meets an old result.  A writer writes aside,
into a folder of its own, and commits by creating one marker file that must not exist; the marker
names the writer's folder.  Of two writers one creates the marker; the other drops its folder and
reads the winner's.  No folder is renamed.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MARKER = "COMMITTED"


def _file(spark: SparkSession, path: str):
    """(file system, path) of ``path`` on the cluster's storage."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def input_files(spark: SparkSession, paths) -> list[tuple[str, int, int]]:
    """(path, length, time of change) of every file under ``paths``, sorted; hidden ones (``_``, ``.``)
    left out.  A path that doesn't exist fails."""
    found = []
    for path in paths:
        fs, p = _file(spark, path)
        files = fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            if f.getPath().getName()[0] not in "_.":
                found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def content_key(spark: SparkSession, schema: StructType, inputs, params: dict | None = None) -> str:
    """Name of the result of ``schema`` that is made from the files under ``inputs`` with ``params``
    (anything JSON can hold; their order doesn't matter)."""
    parts = [schema.simpleString(), input_files(spark, inputs), params or {}]
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def create_if_absent(spark: SparkSession, path: str, content: str) -> bool:
    """Create the file ``path``; False, and nothing changed, where it exists.

    Needs storage that creates a file exclusively: HDFS, a mounted file system, or an object store
    whose connector is set to conditional writes."""
    fs, p = _file(spark, path)
    if fs.getUri().getScheme() == "file":  # Hadoop's local file system only looks before it creates
        try:
            fd = os.open(p.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        with os.fdopen(fd, "wb") as f:
            f.write(content.encode())
        return True
    from py4j.protocol import Py4JJavaError
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if fs.exists(p):
            return False
        raise e
    out.write(bytearray(content.encode()))
    out.close()
    return True


def committed(spark: SparkSession, marker: str, wait: float = 30.0) -> str | None:
    """Folder that the marker names; None without a marker.  A marker ends with a line feed; one that
    is still being written is waited for, and after ``wait`` seconds reported as broken."""
    fs, p = _file(spark, marker)
    until = time.monotonic() + wait
    while fs.exists(p):
        stream = fs.open(p)
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        if text.endswith("\n"):
            return text[:-1]
        if time.monotonic() > until:
            raise RuntimeError(f"{marker} is incomplete: its writer died; delete it to compute again")
        time.sleep(0.2)
    return None


def content_cache(spark: SparkSession, root: str, compute, schema: StructType | str, inputs, params: dict | None = None,
                  wait: float = 30.0) -> DataFrame:
    """The result of ``compute()`` from the cache under ``root``; computed and written where it is new.

    ``compute`` returns a frame of ``schema`` (names and types in order; anything else fails) made
    from the files under ``inputs`` and from ``params`` alone.  Inputs that change while they are
    read fail the call instead of being stored under the old name.  A writer that dies leaves a
    folder without a marker, which no reader looks at.  Empty results are cached like others."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    key = content_key(spark, schema, inputs, params)
    base = f"{root.rstrip('/')}/{key}"
    name = committed(spark, f"{base}/{MARKER}", wait)
    if name is None:
        name = f"part-of-{uuid.uuid4().hex}"
        df = compute()
        if df.schema.simpleString() != schema.simpleString():
            raise ValueError(f"computed {df.schema.simpleString()}, expected {schema.simpleString()}")
        df.write.parquet(f"{base}/{name}")
        changed = content_key(spark, schema, inputs, params) != key
        if changed or not create_if_absent(spark, f"{base}/{MARKER}", name + "\n"):
            fs, p = _file(spark, f"{base}/{name}")
            fs.delete(p, True)
        if changed:
            raise RuntimeError("the inputs changed while they were read")
        name = committed(spark, f"{base}/{MARKER}", wait)
    return spark.read.schema(schema).parquet(f"{base}/{name}")
