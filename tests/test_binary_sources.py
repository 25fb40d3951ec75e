"""``.npy`` matrices and on-disk Arrow datasets: round trips, splits, refusals."""

import json
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelrank.sources import arrow_dataset as A
from labelrank.sources import npy as N


@pytest.mark.parametrize("dtype", ["f4", ">f4", "f8", "f2", "i8", "u1"])
def test_npy_ranges(spark, tmp_path, dtype):
    m = (np.arange(300 * 7).reshape(300, 7) % 200).astype(dtype)
    np.save(tmp_path / "a.npy", m)
    df = N.read_npy(spark, str(tmp_path / "a.npy"), partition_bytes=500)
    assert df.select(F.spark_partition_id()).distinct().count() >= 4
    got = df.orderBy("offset").collect()
    assert [r.offset for r in got] == list(range(300))
    assert np.array_equal(np.array([r.embedding for r in got]), m.astype("f8"))


def test_npy_folder_and_write(spark, tmp_path):
    m = np.random.default_rng(3).random((500, 16), dtype="f4")
    os.mkdir(tmp_path / "many")
    for i, at in enumerate(range(0, 500, 100)):
        np.save(tmp_path / "many" / f"{i}.npy", m[at:at + 100])
    (tmp_path / "many" / "_notes.npy").write_bytes(b"x")
    df = N.read_npy(spark, str(tmp_path / "many"))
    assert N.write_npy(df.repartition(7), str(tmp_path / "out" / "all.npy")) == 500
    assert np.array_equal(np.load(tmp_path / "out" / "all.npy"), m)
    assert os.listdir(tmp_path / "out") == ["all.npy"]
    assert N.write_npy(df.limit(0), str(tmp_path / "none.npy")) == 0
    assert N.read_npy(spark, str(tmp_path / "none.npy")).collect() == []


def test_npy_refuses(spark, tmp_path):
    np.save(tmp_path / "flat.npy", np.arange(4.0))
    np.save(tmp_path / "turned.npy", np.asfortranarray(np.ones((3, 2))))
    np.save(tmp_path / "words.npy", np.array([["a", "b"]]))
    np.save(tmp_path / "cut.npy", np.ones((9, 9)))
    with open(tmp_path / "cut.npy", "r+b") as f:
        f.truncate(300)
    for name in ("flat", "turned", "words", "cut", "missing"):
        with pytest.raises(Exception):
            N.read_npy(spark, str(tmp_path / f"{name}.npy")).collect()
    rows = [([0, 1, 1], None), ([0, 2, 4], None), ([0, 1, None], None), ([0, 1, 2], 1)]
    for offsets, short in rows:
        df = spark.createDataFrame([(o, [1.0] * (2 - (i == short))) for i, o in enumerate(offsets)], "offset long, embedding array<float>")
        with pytest.raises(Exception):
            N.write_npy(df, str(tmp_path / "bad.npy"))
    assert not [f for f in os.listdir(tmp_path) if "bad" in f]


def test_npy_id_map(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.eye(3, dtype="f4"))
    ids = spark.createDataFrame([("x", 2), ("y", 0), ("z", 1)], "id string, offset long")
    got = {r.id: list(r.embedding) for r in N.read_npy_vectors(spark, str(tmp_path / "v.npy"), ids).collect()}
    assert got == {"y": [1, 0, 0], "z": [0, 1, 0], "x": [0, 0, 1]}
    for wrong in ([("x", 0), ("y", 1)], [("x", 0), ("y", 1), ("z", 2), ("w", 3)], [("x", 0), ("y", 1), ("z", 1), ("w", 2)]):
        df = N.read_npy_vectors(spark, str(tmp_path / "v.npy"), spark.createDataFrame(wrong, "id string, offset long"))
        with pytest.raises(Exception, match="offset without"):
            df.collect()


SCHEMA = "docid bigint, input_ids array<int>, name string, parts struct<a:double,b:boolean>"


def rows(n):
    return [(i, list(range(i % 5)) if i % 7 else None, f"n{i}" * (i % 3), (i / 3, i % 2 == 0)) for i in range(n)]


def test_dataset_round_trip(spark, tmp_path):
    df = spark.createDataFrame(rows(5000), SCHEMA).repartition(3)
    A.write_arrow_dataset(df, str(tmp_path / "d"))
    back = A.read_arrow_dataset(spark, str(tmp_path / "d"), partition_bytes=0)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert back.select(F.spark_partition_id()).distinct().count() >= 5
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert A.read_arrow_dataset(spark, str(tmp_path / "d")).select("name").count() == 5000
    # other readers see plain Arrow streams with the features in the schema
    names = [x["filename"] for x in json.load(open(tmp_path / "d" / "state.json"))["_data_files"]]
    tables = [pa.ipc.open_stream(open(tmp_path / "d" / n, "rb")).read_all() for n in names]
    assert sum(t.num_rows for t in tables) == 5000
    features = json.loads(tables[0].schema.metadata[b"huggingface"])["info"]["features"]
    assert features["input_ids"] == {"feature": {"dtype": "int32", "_type": "Value"}, "_type": "Sequence"}
    with pytest.raises(Exception, match="already holds"):
        A.write_arrow_dataset(df, str(tmp_path / "d"))


def test_dataset_of_another_writer(spark, tmp_path):
    t = pa.table({"docid": ["a", "b", "c"] * 4, "kind": pa.array(["x", "y", "x"] * 4).dictionary_encode(),
                  "ids": pa.array([[1], [], None] * 4, pa.large_list(pa.int32()))})
    for name, table in (("p.arrow", t), ("q.arrow", t.drop_columns("kind").append_column("kind", t["kind"].cast("string")).select(t.column_names))):
        with pa.OSFile(str(tmp_path / name), "wb") as f, pa.ipc.new_stream(f, table.schema) as out:
            out.write_table(table, max_chunksize=5)
    (tmp_path / "stray.arrow").write_bytes(b"not listed")
    (tmp_path / "state.json").write_text(json.dumps({"_data_files": [{"filename": "q.arrow"}, {"filename": "p.arrow"}]}))
    got = A.read_arrow_dataset(spark, str(tmp_path), partition_bytes=0).collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in spark.createDataFrame(
        [(d, k, i) for d, k, i in zip("abc" * 8, "xyx" * 8, [[1], [], None] * 8)], "docid string, kind string, ids array<int>").collect())


def test_dataset_refuses(spark, tmp_path):
    A.write_arrow_dataset(spark.createDataFrame(rows(100), SCHEMA).coalesce(1), str(tmp_path))
    state = json.load(open(tmp_path / "state.json"))
    shard = tmp_path / state["_data_files"][0]["filename"]
    whole = shard.read_bytes()
    for bad in (whole[:len(whole) // 2], b"garbage!" * 10, b""):
        shard.write_bytes(bad)
        with pytest.raises(Exception):
            A.read_arrow_dataset(spark, str(tmp_path)).collect()
    shard.write_bytes(whole)
    (tmp_path / "state.json").write_text(json.dumps(state | {"_indices_data_files": [{"filename": "i.arrow"}]}))
    with pytest.raises(Exception, match="by an index"):
        A.read_arrow_dataset(spark, str(tmp_path)).collect()


def test_empty_dataset(spark, tmp_path):
    A.write_arrow_dataset(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))
    back = A.read_arrow_dataset(spark, str(tmp_path / "e"))
    assert back.collect() == [] and back.columns == ["docid", "input_ids", "name", "parts"]
