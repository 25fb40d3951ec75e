"""The content-addressed cache: two writers, changed inputs, broken writers."""

import glob
import threading
import time

import pytest
from pyspark.sql import functions as F

from labelrank.sources import cache as C

SCHEMA = "id bigint, writer string"


def made(spark, src, writer, calls):
    def compute():
        calls.append(writer)
        return spark.read.parquet(src).select("id", F.lit(writer).alias("writer"))
    return compute


def writers(df):
    return {r.writer for r in df.collect()}


def test_same_inputs_are_computed_once(spark, tmp_path):
    src, root, calls = str(tmp_path / "in"), str(tmp_path / "cache"), []
    spark.range(10).write.parquet(src)

    def get(writer, **params):
        return C.content_cache(spark, root, made(spark, src, writer, calls), SCHEMA, [src], params)
    assert writers(get("a", x=1, y=2)) == writers(get("b", y=2, x=1)) == {"a"}
    assert writers(get("c", x=2, y=2)) == {"c"} and calls == ["a", "c"]
    time.sleep(1.1)
    spark.range(10).write.mode("overwrite").parquet(src)
    assert writers(get("d", x=1, y=2)) == {"d"} and calls == ["a", "c", "d"]


def test_two_writers(spark, tmp_path):
    src, root, calls, out = str(tmp_path / "in"), str(tmp_path / "cache"), [], {}
    spark.range(100).write.parquet(src)
    both = threading.Barrier(2)

    def write(writer):
        def compute():
            both.wait(60)  # neither has committed when both compute
            return made(spark, src, writer, calls)()
        out[writer] = C.content_cache(spark, root, compute, SCHEMA, [src]).collect()
    threads = [threading.Thread(target=write, args=(w,)) for w in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(calls) == ["a", "b"]
    assert len({r.writer for rows in out.values() for r in rows}) == 1 and len(out["a"]) == len(out["b"]) == 100
    assert len(glob.glob(f"{root}/*/part-of-*")) == 1  # the loser's folder is gone


def test_only_one_creates_the_marker(spark, tmp_path):
    path, won = str(tmp_path / "marker"), []
    threads = [threading.Thread(target=lambda i=i: won.append(i) if C.create_if_absent(spark, path, f"{i}\n") else None) for i in range(16)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and C.committed(spark, path) == str(won[0])


def test_broken_writers(spark, tmp_path):
    src, root, calls = str(tmp_path / "in"), str(tmp_path / "cache"), []
    spark.range(3).write.parquet(src)

    def get(compute, schema=SCHEMA, wait=0.5):
        return C.content_cache(spark, root, compute, schema, [src], wait=wait)

    def fails():
        raise ValueError("no result")
    with pytest.raises(ValueError, match="no result"):
        get(fails)
    with pytest.raises(ValueError, match="expected struct<id:bigint,other:string>"):
        get(made(spark, src, "x", []), "id bigint, other string")

    def changes():
        df = spark.createDataFrame([(1, "a")], SCHEMA)
        spark.range(4).write.mode("append").parquet(src)
        return df
    with pytest.raises(RuntimeError, match="inputs changed"):
        get(changes)
    assert writers(get(made(spark, src, "b", calls))) == {"b"} and calls == ["b"]
    marker, = glob.glob(f"{root}/*/{C.MARKER}")
    open(marker, "w").write("part-of-x")
    with pytest.raises(RuntimeError, match="incomplete"):
        get(made(spark, src, "c", calls))
    with pytest.raises(Exception, match="does not exist"):
        C.content_cache(spark, root, fails, SCHEMA, [f"{src}-none"])


def test_empty_result(spark, tmp_path):
    src, root, calls = str(tmp_path / "in"), str(tmp_path / "cache"), []
    spark.range(0).write.parquet(src)
    for writer in "ab":
        assert C.content_cache(spark, root, made(spark, src, writer, calls), SCHEMA, [src]).collect() == []
    assert calls == ["a"]
