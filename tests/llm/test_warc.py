"""WARC archives: round trips, magics inside payloads, broken files."""

import pyarrow as pa
import pytest

from labelrank.llm import warc
from labelrank.session import scratch_path
from tests.llm.helpers import same_as_sql

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"


def round_trip(spark, rows, **opts):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, top long")
    path = scratch_path(spark, "warc-test")
    warc.write_warc(df.repartition(2), path, **opts)
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_round_trip_with_magic_inside(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.org/{i}\r\nX: y", t, "d", 1) for i, t in enumerate(
        [None, "", "<p>é😀</p>", FAKE, "x" + FAKE * 3 + "y", "same", "same", "same", "\r\n\r\n", "WARC/1.0", "z" * 200_000])]
    rows += [(50 + i, None, ("p%d " % i) * 300 + FAKE, "d", 1) for i in range(30)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = round_trip(spark, rows)
        names = ["page_id", "url", "html"]
        arrow = pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)})
        same_as_sql(got, warc._oracle(), pages=arrow)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 20))


def test_many_magics_in_one_archive(spark):
    """2,000 magics in one payload, and 1,000 payloads with one each, in one file cut into splits."""
    rows = [(0, "u", "".join(f"{i}WARC/1.0\r\n" for i in range(2000)), "d", 1)]
    rows += [(i, "u", f"page {i} {FAKE}", "d", 1) for i in range(1, 1001)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, top long")
        path = scratch_path(spark, "warc-test")
        warc.write_warc(df.coalesce(1), path)
        got = warc.read_warc(spark, path).select("page_id", "payload_bytes", "record_type").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 20))
    assert sorted(map(tuple, got)) == [(i, len(t.encode()), "response") for i, _, t, _, _ in rows]


def test_ties_and_nulls(spark):
    got = round_trip(spark, [(None, None, "a", "", 0), (4, None, "a", "", 0), (4, None, "a", "", 0), (None, "u", "b", "", 0)])
    rows = sorted(((r.page_id, r.record_type, r.refers_to) for r in got.collect()), key=repr)
    assert rows == sorted([(None, "revisit", 4), (4, "response", None), (4, "response", None), (None, "response", None)], key=repr)
    assert {r.record_type for r in round_trip(spark, [(1, "", "ab", "", 0), (2, "", "ab", "", 0)], revisit_bytes=3).collect()} == {"response"}


def test_empty_table(spark):
    assert round_trip(spark, []).collect() == []


def test_broken_archive_fails(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "hello"), (2, "u", "world")], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_warc(df.coalesce(1), path)
    part = next(p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-"))
    data = part.read_bytes().replace(b"hello", b"hell")
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "part-0.txt").write_bytes(data)
    with pytest.raises(Exception, match="broken archive|PythonException"):
        warc.read_warc(spark, str(tmp_path / "v")).collect()
