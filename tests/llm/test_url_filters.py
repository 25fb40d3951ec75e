"""URL filters: intervals, specificity, odd addresses."""

import datetime as dt

from labelrank.llm import url_filters as U


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def judge(spark, captures, events):
    c = spark.createDataFrame([(i, u, None if d is None else day(d), "x") for i, u, d in captures],
                              "page_id long, url string, fetched date, key string")
    e = spark.createDataFrame([(a, b, None if d is None else day(d), s) for a, b, d, s in events],
                              "list string, entry string, day date, active boolean")
    return {(r.page_id, r.fetched): (r.verdict, r.list, r.entry, r.n_active) for r in U.judge_captures(c, e).collect()}


def test_active_on_the_fetch_day(spark):
    events = [("block", "ex.org", 10, True), ("block", "ex.org", 20, False), ("block", "ex.org", 30, True),
              ("block", "ex.org", 12, True), ("allow", "a.ex.org/ok", 0, True), ("block", "never.org", 5, False),
              ("block", None, 1, True), ("block", "x.y", None, True), ("block", "same.org", 3, True), ("block", "same.org", 3, False)]
    url = "http://u:p@A.Ex.org.:80/ok/page?q#f"
    got = judge(spark, [(1, "https://b.ex.org/x", d) for d in (9, 10, 19, 20, 29, 30, 99)]
                + [(2, url, 15), (2, "https://a.ex.org/okay", 15)], events)
    assert [got[1, day(d)][0] for d in (9, 10, 19, 20, 29, 30, 99)] == ["pass", "block", "block", "pass", "pass", "block", "block"]
    one = judge(spark, [(2, url, 15)], events)
    assert one[2, day(15)] == ("pass", "allow", "a.ex.org/ok", 2)
    assert judge(spark, [(2, "https://a.ex.org/okay", 15)], events)[2, day(15)] == ("block", "block", "ex.org", 1)
    assert judge(spark, [(3, "http://same.org", 4), (4, "http://never.org", 9)], events)[3, day(4)][0] == "block"


def test_odd_rows(spark):
    events = [("block", "org", 0, True)]
    rows = [(1, None, 3), (2, "", 3), (3, "no address", 3), (4, "http://a.org", None), (None, "http://a.org", 3),
            (5, "http:///x", 3), (6, "http://" + "a." * 300 + "org/" + "p/" * 2000, 3)]
    got = judge(spark, rows, events)
    assert [got[i, None if i == 4 else day(3)][0] for i in (1, 2, 3, 4, None, 5, 6)] == ["pass"] * 4 + ["block", "pass", "block"]
    assert judge(spark, [], events) == {} and judge(spark, rows[:1], []) == {(1, day(3)): ("pass", None, None, 0)}


def test_long_addresses_and_repeated_rows(spark):
    """Keys grow with the depths that the lists have, not with the parts of an address."""
    deep = "ex.org/" + "/".join(["q"] * 300)
    events = [("block", "ex.org/a", 0, True), ("allow", deep, 0, True), ("block", "org", 0, True), ("block", "x.", 0, True)]
    rows = [(1, "http://ex.org/a/" + "b/" * 500_000, 3), (2, "http://" + deep + "/r" * 400_000, 3),
            (3, "http://" + "a." * 400_000 + "org/x", 3), (4, "http://ex.org/a" + "/" * 300_000 + "x", 3), (1, "http://ex.org/a/" + "b/" * 500_000, 3),
            (5, "http://ex.org/a" + "/" * 300_000, 3)]
    got = judge(spark, rows, events)
    assert [got[i, day(3)] for i in (1, 2, 3, 4, 5)] == [
        ("block", "block", "ex.org/a", 2), ("pass", "allow", deep, 2), ("block", "block", "org", 1),
        ("block", "block", "ex.org/a", 2), ("block", "block", "ex.org/a", 2)]
    c = spark.createDataFrame([(1, "http://ex.org/a/b", day(3))] * 3, "page_id long, url string, fetched date")
    e = spark.createDataFrame([("block", "ex.org/a", day(0), True)] * 2, "list string, entry string, day date, active boolean")
    assert [tuple(r) for r in U.judge_captures(c, e).collect()] == [(1, day(3), "block", "block", "ex.org/a", 1)] * 3


def test_keys_as_all_parts_would_give(spark):
    rows = [("http://a.b.c/d/e//f/?q",), ("http://a..c./",), ("http://c",), ("no address",), ("http://c//x",)]
    df = spark.createDataFrame(rows, "url string")
    every = df.select(U.url_keys(U.F.col("url"), (list(range(1, 6)), list(range(1, 6)))).alias("k"))
    assert [r.k for r in every.collect()] == [
        ["c", "b.c", "a.b.c", "a.b.c/d", "a.b.c/d/e", "a.b.c/d/e/", "a.b.c/d/e//f"], ["c", ".c", "a..c"], ["c"], None, ["c", "c/", "c//x"]]
    some = df.select(U.url_keys(U.F.col("url"), ([2], [4])).alias("k"))
    assert [r.k for r in some.collect()] == [["b.c", "a.b.c/d/e//f"], [".c"], [], None, []]
    none = df.select(U.url_keys(U.F.col("url"), ([], [])).alias("k"))
    assert [r.k for r in none.collect()] == [[], [], [], None, []]
