"""URL filters by a temporal list join; DataFrame functions only.

List events (an entry is added or removed on a day) become validity intervals.  A capture has the
keys under which an entry can name it: its host and every parent domain, and host plus every
leading part of its path, of the depths that entries have.  So a very long address has as many
keys as the lists have depths, not one per part.  An as-of join finds, for each key and fetch day, the entries that were
active on that day, so a capture is judged by the lists as they were when it was fetched.  The
most specific active entry decides; at equal keys ``allow`` wins over ``block``.

A very common host meets the lists once per fetch day: keys and days are made distinct (with
partial aggregation) before the join, and only the active ones are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelrank.llm.components import write_scratch
from labelrank.llm.registry import register
from labelrank.session import table

#: Broadcast the active keys only up to this many rows; beyond it, shuffle.
BROADCAST_ROWS = 500_000


def url_host(url: Column) -> Column:
    """Lower-case host without user, port and a final dot; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def url_path(url: Column) -> Column:
    """Path without query and fragment, without a final slash."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.rtrim(path, F.lit("/"))


def entry_depths(entries: DataFrame) -> tuple[list[int], list[int]]:
    """(numbers of labels of the entries without a path, numbers of path parts of the others), rising.

    The entries of m different depths have m * (m - 1) / 2 characters at least, so these few numbers
    grow with the root of the lists' size at most."""
    slashes = F.length("entry") - F.length(F.replace("entry", F.lit("/"), F.lit("")))
    labels = F.length("entry") - F.length(F.replace("entry", F.lit("."), F.lit(""))) + 1
    found = entries.select((slashes > 0).alias("deep"), F.when(slashes > 0, slashes).otherwise(labels).alias("n")).distinct().collect()
    return sorted(r["n"] for r in found if not r["deep"]), sorted(r["n"] for r in found if r["deep"])


def url_keys(url: Column, depths: tuple[list[int], list[int]]) -> Column:
    """Keys of a capture of the given depths (see ``entry_depths``), least specific first: parent
    domains, host, host with path parts."""
    def up_to(numbers, most):
        return F.filter(F.array(*map(F.lit, numbers)).cast("array<int>"), lambda i: i <= most)
    host, labels = url_host(url), F.split(url_host(url), r"\.", -1)
    parts = F.split(url_path(url), "/", -1)  # the first part is empty
    domains = F.transform(up_to(depths[0], F.size(labels)), lambda i: F.call_function("substring_index", host, F.lit("."), -i))
    deeper = F.transform(up_to(depths[1], F.size(parts) - 1),
                         lambda i: F.concat(host, F.call_function("substring_index", url_path(url), F.lit("/"), i + 1)))
    return F.when(host.isNotNull(), F.concat(domains, deeper))


def validity_intervals(events: DataFrame) -> DataFrame:
    """(list, entry, since, until) from events (list, entry, day, active); until is exclusive or null.

    The last word of a day holds (``active`` wins over its removal on one day); days that repeat
    the state change nothing; a removal without an entry is ignored.  Rows with a null entry, list
    or day are ignored.  An entry has one row per day at most before the window."""
    days = (events.filter("list is not null and entry is not null and day is not null")
            .groupBy("list", "entry", "day").agg(F.max(F.coalesce("active", F.lit(False))).alias("active")))
    w = Window.partitionBy("list", "entry").orderBy("day")
    turns = days.withColumn("was", F.coalesce(F.lag("active").over(w), F.lit(False))).filter("active <> was")
    return (turns.withColumn("until", F.lead("day").over(w)).filter("active")
            .select("list", "entry", F.col("day").alias("since"), "until"))


def judge_captures(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url",
                   day_col: str = "fetched") -> DataFrame:
    """(<id_col>, <day_col>, verdict, list, entry, n_active) of every capture.

    verdict is ``block`` or ``pass``; list and entry name the deciding entry (null: none active);
    n_active counts the active entries that name the capture.  Addresses that are null or without
    a host, and null days, pass.  Repeated rows are judged alike, each in a row of its own; other columns are ignored;
    empty tables give no rows or no entries."""
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                           F.col(day_col).cast("date").alias("day"))
    # Captures of one address and day are one capture for the lists.
    asked = rows.select("url", "day").filter("url is not null and day is not null").distinct()
    intervals = write_scratch(validity_intervals(events), "intervals")
    keys = asked.select("url", "day", F.posexplode(url_keys(F.col("url"), entry_depths(intervals))).alias("depth", "key"))
    active = (keys.select("key", "day").distinct()
              .join(intervals, F.col("key") == F.col("entry"))
              .filter("day >= since and (until is null or day < until)")
              .select("key", "day", "list"))
    active = write_scratch(active, "active-entries")
    small = F.broadcast if active.count() <= BROADCAST_ROWS else (lambda df: df)
    best = F.max(F.struct("depth", (F.col("list") == "allow").alias("allow"), "list", F.col("key").alias("entry")))
    found = (keys.join(small(active), ["key", "day"]).groupBy("url", "day")
             .agg(best.alias("top"), F.count("*").alias("n")))
    found = found.select(F.col("url").alias("u"), F.col("day").alias("d"), "top", "n")
    return (rows.join(found, (F.col("url") == F.col("u")) & (F.col("day") == F.col("d")), "left")
            .select(F.col("id").alias(id_col), F.col("day").alias(day_col),
                    F.when(F.col("top.list") == "block", "block").otherwise("pass").alias("verdict"),
                    F.col("top.list").alias("list"), F.col("top.entry").alias("entry"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n_active")))


FIRST_DAY = "2024-01-01"


def crawl(pages: DataFrame) -> DataFrame:
    """Captures from ``pages``: a fetch day in a year that follows from the id."""
    return pages.select("page_id", "url", F.date_add(
        F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(365)).cast("int")).alias("fetched"))


def list_events(pages: DataFrame) -> DataFrame:
    """A dated block list and allow list made from the hosts and first path parts of ``pages``.

    Of hosts by their smallest page id m: every third is blocked on day m * 31 mod 300, removed
    10 + m mod 90 days later and, for even m, blocked again 20 days after that; the first path
    part of every seventh host's smallest page is allowed from day m * 17 mod 200."""
    host = url_host(F.col("url"))
    first = F.concat(host, F.regexp_extract(url_path(F.col("url")), "^(/[^/]*)", 1))
    hosts = (pages.filter(F.col("page_id").isNotNull()).withColumn("host", host).filter("host is not null")
             .groupBy("host").agg(F.min(F.struct("page_id", first.alias("first"))).alias("m"))
             .select("host", F.col("m.page_id").alias("m"), "m.first"))

    def event(which, name, entry, offset, active):
        return hosts.filter(which).select(
            F.lit(name).alias("list"), F.col(entry).alias("entry"),
            F.date_add(F.lit(FIRST_DAY).cast("date"), offset.cast("int")).alias("day"), F.lit(active).alias("active"))

    m = F.col("m")
    begin, end = m * 31 % 300, m * 31 % 300 + 10 + m % 90
    return (event("m % 3 = 0", "block", "host", begin, True)
            .unionByName(event("m % 3 = 0", "block", "host", end, False))
            .unionByName(event("m % 3 = 0 and m % 2 = 0", "block", "host", end + 20, True))
            .unionByName(event("m % 7 = 0", "allow", "first", m * 17 % 200, True)))


ORACLE = r"""
WITH p AS (SELECT page_id, url, DATE '2024-01-01' + ((page_id * 7919) % 365)::INTEGER AS fetched,
    nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\.$', ''), '') AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages),
h AS (SELECT host, min(page_id) AS m, arg_min(host || regexp_extract(path, '^(/[^/]*)', 1), page_id) AS first
  FROM p WHERE host IS NOT NULL GROUP BY host),
i AS (
  SELECT 'block' AS list, host AS entry, (m * 31 % 300) AS a, (m * 31 % 300 + 10 + m % 90) AS b FROM h WHERE m % 3 = 0
  UNION ALL SELECT 'block', host, m * 31 % 300 + 30 + m % 90, NULL FROM h WHERE m % 3 = 0 AND m % 2 = 0
  UNION ALL SELECT 'allow', first, m * 17 % 200, NULL FROM h WHERE m % 7 = 0),
v AS (SELECT DISTINCT list, entry, DATE '2024-01-01' + a::INTEGER AS since, DATE '2024-01-01' + b::INTEGER AS until FROM i),
k AS (SELECT page_id, fetched, url, host, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda j: array_to_string(string_split(host, '.')[j:], '.')),
    list_transform(range(2, len(string_split(path, '/')) + 1), lambda j: host || array_to_string(string_split(path, '/')[1:j], '/')))) AS key
  FROM p WHERE host IS NOT NULL),
f AS (SELECT k.page_id, v.list, v.entry, length(string_split(k.key, '/')[1]) AS hl, length(k.key) AS kl
  FROM k JOIN v ON k.key = v.entry AND k.fetched >= v.since AND (v.until IS NULL OR k.fetched < v.until)),
b AS (SELECT page_id, list, entry, count(*) OVER (PARTITION BY page_id) AS n,
  row_number() OVER (PARTITION BY page_id ORDER BY kl DESC, list) AS r FROM f)
SELECT p.page_id, p.fetched, CASE WHEN b.list = 'block' THEN 'block' ELSE 'pass' END AS verdict,
  b.list, b.entry, coalesce(b.n, 0)::BIGINT AS n_active
FROM p LEFT JOIN b ON b.page_id = p.page_id AND b.r = 1"""


@register("op7_url_filters", ORACLE)
def op7_url_filters(spark, sf_dir):
    """Every capture of ``pages`` against dated lists made from its hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_captures(crawl(pages), list_events(pages))
