"""WARC archives: writing with the text sink, reading by boundary-chain verification.

Writing: a record is one string whose last line feed is the sink's line separator, so part files
are valid uncompressed archives.  Records with equal payloads keep one response (the largest id);
the others become revisit records that name it.

Reading: the splits of a file are cut at every occurrence of the magic ``WARC/1.0``.  Each piece
is a candidate record; from its header comes the offset at which the next record must begin.
Per file, pointer jumping from offset 0 over these successors keeps only the reachable
candidates, so a magic inside a payload is rejected.  Payloads are digested where they are read;
only offsets and header fields are shuffled.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelrank.llm.components import write_scratch
from labelrank.llm.registry import register
from labelrank.session import scratch_path, ship_package, table

MAGIC = "WARC/1.0\r\n"
B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records of an archive at most: bounds the offsets of a file, which one task chains.
RECORDS_PER_FILE = 200_000
#: Broadcast the payloads that have several records only up to this many rows.
BROADCAST_ROWS = 500_000


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a string's UTF-8 bytes."""
    hexed, chars = F.sha1(payload), []
    for g in range(8):
        v = F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int")
        chars += [F.substring(F.lit(B32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*chars)


def write_warc(pages: DataFrame, path: str, revisit_bytes: int = 0, id_col: str = "page_id",
               url_col: str = "url", html_col: str = "html") -> None:
    """Writes one record per row under ``path`` (a folder of archives).

    Of rows with equal payloads of ``revisit_bytes`` or more, those with the largest id are
    responses and the others revisit it; rows that share that id are all responses, and rows
    with a null id revisit it too (all are responses if every id is null).  Null payloads count
    as empty.  Control characters and blanks in addresses are written as %20."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html")))
    shared = write_scratch(
        rows.filter(F.octet_length("html") >= revisit_bytes).groupBy("digest")
        .agg(F.max("id").alias("top"), F.count("*").alias("n")).filter("n > 1").select("digest", "top"),
        "shared-payloads")
    few = shared.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(shared) if few else shared, "digest", "left")
    revisit = F.coalesce(F.col("top").isNotNull() & ~F.col("id").eqNullSafe(F.col("top")), F.lit(False))
    size = F.octet_length("html").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    size, F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))

    def field(name, value):
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    record = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("id").cast("string"), F.lit(">"))),
        field("WARC-Target-URI", F.regexp_replace("url", "[\\x00-\\x20\\x7f]", "%20")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("top").cast("string"), F.lit(">")))),
        field("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r"))
    (rows.select(record.alias("value")).write.option("lineSep", "\n")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def _page(value: bytes | None):
    return int(value[len(b"<urn:page:"):-1]) if value else None


def _parse(piece: bytes):
    """(record length after the magic, type, id, refers, digest, payload size, payload digest or None)
    of a candidate; length -1 where the header does not parse."""
    try:
        end = piece.index(b"\r\n\r\n")
        head = dict(line.split(b": ", 1) for line in piece[:end].split(b"\r\n"))
        length, begin = int(head[b"Content-Length"]), end + 4
        block = piece[begin:begin + length]
        cut = block.index(b"\r\n\r\n") + 4
        http = dict(line.split(b": ", 1) for line in block[:cut - 4].split(b"\r\n")[1:])
        kind = head[b"WARC-Type"].decode()
        payload, found = int(http[b"Content-Length"]), None
        if kind != "response":
            found = ""
        elif len(block) == length:
            found = base64.b32encode(hashlib.sha1(block[cut:]).digest()).decode()
        return (begin + length + 4, kind, _page(head.get(b"WARC-Record-ID")), _page(head.get(b"WARC-Refers-To")),
                head[b"WARC-Payload-Digest"][5:].decode(), payload, found)
    except (ValueError, KeyError, IndexError):
        return -1, None, None, None, None, None, None


FIELDS = "length long, kind string, id long, refers long, digest string, payload_bytes long, found string"


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate records of all splits: file, split, order in the split, size of the piece, fields."""
    pieces = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("piece"))

    def run(batches):
        now, n = None, 0
        for batch in batches:
            order, size, parsed = [], [], []
            for f, s, p in zip(batch.column("file"), batch.column("split"), batch.column("piece")):
                f, s, p = f.as_py(), s.as_py(), p.as_py()
                now, n = ((f, s), 0) if now != (f, s) else (now, n + 1)
                order.append(n)
                size.append(len(p))
                parsed.append(_parse(p))
            cols = list(zip(*parsed)) if parsed else [[] for _ in range(7)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("split"), pa.array(order, pa.int64()), pa.array(size, pa.int64()),
                 *(pa.array(c, k) for c, k in zip(cols, kinds))],
                ["file", "split", "n", "size", "length", "kind", "id", "refers", "digest", "payload_bytes", "found"])

    return pieces.mapInArrow(run, f"file string, split long, n long, size long, {FIELDS}")


def reachable(start: np.ndarray, successor: np.ndarray, end: int) -> np.ndarray:
    """Which candidates the chain from offset 0 passes, by pointer jumping.

    ``start`` is sorted; a successor that is neither a candidate nor the end of the file is
    a dead end.  Fails where the chain from 0 does not reach the end."""
    n = len(start)
    at = np.searchsorted(start, successor)
    hit = (at < n) & (start[np.minimum(at, n - 1)] == successor)
    jump = np.append(np.where(successor == end, n, np.where(hit, at, n + 1)), [n, n + 1])
    seen = np.zeros(n + 2, dtype=bool)
    seen[0 if n and start[0] == 0 else n + 1] = True
    while True:
        more = seen.copy()
        more[jump[np.flatnonzero(seen)]] = True
        if (more == seen).all():
            break
        seen, jump = more, jump[jump]
    if n and not seen[n]:
        raise ValueError("broken archive: the records from its start do not lead to its end")
    return seen[:n]


def _chain(t: pa.Table) -> pa.Table:
    """True records of one file, with their offset and whether a magic lies inside."""
    t = t.sort_by([("split", "ascending"), ("n", "ascending")])
    size = t.column("size").to_numpy()
    begin = np.concatenate([[0], np.cumsum(size + len(MAGIC))])  # of the pieces' contents
    end = int(begin[-1]) - len(MAGIC)
    t, begin, size = t.slice(1), begin[1:-1], size[1:]           # nothing precedes the first magic
    length = t.column("length").to_numpy()
    start = begin - len(MAGIC)
    successor = np.where(length < 0, -1, begin + length)
    ok = reachable(start, successor, end)
    t = t.append_column("start", pa.array(start)).append_column("after", pa.array(successor))
    t = t.append_column("split_up", pa.array(length > size))
    return t.filter(pa.array(ok)).select(
        ["file", "start", "after", "split_up", "kind", "id", "refers", "digest", "payload_bytes", "found"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``(file, start, page_id, payload_bytes, payload_digest, record_type, refers_to)`` per record.

    Payload size and digest are those of the full payload, for revisits as the record states
    them.  A response whose payload does not have the digest it states fails the job, as does a
    file whose records do not lead to its end.  Empty files and folders give no rows."""
    ship_package(spark)
    schema = f"file string, start long, after long, split_up boolean, {FIELDS[len('length long, '):]}"
    rows = write_scratch(candidates(spark, path).groupBy("file").applyInArrow(_chain, schema), "warc-records")
    parts = rows.filter("found is null")
    if not parts.isEmpty():  # payloads with the magic inside: put together from their pieces
        rows = rows.filter("found is not null").unionByName(_whole(spark, path, parts))
    wrong = (F.col("kind") == "response") & ~F.col("found").eqNullSafe(F.col("digest"))
    return rows.select(
        "file", "start", F.col("id").alias("page_id"), "payload_bytes",
        F.when(wrong, F.raise_error(F.lit("a payload does not have the digest it states")))
        .otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"), F.col("refers").alias("refers_to"))


def _whole(spark: SparkSession, path: str, parts: DataFrame) -> DataFrame:
    """Digests of records with a magic inside: their pieces, brought together by record."""
    sized = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("piece"))

    def number(batches):
        now, n = None, 0
        for batch in batches:
            order = []
            for key in zip(batch.column("file").to_pylist(), batch.column("split").to_pylist()):
                now, n = (key, 0) if now != key else (now, n + 1)
                order.append(n)
            yield batch.append_column("n", pa.array(order, pa.int64()))

    sized = sized.mapInArrow(number, "file string, split long, piece binary, n long")

    def owners(t, spans):
        """The record of every piece of one file, by binary search among the records' offsets."""
        t, spans = t.sort_by([("split", "ascending"), ("n", "ascending")]), spans.sort_by("start")
        begin = np.concatenate([[0], np.cumsum(t.column("size").to_numpy() + len(MAGIC))])[:-1]
        start, after = spans.column("start").to_numpy(), spans.column("after").to_numpy()
        at = np.searchsorted(start, begin) - 1  # the last record that starts before
        held = np.flatnonzero((at >= 0) & (begin <= after[at])) if len(start) else np.zeros(0, np.int64)
        return (t.take(pa.array(held)).select(["file", "split", "n"])
                .append_column("begin", pa.array(begin[held])).append_column("start", pa.array(start[at[held]])))

    places = sized.select("file", "split", "n", F.octet_length("piece").cast("long").alias("size"))
    owned = (places.groupBy("file").cogroup(parts.select("file", "start", "after").groupBy("file"))
             .applyInArrow(owners, "file string, split long, n long, begin long, start long"))
    joined = (sized.join(owned, ["file", "split", "n"]).groupBy("file", "start")
              .agg(F.array_sort(F.collect_list(F.struct("begin", "piece"))).alias("pieces")))

    def digest(batches):
        for batch in batches:
            out = [_parse(MAGIC.encode().join(p["piece"] for p in ps))[-1] for ps in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("start"), pa.array(out, pa.string())], ["file", "start", "found"])

    found = joined.mapInArrow(digest, "file string, start long, found string")
    return parts.drop("found").join(found, ["file", "start"]).select(parts.columns)


def _oracle() -> str:
    chars = []
    for g in range(8):
        v = f"('0x' || substr(h, {5 * g + 1}, 5))::INTEGER"
        chars += [f"substr('{B32}', (({v} >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0)]
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {' || '.join(chars)} AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to FROM t"""


@register("op5_warc", _oracle())
def op5_warc(spark, sf_dir):
    """Whole ``pages`` written as archives in the shared folder and read back."""
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
