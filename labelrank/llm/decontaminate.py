"""Benchmark decontamination by size-partitioned MinHash containment search; DataFrame functions only.

A test item of n distinct 5-word shingles is contained in a document that holds at least 0.8 n of
them, so at most 0.2 n are missing, and of any 0.2 n + 1 shingles one is there.  The sketch of an
item is its 0.2 n + 1 smallest shingle hashes (its MinHash values); items are partitioned by size,
and each partition has the largest hash that its sketches hold.  A document's shingles are hashed
as they stream by; only those up to the largest threshold of the partitions with an item that is
small enough for the document can meet a sketch.  So no contained item is missed, however long the
document.  Candidates are verified by the exact shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelrank.llm.components import write_scratch
from labelrank.llm.registry import register
from labelrank.session import table

#: Broadcast a table only up to this many rows (8 to 24 bytes each); beyond it, shuffle.
BROADCAST_ROWS = 1_000_000
#: Bound of the characters of the item shingles, too, where they are broadcast.
BROADCAST_CHARS = 64 << 20
STRIP = r"[^\p{L}\p{N} \t\n\r]+"
BLANK = r"[ \t\n\r]+"


def normal_words(text: Column) -> Column:
    """Lower-cased words without punctuation."""
    plain = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), STRIP, "")
    return F.array_remove(F.split(plain, BLANK, -1), "")


def _explode_shingles(rows: DataFrame, k: int) -> DataFrame:
    """One row per shingle position: the columns of ``rows`` and ``at`` (from 0)."""
    return (rows.filter(F.size("words") >= k)
            .withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - k))))


def _at(i: int) -> Column:
    return F.get("words", F.col("at") + i)


def shingle_hash(k: int) -> Column:
    return F.xxhash64(*[_at(i) for i in range(k)])


def sketches(items: DataFrame, k: int, percent: int, item_col: str, text_col: str):
    """(shingles, sketch) of the items: distinct (item, n, hash, shingle), and those of them that
    belong to the item's sketch, with the item's size partition and its threshold."""
    words = items.select(F.col(item_col).alias("item"), normal_words(F.col(text_col)).alias("words"))
    shingles = (_explode_shingles(words, k)
                .select("item", shingle_hash(k).alias("hash"), F.concat_ws(" ", *[_at(i) for i in range(k)]).alias("shingle"))
                .distinct().withColumn("n", F.count("*").over(Window.partitionBy("item"))))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("hash", "shingle"))
    sketch = (shingles.withColumn("r", rank)
              .filter(F.col("r") <= F.floor(F.col("n") * (100 - percent) / 100) + 1)
              .withColumn("size_class", F.floor(F.log2("n")).cast("int")))
    limit = sketch.groupBy("size_class").agg(F.max("hash").alias("threshold"))
    return shingles, sketch.join(limit, "size_class").select("item", "n", "hash", "size_class", "threshold")


def hash_limit(classes, percent: int, n_shingles: Column) -> Column:
    """Largest hash at which a document of ``n_shingles`` can meet a sketch, from rows (least n,
    threshold) of the size classes; null where the document is too short for every item."""
    # the limit rises with the document: one step for each class whose threshold passes those before
    limit, top = F.lit(None).cast("long"), None
    for least, threshold in sorted(classes):
        if top is None or threshold > top:
            top = threshold
            limit = F.when(n_shingles >= -(-least * percent // 100), F.lit(top)).otherwise(limit)
    return limit


def shingles_in_reach(words: DataFrame, classes, k: int, percent: int) -> DataFrame:
    """The columns of ``words`` with ``hash`` for every shingle that can meet a sketch.

    Documents too short for every item explode to nothing; a filter on them would be moved below
    the words and make them twice."""
    n = F.size("words") - k + 1
    limit = hash_limit(classes, percent, n)
    near = words.withColumn("limit", F.when(n > 0, limit))
    at = F.explode_outer(F.when(F.col("limit").isNotNull(), F.sequence(F.lit(0), F.size("words") - k)))
    return (near.withColumn("at", at).withColumn("hash", shingle_hash(k))
            .filter(F.coalesce(F.col("at").isNotNull() & (F.col("hash") <= F.col("limit")), F.lit(False))).drop("limit"))


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80,
                    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                    item_text_col: str = "text") -> DataFrame:
    """(<id_col>, <item_col>, n_item, n_shared) of every pair in which the document holds at least
    ``percent`` of the item's distinct ``k``-word shingles.

    Words are lower-cased and without punctuation.  Items of fewer than ``k`` words have no
    shingles and are contained nowhere, nor is anything in shorter documents or null texts.
    Repeated document rows give repeated pairs; items that share an id are one item with the
    shingles of all; null ids are kept.  Other columns are ignored; empty tables give no rows."""
    shingles, sketch = sketches(items, k, percent, item_col, item_text_col)
    shingles, sketch = write_scratch(shingles, "item-shingles"), write_scratch(sketch, "item-sketches")
    # one row per size class, a few dozen at most
    by_class = sketch.groupBy("size_class").agg(F.count("*").alias("rows"), F.min("n").alias("least"), F.max("threshold").alias("top")).collect()
    size, classes = sum(r["rows"] for r in by_class), [(r["least"], r["top"]) for r in by_class]
    small = F.broadcast if size <= BROADCAST_ROWS else (lambda df: df)

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # Containment depends on the text alone; two hashes stand for it.
    keyed = src.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(1), "text"))
    words = keyed.select("k1", "k2", normal_words(F.col("text")).alias("words"))
    hits = shingles_in_reach(words, classes, k, percent)
    candidates = write_scratch(
        hits.select("k1", "k2", F.size("words").alias("doc_words"), "hash")
        .join(small(sketch.select("hash", "item", "n").distinct()), "hash")
        .filter(F.col("doc_words") - k + 1 >= F.col("n") * percent / 100)
        .select("k1", "k2", "item").distinct(), "contained-candidates")

    few = candidates.count() <= BROADCAST_ROWS
    held = shingles.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length("shingle")), F.lit(0)).alias("chars")).first()
    brief = F.broadcast if held["rows"] <= BROADCAST_ROWS and held["chars"] <= BROADCAST_CHARS else (lambda df: df)
    some = F.broadcast if few else (lambda df: df)
    texts = keyed.join(some(candidates.select("k1", "k2").distinct()), ["k1", "k2"], "left_semi")
    rows = (texts.dropDuplicates(["k1", "k2"]).select("k1", "k2", normal_words(F.col("text")).alias("words")))
    found = (_explode_shingles(rows, k)
             .select("k1", "k2", F.concat_ws(" ", *[_at(i) for i in range(k)]).alias("shingle"))
             .join(brief(shingles.select("item", "n", "shingle")), "shingle")
             .join(candidates.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("item").alias("ci")),
                   (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & F.col("item").eqNullSafe(F.col("ci")),
                   "left_semi")
             .distinct().groupBy("k1", "k2", "item", "n").agg(F.count("*").alias("shared"))
             .filter(F.col("shared") * 100 >= F.col("n") * percent))
    found = write_scratch(found, "contained")
    hits_few = F.broadcast if found.count() <= BROADCAST_ROWS else (lambda df: df)
    return (keyed.select("id", "k1", "k2").join(hits_few(found), ["k1", "k2"])
            .select(F.col("id").alias(id_col), F.col("item").alias(item_col),
                    F.col("n").alias("n_item"), F.col("shared").alias("n_shared")))


ORACLE = r"""
WITH w AS (
  SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
s AS (SELECT side, id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')),
  '[^\p{L}\p{N} \t\n\r]+', '', 'g'), '[ \t\n\r]+'), lambda x: x <> '') AS ws FROM w),
e AS (SELECT DISTINCT side, id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) AS shingle
  FROM s WHERE len(ws) >= 5),
n AS (SELECT id, count(*) AS n FROM e WHERE side = 1 GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, n.n::BIGINT AS n_item, count(*)::BIGINT AS n_shared
FROM e d JOIN e i ON d.side = 0 AND i.side = 1 AND d.shingle = i.shingle JOIN n ON n.id = i.id
GROUP BY d.id, i.id, n.n HAVING count(*) * 100 >= n.n * 80"""


@register("op10_benchmark_decontamination", ORACLE)
def op10_benchmark_decontamination(spark, sf_dir):
    """Every document and benchmark item that it contains."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
