"""Parsing model replies into labels, rankings and permutations.

Digits are ASCII only; numbers too long for an int become null and are dropped
(``try_cast``), which matches the reference (a huge index is out of range).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelrank.functions.hashing import hash_order

BRACKET_NUMBER = r"\[([0-9]+)\]"
ANY_NUMBER = r"[0-9]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bracket_indices(reply) -> Column:
    """Every ``[n]`` in the reply as ``n - 1`` (0-based), in order, duplicates kept."""
    nums = F.transform(F.regexp_extract_all(_c(reply), F.lit(BRACKET_NUMBER), 1), lambda x: x.try_cast("bigint") - 1)
    # numbers too long for bigint are out of range anyway; drop them (a null would
    # turn array_contains into null)
    return F.filter(nums, lambda x: x.isNotNull())


def _reply(reply, strip: bool) -> Column:
    if not strip:
        return _c(reply)
    from labelrank.functions.text import strip_reasoning
    return strip_reasoning(reply)


def parse_selection(reply, ids, zero: str = "ignore", strip: bool = False) -> Column:
    """0/1 vector as long as ``ids``: position i is 1 when ``[i+1]`` occurs in the reply.

    Out-of-range numbers are ignored.  ``[0]`` is ignored by default;
    ``zero='wrap'`` marks the last passage, as Python's ``list[-1]`` does.
    The raw reply is parsed, reasoning included (parity); ``strip=True`` parses
    only the text after the reasoning block.
    """
    nums = bracket_indices(_reply(reply, strip))
    n = F.size(_c(ids))

    def score(_, i):
        hit = F.array_contains(nums, i.cast("bigint"))
        if zero == "wrap":
            hit = hit | ((i == n - 1) & F.array_contains(nums, F.lit(-1).cast("bigint")))
        return hit.cast("int")
    return F.transform(_c(ids), score)


def parse_ranking(reply, ids, strip: bool = False) -> tuple[Column, Column]:
    """``[n]`` markers -> 0-based, first occurrence kept, in range; returns
    ``(ranking_score, ranked_passage_ids)``.  ``strip=True`` skips the reasoning block."""
    n = F.size(_c(ids))
    order = F.filter(F.array_distinct(bracket_indices(_reply(reply, strip))), lambda x: (x >= 0) & (x < n))
    return order, F.transform(order, lambda i: F.get(_c(ids), i.cast("int")))


def permutation(reply, m) -> Column:
    """Window permutation from a free-text reply: all digit runs -> 0-based, first
    occurrence kept, in range ``[0, m)``, then the missing positions in order."""
    m = _c(m)
    resp = F.filter(F.array_distinct(F.transform(F.regexp_extract_all(_c(reply), F.lit(ANY_NUMBER), 0),
                                                 lambda x: x.try_cast("bigint") - 1)),
                    lambda x: (x >= 0) & (x < m))
    every = F.when(m > 0, F.sequence(F.lit(0).cast("bigint"), (m - 1).cast("bigint"))) \
             .otherwise(F.array().cast("array<bigint>"))
    return F.concat(resp, F.filter(every, lambda x: ~F.array_contains(resp, x)))


def apply_permutation(hits: DataFrame, replies: DataFrame, cut_start: int = 0, cut_end: int = 100,
                      qid: str = "qid", slot: str = "slot", reply: str = "reply",
                      moved: tuple[str, ...] = ("pid",)) -> DataFrame:
    """Reorder hits ``[cut_start, cut_end)`` of every query by its reply.

    ``hits``: one row per (qid, 0-based slot).  The moved columns (id, content)
    go to their new slot; every other column (rank, score) stays with the slot,
    as in the reference.  Queries without a reply are unchanged.
    """
    in_cut = (F.col(slot) >= cut_start) & (F.col(slot) < cut_end)
    sizes = hits.filter(in_cut).groupBy(qid).agg(F.count(F.lit(1)).alias("__m"))
    perms = (replies.select(qid, reply).join(sizes, qid)
             .select(qid, F.posexplode(permutation(F.col(reply), F.col("__m"))).alias("__j", "__x")))
    src = hits.select(F.col(qid), (F.col(slot) - cut_start).alias("__x"), *moved)
    new_items = perms.join(src, [qid, "__x"]).select(qid, (F.col("__j") + cut_start).alias(slot), *moved)
    keep = [c for c in hits.columns if c not in moved]
    moved_rows = hits.filter(in_cut).select(*keep).join(new_items, [qid, slot])
    unmatched = hits.filter(in_cut).join(new_items.select(qid).distinct(), qid, "left_anti")
    outside = hits.filter(~in_cut)
    return outside.unionByName(unmatched).unionByName(moved_rows.select(*hits.columns))


def permute_records(items: DataFrame, seed: int = 0, key: str = "query_id", side: str = "side",
                    pos: str = "pos", item: str = "docid", out: str = "new_pos") -> DataFrame:
    """Seeded shuffle inside each (record, side): the new position is the rank of
    ``md5(seed|key|side|pos|item)`` (a window over one record's list)."""
    from pyspark.sql import Window
    w = Window.partitionBy(key, side).orderBy(hash_order(F.lit(seed), F.col(key), F.col(side), F.col(pos), F.col(item)))
    return items.withColumn(out, (F.row_number().over(w) - 1).cast("bigint"))
