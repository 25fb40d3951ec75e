"""Lookups as joins.  The reference builds in-memory dicts; here each
lookup is an equi-join that Catalyst plans as broadcast (small side, AQE) or
shuffle join, so neither side has to fit on one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """One row per key: the value of the last line (largest ``order``); without an order,
    the largest value."""
    pick = F.max_by(F.col(value), F.col(order)) if order else F.max(value)
    return df.groupBy(key).agg(pick.alias(value))


def found_or_fail(joined: DataFrame, key: str, what: str) -> DataFrame:
    """Fails the job for rows of a left join whose ``__found`` is null; drops the column."""
    return joined.withColumn("__found", F.when(F.col("__found").isNull(), F.raise_error(
        F.concat(F.lit(f"missing {what} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
        .otherwise(F.col("__found"))).filter("__found").drop("__found")


def attach_query(df: DataFrame, queries: DataFrame, key: str = "query_id", value: str = "query",
                 order: str | None = None, strict: bool = False) -> DataFrame:
    """Query text by id (last duplicate wins when ``order`` is given).  With
    ``strict`` a missing id raises (the reference's KeyError)."""
    q = last_wins(queries, key, value, order)
    if not strict:
        return df.join(q, key)
    return found_or_fail(df.join(q.withColumn("__found", F.lit(True)), key, "left"), key, "query id")


def attach_passages(df: DataFrame, passages: DataFrame, ids: str = "ids", key: str = "docid",
                    value: str = "passage", out: str = "passages", row_key: str = "query_id",
                    order: str | None = None) -> DataFrame:
    """Ordered id list -> list of passage values in the same order.

    posexplode the ids, join the passages by id (one row per id: the last duplicate
    by ``order``, else the largest value), and collect back per row (lists are bounded
    by the row's id list).  Rows with an empty list keep an empty list; an id that the
    passages lack fails the job.
    """
    p = last_wins(passages, key, value, order)
    ex = df.select(row_key, F.posexplode(ids).alias("__i", key))
    got = (found_or_fail(ex.join(p.withColumn("__found", F.lit(True)), key, "left"), key, "passage id").groupBy(row_key)
           .agg(F.array_sort(F.collect_list(F.struct("__i", F.col(value).alias("__v")))).alias("__s")))
    got = got.select(row_key, F.transform("__s", lambda s: s["__v"]).alias(out))
    vtype = p.schema[value].dataType.simpleString()
    return df.join(got, row_key, "left").withColumn(
        out, F.coalesce(F.col(out), F.array().cast(f"array<{vtype}>")))


def _one_each(df: DataFrame, key: str, order: str | None) -> DataFrame:
    """One row per key: the last by ``order``, else by the largest values."""
    rest = [c for c in df.columns if c != key]
    pick = F.struct(*rest)
    one = F.max_by(pick, F.col(order)) if order else F.max(pick)
    return df.groupBy(key).agg(one.alias("__v")).select(key, *[F.col(f"__v.{c}").alias(c) for c in rest])


def attach_answer(df: DataFrame, answers: DataFrame, key: str = "query_id", order: str | None = None) -> DataFrame:
    """Answer by query id: one per id; a query without an answer fails the job."""
    a = _one_each(answers, key, order).withColumn("__found", F.lit(True))
    return found_or_fail(df.join(a, key, "left"), key, "answer of query")


def attach_tokens(df: DataFrame, tokens: DataFrame, key: str = "docid", order: str | None = None) -> DataFrame:
    """Id -> token ids: one list per id; an id without tokens fails the job."""
    t = _one_each(tokens, key, order).withColumn("__found", F.lit(True))
    return found_or_fail(df.join(t, key, "left"), key, "tokens of passage")


def attach_teacher_scores(groups: DataFrame, scores: DataFrame | None, qid: str = "qid",
                          did: str = "docid", score: str = "score", order: str | None = None) -> DataFrame:
    """Teacher score of every (query, passage); 0.0 when absent.  A pair that is scored several times
    has its last score by ``order``, else the largest.  Without a score table there is no score
    column at all."""
    if scores is None:
        return groups
    value = F.col(score).cast("double")
    s = scores.groupBy(qid, did).agg((F.max_by(value, F.col(order)) if order else F.max(value)).alias(score))
    return groups.join(s, [qid, did], "left").withColumn(score, F.coalesce(F.col(score), F.lit(0.0)))


def offset_to_id(results: DataFrame, id_map: DataFrame, offset: str = "offset", id_col: str = "id") -> DataFrame:
    """Search results by row offset -> ids (equi-join on the offset).  An offset without an id fails
    the job; of several ids of one offset the largest counts."""
    ids = last_wins(id_map, offset, id_col).withColumn("__found", F.lit(True))
    return found_or_fail(results.join(ids, offset, "left"), offset, "id of offset").drop(offset)
