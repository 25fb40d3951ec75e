"""Corpus vocabulary of the built-in tokenizer: ids by rank of frequency, and encoding with them.

Tokens are the lower-cased non-empty pieces between spaces.  The vocabulary grows with the corpus, so
neither side of the encoding join is assumed to be small: the commonest tokens, which hold most
occurrences and would make hot keys, are replicated up to a fixed number, the rest is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelrank.models import N_SPECIAL
from labelrank.operators.ranking import global_index
from labelrank.session import write_once

#: Tokens that are replicated to every task.  A token beyond them has at most one in so many occurrences.
COMMON = 100_000


def space_tokens(text: Column) -> Column:
    """Lower-cased non-empty pieces between spaces; null text has none."""
    return F.coalesce(F.array_remove(F.split(F.lower(text), " ", -1), ""), F.array().cast("array<string>"))


def build_vocabulary(df: DataFrame, text: str = "text", first_id: int = N_SPECIAL) -> DataFrame:
    """``(token, n, token_id)``: occurrences of every token, and its rank by count (descending), then
    by token in byte order, counted from ``first_id``.  No window and no task sees all tokens."""
    counts = (df.select(F.explode(space_tokens(F.col(text))).alias("token")).groupBy("token")
              .agg(F.count("*").alias("n")).withColumn("__less", -F.col("n")))
    ranked = global_index(counts, ["__less", "token"], "__rank")
    return ranked.select("token", "n", (F.col("__rank") + first_id).alias("token_id"))


def encode_with_vocabulary(df: DataFrame, id_col: str, vocabulary: DataFrame, text: str = "text",
                           max_length: int | None = None, unknown_id: int | None = None,
                           common: int = COMMON) -> DataFrame:
    """``(<id_col>, input_ids array<bigint>)``, one row per input row, in order of the text.

    Tokens that the vocabulary lacks become ``unknown_id``, or are left out where that is None; the cut
    to ``max_length`` tokens comes first.  Null and empty texts give empty lists; rows may repeat an id
    or have none.  The ids of one text meet in one row; nothing larger is gathered."""
    tokens = space_tokens(F.col(text))
    if max_length is not None:
        tokens = F.slice(tokens, 1, max_length)
    rows = write_once(df.select(F.col(id_col), tokens.alias("__tokens"), F.monotonically_increasing_id().alias("__row")), "tokens")
    pieces = rows.select("__row", F.posexplode("__tokens").alias("__pos", "token"))
    ids = vocabulary.select("token", "token_id")
    first = ids.agg(F.min("token_id")).first()[0] or 0
    head, tail = ids.filter(F.col("token_id") < first + common), ids.filter(F.col("token_id") >= first + common)
    tried = pieces.join(F.broadcast(head), "token", "left")
    rest = tried.filter("token_id is null").drop("token_id").join(tail, "token", "left")
    found = tried.filter("token_id is not null").unionByName(rest)
    if unknown_id is None:
        found = found.filter("token_id is not null")
    else:
        found = found.withColumn("token_id", F.coalesce("token_id", F.lit(unknown_id).cast("bigint")))
    lists = found.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("__pos", "token_id"))).alias("__ids"))
    return rows.drop("__tokens").join(lists, "__row", "left").select(
        F.col(id_col), F.coalesce(F.col("__ids.token_id"), F.array().cast("array<bigint>")).alias("input_ids"))
