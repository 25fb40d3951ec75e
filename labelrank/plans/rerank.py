"""Listwise re-ranking of long runs by windows that move from the tail to the head.

A generator can order only a few hits at a time.  The first window holds the last hits; every round
orders one window of every query, one generation for all, and the next window starts ``step`` hits
further up, so good hits climb over the overlap.  A round reads and writes the hits of its window
only: what falls behind the window is final.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelrank.functions import prompts as P
from labelrank.functions.replies import apply_permutation
from labelrank.plans.jobs import batch_generate
from labelrank.session import scratch_path, write_once


def window_starts(depth: int, window: int, step: int) -> list[int]:
    """First slots of the windows, tail first; the last one starts at 0."""
    if not 0 < step <= window:
        raise ValueError("the step is between 1 and the window")
    starts = list(range(max(0, depth - window), 0, -step)) + [0]
    return starts if depth > 0 else []


def rerank_windows(hits: DataFrame, queries: DataFrame, factory: Callable, depth: int = 100, window: int = 20,
                   step: int = 10, messages: Callable[[Column, Column], Column] | None = None,
                   moved: tuple[str, ...] = ("pid", "passage"), ledger: str | None = None) -> DataFrame:
    """``hits`` (qid, slot from 0, ``moved`` columns, others) re-ranked among the first ``depth`` slots.

    ``moved`` columns go to their new slot, the others (rank, score) stay with the slot; hits at or
    beyond ``depth`` stay.  The generator sees columns prompt, query and passages; ``messages`` builds
    the prompt from query and passages (default: the ranking prompt with an empty answer).  A reply that
    names no hit leaves a window as it is.  Queries may have fewer hits than ``depth``, or none in a
    window, and are then not asked; a query without text is asked with an empty one.  A (qid, slot) is
    one row.  With ``ledger`` a restart sends only windows that have no reply yet."""
    messages = messages or (lambda query, passages: P.utility_ranking_messages(query, passages, F.lit("")))
    texts = write_once(queries.groupBy("qid").agg(F.max("query").alias("query")), "rerank-queries")
    hits = write_once(hits, "rerank-hits")  # every round reads some of them
    carried, final, above = None, [hits.filter(F.col("slot") >= depth)], depth
    for start in window_starts(depth, window, step):
        end = min(start + window, depth)
        fresh = hits.filter((F.col("slot") >= start) & (F.col("slot") < above))
        now = fresh if carried is None else carried.unionByName(fresh)
        above = start
        passage = moved[-1]
        lists = (now.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("slot", passage))).alias("h"))
                 .join(texts, "qid", "left").select("qid", F.coalesce("query", F.lit("")).alias("query"),
                                                    F.transform("h", lambda x: x[passage]).alias("passages")))
        asked = lists.select("qid", "query", "passages", P.render_chat(messages(F.col("query"), F.col("passages"))).alias("prompt"))
        # replies are written before they are used, so no generation runs twice
        replies = batch_generate(asked, factory, "reply", ["qid"], ["query", "passages"],
                                 None if ledger else scratch_path(hits.sparkSession, "window-replies"), ledger)
        now = write_once(apply_permutation(now, replies, start, end, moved=moved), "window")
        if start == 0:
            final.append(now)
            break
        rest = max(start - step, 0) + window  # the next window ends here
        final.append(now.filter(F.col("slot") >= rest))
        carried = now.filter(F.col("slot") < rest)
    return reduce(DataFrame.unionByName, final)
