"""Draws without repetition by a keyed permutation.

A key (seed, epoch, query, tag) names a bijection of the offsets ``0 .. n-1``; a query's j-th draw
is the image of j.  So k draws give k distinct ids, up to k = n, without remembering what was
drawn, sorting the corpus or drawing spare ids.

The bijection is a Feistel network over pairs (l, r) with l in ``[0, a)``, r in ``[0, b)`` and
``a * b >= n``: rounds add a hash of one half to the other in turn.  An image outside ``[0, n)``
goes through the network again (cycle walking).  A walk visits every point outside once at most,
so ``a * b - n`` further passes always suffice; a and b are chosen to make that number small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelrank.functions.hashing import hash60
from labelrank.operators.lookup import found_or_fail

#: Rounds of the network, and those below SMALL offsets: halves of two or three values mix slowly
#: (measured on pairs of draws: uneven at 6 rounds below about 30 offsets, even from 18 rounds on).
ROUNDS, SMALL_ROUNDS, SMALL = 6, 18, 1000
#: Values of ``a`` that are tried, from the square root of n on.
TRIES = 65_536
#: Draws of one query that are listed at once; a long list is made block by block.
DRAW_BLOCK = 4096


def halves(n: int) -> tuple[int, int]:
    """(a, b) with ``a * b >= n`` as small as the tries allow, both near the square root of n."""
    root = math.isqrt(max(n, 1) - 1) + 1
    last = min(2 * root, root + TRIES - 1, max(root, n // 2))
    return min(((a, -(-n // a)) for a in range(root, last + 1)), key=lambda ab: (ab[0] * ab[1], ab[0]))


def rounds(n: int) -> int:
    return SMALL_ROUNDS if n < SMALL else ROUNDS


def permuted(j: Column, n: int, *key) -> Column:
    """Image of ``j`` (0 <= j < n) under the bijection of ``[0, n)`` that ``key`` names."""
    (a, b), passes = halves(n), rounds(n)
    j = j.cast("bigint")

    def state(left, right, done):
        return F.struct(left.alias("l"), right.alias("r"), done.alias("done"))

    def step(s, i):
        arrived = s["done"] | ((i > 0) & (i % passes == 0) & (s["l"] + s["r"] * a < n))
        half = i % passes
        left = F.pmod(s["l"] + hash60(*key, half, s["r"]), F.lit(a).cast("bigint"))
        right = F.pmod(s["r"] + hash60(*key, half, s["l"]), F.lit(b).cast("bigint"))
        return (F.when(arrived, state(s["l"], s["r"], F.lit(True)))
                .when(half % 2 == 0, state(left, s["r"], F.lit(False)))
                .otherwise(state(s["l"], right, F.lit(False))))

    start = state(F.pmod(j, F.lit(a).cast("bigint")), F.call_function("div", j, F.lit(a).cast("bigint")), F.lit(False))
    steps = F.sequence(F.lit(0), F.lit(passes * (1 + a * b - n) - 1))
    return F.aggregate(steps, start, step, lambda s: s["l"] + s["r"] * a)


def keyed_draws(qk: DataFrame, n: int, qid: str = "qid", k: str = "k", seed: int = 42, epoch: int = 0,
                tag: str = "rand") -> DataFrame:
    """(qid, j, offset): k distinct offsets below ``n`` for every row of ``qk`` (qid, k).

    Rows with k null, 0 or less give nothing; k above n fails the job; a repeated row of ``qk``
    repeats its draws.  A null qid draws as the key of the other parts."""
    asked = qk.select(qid, F.col(k).cast("bigint").alias("__k")).filter("__k > 0")
    asked = asked.withColumn("__k", F.when(F.col("__k") > n, F.raise_error(
        F.lit(f"sample larger than population ({n})"))).otherwise(F.col("__k")))
    if n == 0:
        return asked.select(qid, F.col("__k").alias("j"), F.col("__k").alias("offset"))
    blocks = asked.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.call_function(
        "div", F.col("__k") - 1, F.lit(DRAW_BLOCK).cast("bigint")))))
    first = F.col("__b") * DRAW_BLOCK
    draws = blocks.select(qid, F.explode(F.sequence(first, F.least(first + DRAW_BLOCK, F.col("__k")) - 1)).alias("j"))
    return draws.withColumn("offset", permuted(F.col("j"), n, seed, epoch, F.col(qid), tag))


def keyed_negatives(qk: DataFrame, corpus: DataFrame, qid: str = "qid", k: str = "k", seed: int = 42, epoch: int = 0,
                    tag: str = "rand", n_corpus: int | None = None) -> DataFrame:
    """(qid, j, docid): ``k`` distinct corpus ids per query, j the draw order.

    ``corpus``: (docid, offset), offsets dense from 0; an offset without a row fails the job.  One
    join of k rows a query with the corpus, whatever the ratio of k to the corpus."""
    n = corpus.count() if n_corpus is None else n_corpus
    draws = keyed_draws(qk, n, qid, k, seed, epoch, tag)
    ids = corpus.select("offset", "docid", F.lit(True).alias("__found"))
    return found_or_fail(draws.join(ids, "offset", "left"), "offset", "corpus offset").select(qid, "j", "docid")


def permuted_order(rows: DataFrame, n: int, offset: str = "offset", out: str = "position", seed: int = 42,
                   epoch: int = 0, tag: str = "order") -> DataFrame:
    """``rows`` with ``out``, each offset's place in a seeded order of ``0 .. n-1``: a shuffled order
    of the corpus for an epoch, without a sort or an exchange.  A null offset has a null place."""
    place = permuted(F.col(offset), n, seed, epoch, tag) if n else F.lit(None).cast("bigint")
    return rows.withColumn(out, F.when(F.col(offset).isNotNull(), place))
