"""Sampling and fixed-size training groups.

Everything is long form ``(qid, part, pos, docid)`` rows, never unbounded
arrays.  Every random choice is a pure function of ``md5(seed|epoch|qid|tag|...)``
(see ``labelrank.functions.hashing``), so results do not depend on partitioning
and survive recomputation after an executor loss.  Per-query windows are
``row_number() <= literal`` top-k filters (partial ``WindowGroupLimit`` before
the shuffle), so a hot query ships at most G rows per map task.

``fill(pool, need)`` follows the reference: when the pool is shorter than
``need``, ``need - |pool|`` distinct random corpus ids come first, then the
whole pool in order; otherwise ``need`` pool entries are drawn without
replacement, in draw order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelrank.functions.hashing import hash60, hash_order
from labelrank.session import write_once


def _n_draws(n: int, k: F.Column, margin: int) -> F.Column:
    """Draws per query: ``2k + margin`` when the corpus is at least 4k, else a
    coupon-collector bound ``N (ln N + 20)`` (all of a small corpus is then
    reached with probability ~1 - 2e-9)."""
    small = F.ceil(F.lit(float(n)) * (F.log(F.lit(float(max(n, 1)))) + F.lit(20.0))).cast("bigint")
    return F.when(F.lit(n) >= k * 4, k * 2 + F.lit(margin)).otherwise(small)


def _draws(qk: DataFrame, corpus: DataFrame, n: int, qid: str, k: str, seed: int, epoch: int,
           tag: str, margin: int) -> DataFrame:
    """First k distinct corpus ids of each query's hashed draw sequence.
    Columns: qid, j (rank 0..k-1), docid."""
    draws = qk.select(qid, k, F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                   _n_draws(n, F.col(k), margin) - 1)).alias("__j"))
    draws = draws.withColumn("offset", F.pmod(hash60(F.lit(seed), F.lit(epoch), F.col(qid), F.lit(tag), F.col("__j")),
                                              F.lit(n)))
    got = draws.join(corpus.select("offset", "docid"), "offset")
    first = got.groupBy(qid, k, "docid").agg(F.min("__j").alias("__j"))
    w = Window.partitionBy(qid).orderBy("__j")
    return (first.withColumn("j", F.row_number().over(w) - 1).filter(F.col("j") < F.col(k))
            .select(qid, k, F.col("j").cast("bigint").alias("j"), "docid"))


def random_negatives(qk: DataFrame, corpus: DataFrame, qid: str = "qid", k: str = "k", seed: int = 42,
                     epoch: int = 0, tag: str = "rand", margin: int = 32, n_corpus: int | None = None) -> DataFrame:
    """``k`` distinct random corpus ids per query (``random.sample(corpus, k)``).

    ``qk``: (qid, k).  ``corpus``: (docid, offset) with dense offsets 0..N-1.
    The result is "the first k distinct ids of the query's hashed draw
    sequence", from a number of draws chosen so that a shortfall is
    negligible; a query that still comes out short fails the job instead of
    returning fewer ids.  One lazy plan, no driver round trip.
    """
    n = corpus.count() if n_corpus is None else n_corpus
    # k > N cannot be met (random.sample raises): fail inside the job
    qk = qk.filter(F.col(k) > 0).withColumn(k, F.when(F.col(k) > n, F.raise_error(
        F.lit(f"sample larger than population ({n})"))).otherwise(F.col(k)))
    got = _draws(qk, corpus, n, qid, k, seed, epoch, tag, margin)
    # at most k rows per query here, and at least one: every draw is a corpus row
    short = F.count(F.lit(1)).over(Window.partitionBy(qid)) < F.col(k)
    return got.select(qid, "j", F.when(short, F.raise_error(F.concat(
        F.lit("random_negatives: draws exhausted for query "), F.col(qid).cast("string"))))
        .otherwise(F.col("docid")).alias("docid"))


def sample_without_replacement(pool: DataFrame, need: DataFrame, bound: int, qid: str = "qid",
                               seed: int = 42, epoch: int = 0, tag: str = "sample") -> DataFrame:
    """``random.sample(pool, k)`` per query: positions ordered by
    ``md5(seed|epoch|qid|tag|part|pos|docid)``, first ``need`` kept (duplicates in
    the pool may both come out).  ``need``: (qid, k) with k <= ``bound``.
    Returns (qid, j, docid) with j the draw order."""
    key = hash_order(F.lit(seed), F.lit(epoch), F.col(qid), F.lit(tag), F.col("part"), F.col("pos"), F.col("docid"))
    w = Window.partitionBy(qid).orderBy(key)
    ranked = pool.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= bound)
    return (ranked.join(need, qid).filter(F.col("__r") <= F.col("k"))
            .select(qid, (F.col("__r") - 1).cast("bigint").alias("j"), "docid"))


def sample_with_replacement(pool: DataFrame, k: int, qid: str = "qid", seed: int = 42, epoch: int = 0,
                            tag: str = "choices") -> DataFrame:
    """``random.choices(pool, k)``: slot s takes pool entry ``hash(seed|epoch|qid|tag|s) mod n``.
    ``pool``: (qid, pos dense 0-based, docid)."""
    sizes = pool.groupBy(qid).agg(F.count(F.lit(1)).alias("__n"))
    slots = sizes.select(qid, "__n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j"))
    slots = slots.withColumn("pos", F.pmod(hash60(F.lit(seed), F.lit(epoch), F.col(qid), F.lit(tag), F.col("j")),
                                           F.col("__n")))
    return slots.join(pool.select(qid, "pos", "docid"), [qid, "pos"]).select(
        qid, F.col("j").cast("bigint").alias("j"), "docid")


def fill(pool: DataFrame, need: DataFrame, corpus: DataFrame, bound: int, qid: str = "qid", seed: int = 42,
         epoch: int = 0, tag: str = "fill", n_corpus: int | None = None) -> DataFrame:
    """Reference ``fill``: returns (qid, j, docid), j = 0..need-1.

    ``pool``: (qid, part, pos, docid) — pool order is (part, pos).
    ``need``: (qid, k) with k <= ``bound``; queries with k = 0 yield nothing.

    The pool is used three times (sizes, samples, tails), so it is written once under the
    shared scratch folder instead of being planned three times.
    """
    pool = write_once(pool, "pool")
    sizes = pool.groupBy(qid).agg(F.count(F.lit(1)).alias("__n"))
    nk = write_once(need.join(sizes, qid, "left").fillna(0, subset=["__n"]), "need")
    full = nk.filter(F.col("__n") >= F.col("k")).select(qid, "k")
    short = nk.filter((F.col("__n") < F.col("k")) & (F.col("k") > 0))
    sampled = sample_without_replacement(pool.join(full.select(qid), qid, "left_semi"), full, bound, qid,
                                         seed, epoch, tag + ":pool")
    # short pools: random corpus ids first, then the pool in order
    rand = random_negatives(short.select(qid, (F.col("k") - F.col("__n")).alias("k")), corpus, qid, "k",
                            seed, epoch, tag + ":corpus", n_corpus=n_corpus)
    w = Window.partitionBy(qid).orderBy("part", "pos")
    tail = (pool.join(short.select(qid, "k", "__n"), qid)
            .withColumn("__r", F.row_number().over(w) - 1)
            .select(qid, (F.col("k") - F.col("__n") + F.col("__r")).cast("bigint").alias("j"), "docid"))
    return sampled.unionByName(rand).unionByName(tail)


def rotated_positive(positives: DataFrame, qidx: DataFrame, qid: str = "qid", seed: int = 42,
                     epoch: int = 0) -> DataFrame:
    """Positive at ``(idx + seed + epoch) mod n``.  ``positives``: (qid, pos, docid);
    ``qidx``: (qid, idx).  Returns (qid, pos, docid)."""
    n = positives.groupBy(qid).agg(F.count(F.lit(1)).alias("__n"))
    pick = qidx.join(n, qid).select(qid, F.pmod(F.col("idx") + seed + epoch, F.col("__n")).alias("pos"))
    return positives.join(pick, [qid, "pos"]).select(qid, "pos", "docid")


def _part(df: DataFrame, part: int, qid: str = "qid") -> DataFrame:
    return df.select(qid, F.lit(part).alias("part"), F.col("pos").cast("bigint").alias("pos"), "docid")


def _slots(df: DataFrame, base, qid: str = "qid") -> DataFrame:
    """(qid, j, docid) -> (qid, slot, docid) with slot = base + j (base: int or column)."""
    b = F.lit(base) if isinstance(base, int) else base
    return df.select(qid, (b + F.col("j")).cast("bigint").alias("slot"), "docid")


def group_rotate(qidx, positives, hard, negatives, corpus, group_size=8, neg_depth=200, seed=42, epoch=0,
                 qid="qid", n_corpus=None):
    """Slot 0: rotated positive; slots 1..G-1: fill(hard ++ negatives[:depth], G-1)."""
    first = rotated_positive(positives, qidx, qid, seed, epoch).select(qid, F.lit(0).cast("bigint").alias("slot"), "docid")
    pool = _part(hard, 1, qid).unionByName(_part(negatives.filter(F.col("pos") < neg_depth), 2, qid)) \
        .join(qidx.select(qid), qid, "left_semi")
    need = qidx.select(qid, F.lit(group_size - 1).alias("k"))
    rest = _slots(fill(pool, need, corpus, group_size, qid, seed, epoch, "rotate", n_corpus), 1, qid)
    return first.unionByName(rest)


def group_pooled(qidx, positives, hard, negatives, corpus, group_size=8, neg_depth=200, seed=42, epoch=0,
                 qid="qid", n_corpus=None):
    """No fixed slot: fill(positives ++ hard ++ negatives[:depth], G); may hold no positive."""
    pool = (_part(positives, 0, qid).unionByName(_part(hard, 1, qid))
            .unionByName(_part(negatives.filter(F.col("pos") < neg_depth), 2, qid))
            .join(qidx.select(qid), qid, "left_semi"))
    need = qidx.select(qid, F.lit(group_size).alias("k"))
    return _slots(fill(pool, need, corpus, group_size, qid, seed, epoch, "pooled", n_corpus), 0, qid)


def group_rotate_pooled(qidx, positives, hard, negatives, corpus, group_size=8, neg_depth=200, seed=42,
                        epoch=0, qid="qid", n_corpus=None):
    """Slot 0: rotated positive p; rest: fill((positives != p) ++ hard ++ negatives[:depth], G-1)."""
    p = rotated_positive(positives, qidx, qid, seed, epoch)
    first = p.select(qid, F.lit(0).cast("bigint").alias("slot"), "docid")
    others = positives.join(p.select(qid, F.col("docid").alias("__p")), qid) \
        .filter(F.col("docid") != F.col("__p")).drop("__p")
    pool = (_part(others, 0, qid).unionByName(_part(hard, 1, qid))
            .unionByName(_part(negatives.filter(F.col("pos") < neg_depth), 2, qid))
            .join(qidx.select(qid), qid, "left_semi"))
    need = qidx.select(qid, F.lit(group_size - 1).alias("k"))
    rest = _slots(fill(pool, need, corpus, group_size, qid, seed, epoch, "rotpool", n_corpus), 1, qid)
    return first.unionByName(rest)


def group_all_positives(qidx, positives, hard, negatives, corpus, group_size=8, neg_depth=200, seed=42,
                        epoch=0, qid="qid", n_corpus=None):
    """All positives first (G of them sampled when there are >= G), then
    fill(hard ++ negatives[:depth], G - #positives)."""
    npos = positives.groupBy(qid).agg(F.count(F.lit(1)).alias("__n"))
    qn = qidx.select(qid).join(npos, qid, "left").fillna(0, subset=["__n"])
    many = qn.filter(F.col("__n") >= group_size)
    few = qn.filter(F.col("__n") < group_size)
    pos_many = sample_without_replacement(_part(positives, 0, qid).join(many.select(qid), qid, "left_semi"),
                                          many.select(qid, F.lit(group_size).alias("k")), group_size, qid,
                                          seed, epoch, "allpos")
    w = Window.partitionBy(qid).orderBy("pos")
    pos_few = positives.join(few.select(qid), qid, "left_semi") \
        .select(qid, (F.row_number().over(w) - 1).cast("bigint").alias("j"), "docid")
    head = _slots(pos_many.unionByName(pos_few), 0, qid)
    pool = (_part(hard, 1, qid).unionByName(_part(negatives.filter(F.col("pos") < neg_depth), 2, qid))
            .join(few.select(qid), qid, "left_semi"))
    need = few.select(qid, (F.lit(group_size) - F.col("__n")).alias("k"))
    rest = fill(pool, need, corpus, group_size, qid, seed, epoch, "allpos", n_corpus) \
        .join(few.select(qid, "__n"), qid)
    return head.unionByName(rest.select(qid, (F.col("__n") + F.col("j")).cast("bigint").alias("slot"), "docid"))


def group_first_positive(qidx, positives, hard, negatives, corpus, group_size=8, neg_depth=200, seed=42,
                         epoch=0, qid="qid", n_corpus=None):
    """Slot 0: first positive; then hard negatives (G-1 sampled only when there
    are >= G-1, else all in order); then fill(negatives[:depth], rest)."""
    first = positives.filter(F.col("pos") == 0).join(qidx.select(qid), qid, "left_semi") \
        .select(qid, F.lit(0).cast("bigint").alias("slot"), "docid")
    m = group_size - 1
    nh = hard.groupBy(qid).agg(F.count(F.lit(1)).alias("__h"))
    qh = qidx.select(qid).join(nh, qid, "left").fillna(0, subset=["__h"])
    many = qh.filter(F.col("__h") >= m)
    few = qh.filter(F.col("__h") < m)
    h_many = sample_without_replacement(_part(hard, 1, qid).join(many.select(qid), qid, "left_semi"),
                                        many.select(qid, F.lit(m).alias("k")), group_size, qid, seed, epoch, "hard")
    w = Window.partitionBy(qid).orderBy("pos")
    h_few = hard.join(few.select(qid), qid, "left_semi") \
        .select(qid, (F.row_number().over(w) - 1).cast("bigint").alias("j"), "docid")
    mid = _slots(h_many.unionByName(h_few), 1, qid)
    pool = _part(negatives.filter(F.col("pos") < neg_depth), 2, qid).join(few.select(qid), qid, "left_semi")
    need = few.select(qid, (F.lit(m) - F.col("__h")).alias("k"))
    rest = fill(pool, need, corpus, group_size, qid, seed, epoch, "first", n_corpus).join(few.select(qid, "__h"), qid)
    return first.unionByName(mid).unionByName(
        rest.select(qid, (F.lit(1) + F.col("__h") + F.col("j")).cast("bigint").alias("slot"), "docid"))


def group_from_records(positives, negatives, group_size=8, seed=42, epoch=0, qid="qid"):
    """Record-based groups: first positive, then G-1 negatives of the record,
    with replacement when the record has fewer than G-1 (``random.choices``)."""
    m = group_size - 1
    first = positives.filter(F.col("pos") == 0).select(qid, F.lit(0).cast("bigint").alias("slot"), "docid")
    nn = negatives.groupBy(qid).agg(F.count(F.lit(1)).alias("__n"))
    many = nn.filter(F.col("__n") >= m)
    few = nn.filter(F.col("__n") < m)
    a = sample_without_replacement(_part(negatives, 1, qid).join(many.select(qid), qid, "left_semi"),
                                   many.select(qid, F.lit(m).alias("k")), group_size, qid, seed, epoch, "records")
    b = sample_with_replacement(negatives.join(few.select(qid), qid, "left_semi"), m, qid, seed, epoch, "records")
    return first.unionByName(_slots(a.unionByName(b), 1, qid)).join(positives.select(qid).distinct(), qid, "left_semi")
