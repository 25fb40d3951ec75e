"""Mixing sources to target weights: a min-cost flow between membership patterns and sources.

Documents that belong to the same set of sources are one pattern; only its total size enters the
flow.  A pattern may send its size once per repetition, every further repetition at a higher cost
(1, 2, 3, ...: convex), to the sources that it belongs to, and a source takes its target.  The flow
is small (patterns and sources, not documents) and runs on the driver; documents are then chosen in
Spark, per pattern in seeded order until its flow is used up.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from labelrank.llm.components import write_scratch
from labelrank.llm.registry import register
from labelrank.session import table

#: Membership patterns at most: they are collected, and broadcast with their share of the flow.
MAX_PATTERNS = 100_000
#: Hex digits of the seeded hash that name a pattern's buckets, level by level: each level cuts the
#: bucket in which the flow ends into 256, and only what is then in it is sorted.
BUCKET_DIGITS = (2, 4, 6)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def water_level(sizes: Sequence[int], weights: Sequence[int], total: int, most: int) -> list[tuple[int, int]]:
    """Targets as exact fractions: ``total`` shared by weight, none above ``most`` times its size.

    What a source can't take is shared again by weight among the others, so all that stay below
    their bound stand at one level of target per weight; sources are bound in order of bound / weight."""
    out = [(0, 1)] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    rest, parts = total, sum(weights)
    for at, i in enumerate(order):
        if rest * weights[i] <= most * sizes[i] * parts:
            for j in order[at:]:
                out[j] = (rest * weights[j], parts)
            break
        out[i] = (most * sizes[i], 1)
        rest, parts = rest - most * sizes[i], parts - weights[i]
    return out


def route(patterns: Sequence[tuple[tuple[int, ...], int]], quotas: Sequence[int], most: int) -> list[dict[int, int]]:
    """Tokens from each pattern (its sources, its size) to each source: the largest flow within the
    quotas, of those one of least cost when the r-th repetition of a token costs r.

    Cheapest augmenting paths in order of cost: only the arcs into the patterns cost anything, so
    the r-th repetition of all patterns is routed before any (r + 1)-th."""
    sent: list[dict[int, int]] = [dict.fromkeys(sources, 0) for sources, _ in patterns]
    takers: dict[int, set[int]] = {j: set() for j in range(len(quotas))}  # patterns that send to a source
    room, supply = list(quotas), [0] * len(patterns)
    for _ in range(most):
        supply = [s + size for s, (_, size) in zip(supply, patterns)]
        for p, (sources, _) in enumerate(patterns):  # direct arcs first
            for j in sources:
                move = min(supply[p], room[j])
                if move:
                    sent[p][j] += move
                    takers[j].add(p)
                    supply[p] -= move
                    room[j] -= move
        while True:
            # breadth first from patterns with supply; a full source leads on to patterns that send to it
            came: dict[tuple[str, int], tuple[str, int] | None] = {("p", p): None for p in range(len(patterns)) if supply[p]}
            queue, end = deque(came), None
            while queue and end is None:
                kind, x = node = queue.popleft()
                for nxt in ([("j", j) for j in patterns[x][0]] if kind == "p" else [("p", p) for p in sorted(takers[x])]):
                    if nxt not in came:
                        came[nxt] = node
                        queue.append(nxt)
                        if nxt[0] == "j" and room[nxt[1]]:
                            end = nxt
                            break
            if end is None:
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()  # p, j, p, j, ..., j
            move = min([supply[path[0][1]], room[end[1]]]
                       + [sent[path[i + 1][1]][path[i][1]] for i in range(1, len(path) - 1, 2)])
            for i in range(0, len(path) - 1, 2):
                p, j = path[i][1], path[i + 1][1]
                sent[p][j] += move
                takers[j].add(p)
                if i + 2 < len(path):
                    q = path[i + 2][1]
                    sent[q][j] -= move
                    if not sent[q][j]:
                        takers[j].discard(q)
            supply[path[0][1]] -= move
            room[end[1]] -= move
    return sent


def mix_sources(docs: DataFrame, weights: Mapping | Sequence[int], members_col: str = "sources",
                size_col: str = "size", id_col: str = "doc_id", seed: int = 42,
                most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Chooses how often each document enters a mix; ``(chosen, sources)``.

    ``chosen``: (<id_col>, size, members, taken), one row per input row; ``taken`` is the size that
    the mix takes of it, repetitions counted, ``most`` times its size at most.  Whole documents are
    taken; of one document a pattern a leading part, so that flows are met exactly.
    ``sources``: (source, size, weight, target, quota, routed), one row per source; the target is a
    double, the quota its nearest integer, and routed what the flow sends to it: the quota, unless
    sources that share documents leave too little.

    ``members_col`` is an array of source names; a null name is a source (the last in order), a null
    or empty array belongs to none and is not taken.  ``weights`` maps names to positive integers, or
    is a sequence that repeats over the sources in code point order.  Null or negative sizes count
    as 0.  Documents follow a hash of seed, id and size, so reruns agree; rows that repeat all three
    are alike, and which of them comes first doesn't show.  An empty table gives empty frames.  More
    than ``MAX_PATTERNS`` sets of sources fail with ValueError.  Other columns are ignored.
    """
    spark = docs.sparkSession
    members = F.array_sort(F.array_distinct(F.coalesce(F.col(members_col).cast("array<string>"), F.array().cast("array<string>"))))
    sized = write_scratch(docs.select(
        F.col(id_col).alias("id"), F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)).alias("size"),
        members.alias("members")).withColumn("pattern", F.to_json("members"))
        .withColumn("place", F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")),
                                               F.col("size").cast("string")))), "mix-sizes")
    groups = write_scratch(sized.groupBy("pattern", "members").agg(F.sum("size").alias("size")), "mix-patterns")
    if groups.count() > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sets of sources")
    patterns = groups.orderBy("pattern").collect()
    names = sorted({m for p in patterns for m in p.members}, key=lambda m: (m is None, m or ""))
    number = {m: i for i, m in enumerate(names)}
    if isinstance(weights, Mapping):
        weight = [int(weights[m]) for m in names]
    else:
        weight = [int(weights[i % len(weights)]) for i in range(len(names))]
    owned = [0] * len(names)
    for p in patterns:
        for m in p.members:
            owned[number[m]] += p.size
    total = sum(p.size for p in patterns if p.members)
    targets = water_level(owned, weight, total, most)
    quotas = [(2 * a + b) // (2 * b) for a, b in targets]
    flow = route([(tuple(number[m] for m in p.members), p.size) for p in patterns], quotas, most)
    used = [sum(f.values()) for f in flow]

    plan = spark.createDataFrame(
        [(p.pattern, x // p.size, "", x % p.size) for p, x in zip(patterns, used) if x],
        "pattern string, repeats long, edge string, left_over long")
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    for digits in BUCKET_DIGITS:
        inside = sized.join(F.broadcast(plan), "pattern").filter(F.col("place").startswith(F.col("edge")))
        buckets = (inside.groupBy("pattern", "repeats", "left_over", F.substring("place", 1, digits).alias("bucket"))
                   .agg(F.sum("size").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))))
        plan = write_scratch(
            buckets.filter("start <= left_over and left_over < start + n")
            .select("pattern", "repeats", F.col("bucket").alias("edge"), (F.col("left_over") - F.col("start")).alias("left_over")), "mix-plan")
    rows = sized.withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS[-1])).join(F.broadcast(plan), "pattern", "left")
    at_edge = F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))
    earlier = Window.partitionBy("pattern").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.filter(at_edge).withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    cut = cut.withColumn("extra", F.greatest(F.lit(0), F.least("size", F.col("left_over") - F.col("before")))).drop("before")
    clear = rows.filter(~at_edge).withColumn("extra", F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(F.lit(0)))
    taken = (F.coalesce("repeats", F.lit(0)) * F.col("size") + F.col("extra")).cast("long")
    chosen = cut.unionByName(clear).select(F.col("id").alias(id_col), "size", "members", taken.alias("taken"))
    routed = [sum(f.get(i, 0) for f in flow) for i in range(len(names))]
    sources = spark.createDataFrame(
        [(m, owned[i], weight[i], targets[i][0] / targets[i][1], quotas[i], routed[i]) for i, m in enumerate(names)],
        "source string, size long, weight long, target double, quota long, routed long")
    return chosen, sources


SEED = 42
ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size) AS n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
o AS (SELECT *, sum(n) OVER () AS total, row_number() OVER (ORDER BY 3 * n / w, source NULLS LAST) AS i FROM s),
l AS (SELECT *, (total - coalesce(sum(3 * n) OVER before, 0))::BIGINT AS rest,
    (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::BIGINT AS parts FROM o
    WINDOW before AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT * FROM l WHERE rest * w <= 3 * n * parts ORDER BY i LIMIT 1),
t AS (SELECT o.source, o.n, CASE WHEN o.i < level.i THEN 3 * o.n ELSE level.rest * o.w END AS a,
    CASE WHEN o.i < level.i THEN 1 ELSE level.parts END AS b FROM o, level),
q AS (SELECT source, n, a::DOUBLE / b AS target, (2 * a + b) // (2 * b) AS quota FROM t),
r AS (SELECT d.*, q.n, q.target, quota // greatest(n, 1) AS repeats, quota % greatest(n, 1) AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('42|' || coalesce(doc_id::VARCHAR, '') || '|' || size), doc_id NULLS FIRST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN q ON q.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, n::BIGINT AS source_size, target,
  (CASE WHEN n = 0 THEN 0 ELSE repeats * size + greatest(0, least(size, rest - before)) END)::BIGINT AS taken FROM r"""


@register("op12_source_mixing", ORACLE)
def op12_source_mixing(spark, sf_dir):
    """All of ``documents``; every document belongs to its one source (null: a source of its own)."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", word_count(F.col("text")).alias("size"), F.array(F.col("source").cast("string")).alias("sources"))
    chosen, sources = mix_sources(sized, weights=(1, 2, 3), seed=SEED)
    sources = sources.select("source", F.col("size").alias("source_size"), "target")
    return (chosen.withColumn("name", F.get("members", F.lit(0)))
            .join(F.broadcast(sources), F.col("name").eqNullSafe(F.col("source")))
            .select("doc_id", "size", "source_size", "target", "taken"))
