"""Registered queries: offsets, batches, samplers and training groups.

Training fixture (derived from every candidate group): positives = labelled
candidates, hard negatives = unlabelled candidates of the group, negatives =
the candidates of the next group (a retrieval-style list), corpus = all
documents with dense offsets in doc_id order.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from labelrank.operators import sampling as S
from labelrank.operators.ranking import assign_batches, global_index, rotate_positive, train_order
from labelrank.plans import fixtures as fx
from labelrank.plans.oracle import sql
from labelrank.plans.registry import register

SEED, EPOCH, G, DEPTH = 42, 0, 8, 200


# ---- Spark fixture -----------------------------------------------------------
def tr_positives(spark, sf):
    lab = fx.fx_labels(spark, sf).filter(F.col("relevance_score") == 1)
    w = Window.partitionBy("query_id").orderBy("pos")
    return lab.select(F.col("query_id").alias("qid"), (F.row_number().over(w) - 1).cast("bigint").alias("pos"), "docid")


def tr_hard(spark, sf):
    lab = fx.fx_labels(spark, sf).filter(F.col("relevance_score") == 0)
    w = Window.partitionBy("query_id").orderBy("pos")
    return lab.select(F.col("query_id").alias("qid"), (F.row_number().over(w) - 1).cast("bigint").alias("pos"), "docid")


def tr_negatives(spark, sf):
    c = fx.fx_candidates(spark, sf)
    return c.select((F.col("query_id") - 1).alias("qid"), "pos", "docid")


def tr_qidx(spark, sf):
    q = tr_positives(spark, sf).select("qid").distinct()
    return global_index(q, ["qid"], "idx")


def tr_corpus(spark, sf):
    d = fx.fx_passages(spark, sf).select("docid")
    return global_index(d, ["docid"], "offset")


def tr_inputs(spark, sf):
    corpus = tr_corpus(spark, sf)
    n = fx.fx_passages(spark, sf).count()  # single-row metadata
    return tr_qidx(spark, sf), tr_positives(spark, sf), tr_hard(spark, sf), tr_negatives(spark, sf), corpus, n


# ---- DuckDB twins ------------------------------------------------------------
TR_CTES = [
    ("tr_pos", "SELECT query_id AS qid, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS pos, docid "
               "FROM fx_labels WHERE relevance_score = 1"),
    ("tr_hard", "SELECT query_id AS qid, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS pos, docid "
                "FROM fx_labels WHERE relevance_score = 0"),
    ("tr_neg", "SELECT query_id - 1 AS qid, pos, docid FROM fx_candidates"),
    ("tr_q", "SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS idx FROM (SELECT DISTINCT qid FROM tr_pos)"),
    ("tr_corpus", "SELECT doc_id AS docid, row_number() OVER (ORDER BY doc_id) - 1 AS \"offset\" FROM documents"),
]


def d_key(*parts: str) -> str:
    return f"concat_ws('|', {', '.join(parts)})"


def d_hash60(*parts: str) -> str:
    return f"CAST(('0x' || substr(md5({d_key(*parts)}), 1, 15)) AS BIGINT)"


def d_random(p: str, qk: str, tag: str) -> list[tuple[str, str]]:
    """CTEs ``{p}_rand(qid, j, docid)``: first k distinct draws per query."""
    return [
        (f"{p}_draw", f"SELECT qid, k, jj, {d_hash60(str(SEED), str(EPOCH), 'qid', repr(tag), 'jj')} % "
                      f"(SELECT count(*) FROM tr_corpus) AS off FROM (SELECT qid, k, unnest(range(0, CASE WHEN (SELECT count(*) FROM tr_corpus) >= 4 * k THEN 2 * k + 32 "
                      f"ELSE CAST(ceil((SELECT count(*) FROM tr_corpus) * (ln((SELECT count(*) FROM tr_corpus)) + 20)) AS BIGINT) "
                      f"END)) AS jj FROM ({qk}) WHERE k > 0)"),
        (f"{p}_first", f"SELECT d.qid, d.k, c.docid, min(d.jj) AS mj FROM {p}_draw d JOIN tr_corpus c "
                       f"ON c.\"offset\" = d.off GROUP BY d.qid, d.k, c.docid"),
        (f"{p}_rand", f"SELECT qid, j, docid FROM (SELECT qid, k, docid, row_number() OVER (PARTITION BY qid ORDER BY mj) - 1 "
                      f"AS j FROM {p}_first) WHERE j < k"),
    ]


def d_sample(p: str, pool: str, need: str, tag: str) -> list[tuple[str, str]]:
    """CTE ``{p}_smp(qid, j, docid)``: need.k pool entries by md5 order."""
    return [(f"{p}_smp", f"SELECT s.qid, s.r - 1 AS j, s.docid FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY "
                         f"md5({d_key(str(SEED), str(EPOCH), 'qid', repr(tag), 'part', 'pos', 'docid')})) AS r FROM ({pool})) s "
                         f"JOIN ({need}) n USING (qid) WHERE s.r <= n.k")]


def d_fill(p: str, pool: str, need: str, tag: str) -> list[tuple[str, str]]:
    """CTE ``{p}_fill(qid, j, docid)``: the reference fill."""
    ctes = [
        (f"{p}_pool", pool),
        (f"{p}_nk", f"SELECT n.qid, n.k, coalesce(s.n, 0) AS n FROM ({need}) n LEFT JOIN "
                    f"(SELECT qid, count(*) AS n FROM {p}_pool GROUP BY qid) s USING (qid)"),
    ]
    ctes += d_sample(p, f"SELECT * FROM {p}_pool WHERE qid IN (SELECT qid FROM {p}_nk WHERE n >= k)",
                     f"SELECT qid, k FROM {p}_nk WHERE n >= k", tag + ":pool")
    ctes += d_random(p, f"SELECT qid, k - n AS k FROM {p}_nk WHERE n < k AND k > 0", tag + ":corpus")
    ctes.append((f"{p}_tail", f"SELECT t.qid, s.k - s.n + row_number() OVER (PARTITION BY t.qid ORDER BY t.part, t.pos) - 1 "
                              f"AS j, t.docid FROM {p}_pool t JOIN {p}_nk s USING (qid) WHERE s.n < s.k AND s.k > 0"))
    ctes.append((f"{p}_fill", f"SELECT qid, j, docid FROM {p}_smp UNION ALL SELECT qid, j, docid FROM {p}_rand "
                              f"UNION ALL SELECT qid, j, docid FROM {p}_tail"))
    return ctes


ROT_CTE = ("rot", f"SELECT p.qid, p.pos, p.docid FROM tr_pos p JOIN (SELECT q.qid, (q.idx + {SEED} + {EPOCH}) % c.n AS pick "
                  "FROM tr_q q JOIN (SELECT qid, count(*) AS n FROM tr_pos GROUP BY qid) c USING (qid)) r "
                  "ON r.qid = p.qid AND r.pick = p.pos")
GROUP_OUT = "SELECT qid, CAST(slot AS BIGINT) AS slot, docid FROM ({body})"


def _out(df):
    return df.select("qid", F.col("slot").cast("bigint").alias("slot"), "docid")


@register("dense_offsets", sql("SELECT docid, CAST(\"offset\" AS BIGINT) AS \"offset\" FROM tr_corpus", extra=TR_CTES))
def q_dense_offsets(spark, sf):
    return tr_corpus(spark, sf).select("docid", F.col("offset").cast("bigint").alias("offset"))


@register("rotate_positive", sql("SELECT qid, docid FROM rot", extra=TR_CTES + [ROT_CTE]))
def q_rotate_positive(spark, sf):
    """Array form: ``positives[(idx + seed + epoch) mod n]``."""
    pos = tr_positives(spark, sf)
    lists = pos.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "docid"))).alias("s")) \
        .select("qid", F.transform("s", lambda x: x["docid"]).alias("positives"))
    return lists.join(tr_qidx(spark, sf), "qid").select(
        "qid", rotate_positive(F.col("positives"), F.col("idx"), SEED, EPOCH).alias("docid"))


@register("prefix_slice", sql(
    "SELECT qid, string_agg(CAST(docid AS VARCHAR), ',' ORDER BY pos) AS negatives FROM tr_neg WHERE pos < 10 GROUP BY qid",
    extra=TR_CTES))
def q_prefix_slice(spark, sf):
    """``negatives[:n]`` on the list form (n = 10 here, 200 by default)."""
    from labelrank.operators.ranking import prefix_slice
    neg = tr_negatives(spark, sf).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "docid"))).alias("s"))
    lists = neg.select("qid", F.transform("s", lambda x: x["docid"]).alias("negs"))
    return lists.select("qid", F.array_join(F.transform(prefix_slice(F.col("negs"), 10), lambda x: x.cast("string")), ",")
                        .alias("negatives"))


ORDER_CTE = ("ord", f"SELECT qid, idx, row_number() OVER (ORDER BY md5({d_key(str(SEED), str(EPOCH), 'idx')}), idx) - 1 AS \"order\" FROM tr_q")


@register("train_order", sql("SELECT qid, CAST(idx AS BIGINT) AS idx, CAST(\"order\" AS BIGINT) AS \"order\" FROM ord",
                             extra=TR_CTES + [ORDER_CTE]))
def q_train_order(spark, sf):
    return train_order(tr_qidx(spark, sf), "idx", True, SEED, EPOCH).select(
        "qid", F.col("idx").cast("bigint").alias("idx"), F.col("order").cast("bigint").alias("order"))


@register("assign_batches", sql(
    "SELECT qid, CAST(\"order\" // 4 AS BIGINT) AS batch_id, CAST(\"order\" % 4 AS BIGINT) AS q_idx FROM ord",
    extra=TR_CTES + [ORDER_CTE]))
def q_assign_batches(spark, sf):
    o = train_order(tr_qidx(spark, sf), "idx", True, SEED, EPOCH)
    return assign_batches(o, 4).select("qid", "batch_id", "q_idx")


@register("random_negatives", sql("SELECT qid, CAST(j AS BIGINT) AS j, docid FROM rn_rand",
                                  extra=TR_CTES + d_random("rn", "SELECT qid, 30 AS k FROM tr_q", "rand")))
def q_random_negatives(spark, sf):
    """30 distinct random corpus ids per training query (``generate_random_neg``)."""
    qidx, *_rest, corpus, n = tr_inputs(spark, sf)
    return S.random_negatives(qidx.select("qid", F.lit(30).alias("k")), corpus, n_corpus=n, tag="rand")


POOL_ALL = ("SELECT qid, 1 AS part, pos, docid FROM tr_hard UNION ALL "
            f"SELECT qid, 2 AS part, pos, docid FROM tr_neg WHERE pos < {DEPTH}")


@register("sample_without_replacement", sql(
    "SELECT qid, CAST(j AS BIGINT) AS j, docid FROM sw_smp",
    extra=TR_CTES + d_sample("sw", f"SELECT * FROM ({POOL_ALL}) WHERE qid IN (SELECT qid FROM tr_q)",
                             "SELECT qid, 5 AS k FROM tr_q", "swr")))
def q_sample_without_replacement(spark, sf):
    qidx, pos, hard, neg, corpus, n = tr_inputs(spark, sf)
    pool = S._part(hard, 1).unionByName(S._part(neg.filter(F.col("pos") < DEPTH), 2)).join(qidx.select("qid"), "qid", "left_semi")
    return S.sample_without_replacement(pool, qidx.select("qid", F.lit(5).alias("k")), G, "qid", SEED, EPOCH, "swr")


@register("sample_with_replacement", sql(
    f"SELECT s.qid, CAST(s.j AS BIGINT) AS j, p.docid FROM (SELECT n.qid, n.c, unnest(range(0, {G - 1})) AS j FROM "
    "(SELECT qid, count(*) AS c FROM tr_pos GROUP BY qid) n) s JOIN tr_pos p ON p.qid = s.qid AND p.pos = "
    + d_hash60(str(SEED), str(EPOCH), "s.qid", "'choices'", "s.j") + " % s.c", extra=TR_CTES))
def q_sample_with_replacement(spark, sf):
    """``random.choices(positives, k=G-1)`` per query."""
    return S.sample_with_replacement(tr_positives(spark, sf), G - 1, "qid", SEED, EPOCH, "choices")


@register("corpus_fill", sql(
    "SELECT qid, CAST(j AS BIGINT) AS j, docid FROM cf_fill",
    extra=TR_CTES + d_fill("cf", "SELECT qid, 1 AS part, pos, docid FROM tr_hard WHERE qid IN (SELECT qid FROM tr_q)",
                           f"SELECT qid, {G} AS k FROM tr_q", "cfill")))
def q_corpus_fill(spark, sf):
    """fill(hard negatives, G): short pools are topped up from the corpus in front."""
    qidx, pos, hard, neg, corpus, n = tr_inputs(spark, sf)
    pool = S._part(hard, 1).join(qidx.select("qid"), "qid", "left_semi")
    return S.fill(pool, qidx.select("qid", F.lit(G).alias("k")), corpus, G, "qid", SEED, EPOCH, "cfill", n)


@register("group_rotate", sql(
    GROUP_OUT.format(body="SELECT qid, 0 AS slot, docid FROM rot UNION ALL SELECT qid, 1 + j, docid FROM gr_fill"),
    extra=TR_CTES + [ROT_CTE] + d_fill("gr", f"SELECT * FROM ({POOL_ALL}) WHERE qid IN (SELECT qid FROM tr_q)",
                                       f"SELECT qid, {G - 1} AS k FROM tr_q", "rotate")))
def q_group_rotate(spark, sf):
    qidx, pos, hard, neg, corpus, n = tr_inputs(spark, sf)
    return _out(S.group_rotate(qidx, pos, hard, neg, corpus, G, DEPTH, SEED, EPOCH, n_corpus=n))


@register("group_pooled", sql(
    GROUP_OUT.format(body="SELECT qid, j AS slot, docid FROM gp_fill"),
    extra=TR_CTES + d_fill("gp", f"SELECT * FROM (SELECT qid, 0 AS part, pos, docid FROM tr_pos UNION ALL {POOL_ALL}) "
                                 "WHERE qid IN (SELECT qid FROM tr_q)", f"SELECT qid, {G} AS k FROM tr_q", "pooled")))
def q_group_pooled(spark, sf):
    qidx, pos, hard, neg, corpus, n = tr_inputs(spark, sf)
    return _out(S.group_pooled(qidx, pos, hard, neg, corpus, G, DEPTH, SEED, EPOCH, n_corpus=n))


@register("group_rotate_pooled", sql(
    GROUP_OUT.format(body="SELECT qid, 0 AS slot, docid FROM rot UNION ALL SELECT qid, 1 + j, docid FROM grp_fill"),
    extra=TR_CTES + [ROT_CTE] + d_fill(
        "grp", "SELECT * FROM (SELECT p.qid, 0 AS part, p.pos, p.docid FROM tr_pos p JOIN rot r ON r.qid = p.qid "
               f"WHERE p.docid <> r.docid UNION ALL {POOL_ALL}) WHERE qid IN (SELECT qid FROM tr_q)",
        f"SELECT qid, {G - 1} AS k FROM tr_q", "rotpool")))
def q_group_rotate_pooled(spark, sf):
    qidx, pos, hard, neg, corpus, n = tr_inputs(spark, sf)
    return _out(S.group_rotate_pooled(qidx, pos, hard, neg, corpus, G, DEPTH, SEED, EPOCH, n_corpus=n))


@register("group_all_positives", sql(
    GROUP_OUT.format(body="SELECT qid, j AS slot, docid FROM ap_smp UNION ALL "
                          "SELECT qid, pos AS slot, docid FROM tr_pos WHERE qid IN (SELECT qid FROM ap_few) UNION ALL "
                          "SELECT f.qid, a.n + f.j, f.docid FROM apf_fill f JOIN ap_few a USING (qid)"),
    extra=TR_CTES + [
        ("ap_n", "SELECT q.qid, coalesce(c.n, 0) AS n FROM tr_q q LEFT JOIN (SELECT qid, count(*) AS n FROM tr_pos GROUP BY qid) c USING (qid)"),
        ("ap_few", f"SELECT qid, n FROM ap_n WHERE n < {G}")]
    + d_sample("ap", f"SELECT qid, 0 AS part, pos, docid FROM tr_pos WHERE qid IN (SELECT qid FROM ap_n WHERE n >= {G})",
               f"SELECT qid, {G} AS k FROM ap_n WHERE n >= {G}", "allpos")
    + d_fill("apf", f"SELECT * FROM ({POOL_ALL}) WHERE qid IN (SELECT qid FROM ap_few)",
             f"SELECT qid, {G} - n AS k FROM ap_few", "allpos")))
def q_group_all_positives(spark, sf):
    qidx, pos, hard, neg, corpus, n = tr_inputs(spark, sf)
    return _out(S.group_all_positives(qidx, pos, hard, neg, corpus, G, DEPTH, SEED, EPOCH, n_corpus=n))


@register("group_first_positive", sql(
    GROUP_OUT.format(body="SELECT qid, 0 AS slot, docid FROM tr_pos WHERE pos = 0 AND qid IN (SELECT qid FROM tr_q) UNION ALL "
                          "SELECT qid, 1 + j, docid FROM fh_smp UNION ALL "
                          "SELECT qid, 1 + pos, docid FROM tr_hard WHERE qid IN (SELECT qid FROM fh_few) UNION ALL "
                          "SELECT f.qid, 1 + a.h + f.j, f.docid FROM fhf_fill f JOIN fh_few a USING (qid)"),
    extra=TR_CTES + [
        ("fh_n", "SELECT q.qid, coalesce(c.h, 0) AS h FROM tr_q q LEFT JOIN (SELECT qid, count(*) AS h FROM tr_hard GROUP BY qid) c USING (qid)"),
        ("fh_few", f"SELECT qid, h FROM fh_n WHERE h < {G - 1}")]
    + d_sample("fh", f"SELECT qid, 1 AS part, pos, docid FROM tr_hard WHERE qid IN (SELECT qid FROM fh_n WHERE h >= {G - 1})",
               f"SELECT qid, {G - 1} AS k FROM fh_n WHERE h >= {G - 1}", "hard")
    + d_fill("fhf", f"SELECT qid, 2 AS part, pos, docid FROM tr_neg WHERE pos < {DEPTH} AND qid IN (SELECT qid FROM fh_few)",
             f"SELECT qid, {G - 1} - h AS k FROM fh_few", "first")))
def q_group_first_positive(spark, sf):
    qidx, pos, hard, neg, corpus, n = tr_inputs(spark, sf)
    return _out(S.group_first_positive(qidx, pos, hard, neg, corpus, G, DEPTH, SEED, EPOCH, n_corpus=n))


REC_BODY = GROUP_OUT.format(body="SELECT qid, 0 AS slot, docid FROM tr_pos WHERE pos = 0 UNION ALL "
                                 "SELECT qid, 1 + j, docid FROM rec_smp UNION ALL SELECT qid, 1 + j, docid FROM rec_ch")
REC_EXTRA = TR_CTES + [
    ("rec_neg", "SELECT qid, pos, docid FROM tr_hard WHERE qid IN (SELECT qid FROM tr_pos)"),
    ("rec_n", "SELECT qid, count(*) AS n FROM rec_neg GROUP BY qid"),
    ("rec_ch", f"SELECT s.qid, s.j, p.docid FROM (SELECT qid, n, unnest(range(0, {G - 1})) AS j FROM rec_n WHERE n < {G - 1}) s "
               "JOIN rec_neg p ON p.qid = s.qid AND p.pos = " + d_hash60(str(SEED), str(EPOCH), "s.qid", "'records'", "s.j") + " % s.n")] \
    + d_sample("rec", f"SELECT qid, 1 AS part, pos, docid FROM rec_neg WHERE qid IN (SELECT qid FROM rec_n WHERE n >= {G - 1})",
               f"SELECT qid, {G - 1} AS k FROM rec_n WHERE n >= {G - 1}", "records")


@register("group_from_records", sql(REC_BODY, extra=REC_EXTRA))
def q_group_from_records(spark, sf):
    """Records: positives = labelled candidates, negatives = the other candidates."""
    return _out(record_groups(spark, sf))


def record_groups(spark, sf):
    pos = tr_positives(spark, sf)
    neg = tr_hard(spark, sf).join(pos.select("qid").distinct(), "qid", "left_semi")
    return S.group_from_records(pos, neg, G, SEED, EPOCH)
