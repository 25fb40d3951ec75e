"""Registered queries: tokenise, encode, pool, project, in-batch scores, labels, losses
(SURVEY 2.8, 2.9).  Training batches: record groups (G=8) in seeded order, B=4."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelrank.models import HashedBowEncoder
from labelrank.operators import losses as L
from labelrank.operators import vectors as V
from labelrank.operators.ranking import assign_batches, train_order
from labelrank.plans import fixtures as fx
from labelrank.plans.catalog_sampling import (EPOCH, G, ORDER_CTE, REC_BODY, REC_EXTRA, SEED, d_hash60,
                                              record_groups, tr_qidx)
from labelrank.plans.oracle import sql
from labelrank.plans.registry import register
from labelrank.session import write_once

B = 4


def d_tok_ids(text: str, max_len: int | None) -> str:
    ids = (f"list_transform(list_filter(string_split(lower({text}), ' '), lambda t: t <> ''), "
           f"lambda t: {d_hash60('t')} % {V.VOCAB} + 3)")
    return f"{ids}[1:{max_len}]" if max_len else ids


def ids_str(col):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), " ")


@register("tokenize_corpus", sql(
    f"SELECT docid, array_to_string({d_tok_ids('text', 512)}, ' ') AS input_ids FROM fx_passages"))
def q_tokenize_corpus(spark, sf):
    t = V.tokenize_corpus(fx.fx_passages(spark, sf), "docid", "text", max_length=512)
    return t.select("docid", ids_str(F.col("input_ids")).alias("input_ids"))


@register("truncate_tokens", sql(
    f"SELECT docid, array_to_string(list_concat([1], {d_tok_ids('text', None)}[1:126], [2]), ' ') AS input_ids "
    "FROM fx_passages"))
def q_truncate_tokens(spark, sf):
    t = V.tokenize_corpus(fx.fx_passages(spark, sf), "docid", "text", max_length=126)
    return t.select("docid", ids_str(V.truncate_tokens(F.col("input_ids"), 128)).alias("input_ids"))


@register("tokenize_records", sql(
    f"SELECT q.query_id AS qid, 'query' AS side, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS docid, "
    f"array_to_string({d_tok_ids('q.query', 32)}, ' ') AS input_ids FROM fx_candidate_queries q "
    "UNION ALL SELECT l.query_id, CASE WHEN l.relevance_score = 1 THEN 'positive' ELSE 'negative' END, "
    "CAST(row_number() OVER (PARTITION BY l.query_id, l.relevance_score ORDER BY l.pos) - 1 AS BIGINT), l.docid, "
    f"array_to_string({d_tok_ids(chr(99) + '.title || ' + repr('[SEP]') + ' || c.text', 128)}, ' ') "
    "FROM fx_labels l JOIN fx_candidates c ON c.query_id = l.query_id AND c.pos = l.pos"))
def q_tokenize_records(spark, sf):
    """Query ids (<= 32) and ``title[SEP]text`` ids (<= 128) of every record passage."""
    c = fx.fx_candidates(spark, sf).join(fx.fx_labels(spark, sf).select("query_id", "pos", "relevance_score"),
                                         ["query_id", "pos"])

    def side(flag):
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("relevance_score") == flag, F.struct("pos", "docid", "title", "text")))),
                           lambda x: F.struct(x["docid"].alias("docid"), x["title"].alias("title"), x["text"].alias("text")))

    records = (c.groupBy("query_id").agg(side(1).alias("positive_passages"), side(0).alias("negative_passages"))
               .join(fx.fx_candidate_queries(spark, sf), "query_id"))
    out = V.tokenize_records(records)
    return out.select("qid", "side", "pos", "docid", ids_str(F.col("input_ids")).alias("input_ids"))


# ---- batches of record groups -----------------------------------------------------
def batched_groups(spark, sf):
    order = write_once(assign_batches(train_order(tr_qidx(spark, sf), "idx", True, SEED, EPOCH), B), "order")
    g = record_groups(spark, sf).join(order.select("qid", "batch_id", "q_idx"), "qid")
    return write_once(g.withColumn("p_idx", (F.col("q_idx") * G + F.col("slot")).cast("bigint")), "groups"), order


BATCH_CTES = REC_EXTRA + [ORDER_CTE, ("recg", REC_BODY),
                          ("ordb", "SELECT qid, \"order\" // 4 AS batch_id, \"order\" % 4 AS q_idx FROM ord"),
                          ("bg", f"SELECT g.qid, g.slot, g.docid, o.batch_id, o.q_idx, o.q_idx * {G} + g.slot AS p_idx "
                                 "FROM recg g JOIN ordb o USING (qid)")]


@register("pad_batch", sql(
    "SELECT batch_id, p_idx, CAST(len(ids) AS BIGINT) AS n_tokens, CAST(list_sum(mask) AS BIGINT) AS n_real, "
    "array_to_string(ids, ' ') AS input_ids FROM (SELECT batch_id, p_idx, "
    "list_concat(t, list_transform(range(mx - len(t)), lambda x: 0)) AS ids, "
    "list_concat(list_transform(t, lambda x: 1), list_transform(range(mx - len(t)), lambda x: 0)) AS mask FROM ("
    "SELECT batch_id, p_idx, t, max(len(t)) OVER (PARTITION BY batch_id) AS mx FROM ("
    f"SELECT b.batch_id, b.p_idx, list_concat([1], {d_tok_ids('d.text', None)}[1:126], [2]) AS t "
    "FROM bg b JOIN fx_passages d ON d.docid = b.docid)))", extra=BATCH_CTES))
def q_pad_batch(spark, sf):
    bg, _ = batched_groups(spark, sf)
    toks = V.tokenize_corpus(fx.fx_passages(spark, sf), "docid", "text", max_length=126)
    t = bg.join(toks, "docid").select("batch_id", "p_idx", V.truncate_tokens(F.col("input_ids"), 128).alias("input_ids"))
    p = V.pad_batch(t)
    return p.select("batch_id", "p_idx", F.size("input_ids").cast("bigint").alias("n_tokens"),
                    F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_real"),
                    ids_str(F.col("input_ids")).alias("input_ids"))


def bow_ctes(src: str) -> list[tuple[str, str]]:
    return [
        ("bow_src", src),
        ("bow_tok", "SELECT side, id, unnest(list_filter(string_split(lower(text), ' '), lambda t: t <> '')) AS t FROM bow_src"),
        ("bow_cnt", f"SELECT side, id, {d_hash60('t')} % 64 AS b, count(*) AS c FROM bow_tok GROUP BY side, id, b"),
        ("bow_vec", "SELECT c.side, c.id, c.b, c.c / greatest(sqrt(n.ss), 1e-12) AS v FROM bow_cnt c JOIN "
                    "(SELECT side, id, sum(c * c) AS ss FROM bow_cnt GROUP BY side, id) n USING (side, id)"),
    ]


SCORE_CTES = BATCH_CTES + bow_ctes(
    "SELECT 'q' AS side, query_id AS id, query AS text FROM fx_candidate_queries WHERE query_id IN (SELECT qid FROM ordb) "
    "UNION ALL SELECT 'p', docid, text FROM fx_passages WHERE docid IN (SELECT docid FROM bg)") + [
    ("pairs", "SELECT q.batch_id, q.q_idx, q.qid, p.p_idx, p.docid FROM ordb q JOIN bg p USING (batch_id)"),
    ("dots", "SELECT pr.batch_id, pr.q_idx, pr.p_idx, sum(qv.v * pv.v) AS s FROM pairs pr "
             "JOIN bow_vec qv ON qv.side = 'q' AND qv.id = pr.qid JOIN bow_vec pv ON pv.side = 'p' AND pv.id = pr.docid "
             "AND pv.b = qv.b GROUP BY pr.batch_id, pr.q_idx, pr.p_idx"),
    ("scored", "SELECT pr.batch_id, pr.q_idx, pr.p_idx, coalesce(d.s, 0.0) AS score FROM pairs pr LEFT JOIN dots d "
               "USING (batch_id, q_idx, p_idx)"),
    ("teach", "SELECT b.batch_id, b.q_idx, b.slot, CAST(l.quality AS DOUBLE) AS score FROM bg b JOIN labels l ON l.doc_id = b.docid"),
    ("targets", f"SELECT s.batch_id, s.q_idx, s.p_idx, s.score, coalesce(t.score, 0.0) AS target FROM scored s LEFT JOIN teach t "
                f"ON t.batch_id = s.batch_id AND t.q_idx = s.q_idx AND t.slot = s.p_idx - s.q_idx * {G}"),
    ("onehot", f"SELECT batch_id, q_idx, p_idx, score, CASE WHEN p_idx = q_idx * {G} THEN 1.0 ELSE 0.0 END AS target FROM scored"),
]


def batch_vectors(spark, sf):
    """(queries, passages, groups): the encoded sides of every batch."""
    bg, order = batched_groups(spark, sf)
    q = fx.fx_candidate_queries(spark, sf).select(F.col("query_id").alias("qid"), F.col("query").alias("text")) \
        .join(order.select("qid"), "qid", "left_semi")
    qv = V.hashed_bow_encode(q, "qid", "text")
    docs = fx.fx_passages(spark, sf).select("docid", "text").join(bg.select("docid"), "docid", "left_semi")
    pv = V.hashed_bow_encode(docs, "docid", "text")
    queries = order.select("qid", "batch_id", "q_idx").join(qv, "qid").select("batch_id", "q_idx", F.col("embedding").alias("q_vec"))
    passages = bg.join(pv, "docid").select("batch_id", "p_idx", F.col("embedding").alias("p_vec"))
    return queries, passages, bg


def scored_batches(spark, sf):
    queries, passages, bg = batch_vectors(spark, sf)
    return V.in_batch_scores(queries, passages), bg


def with_teacher(spark, sf):
    scores, bg = scored_batches(spark, sf)
    labels = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("docid"), "quality")
    teacher = bg.join(labels, "docid").select("batch_id", "q_idx", "slot", F.col("quality").cast("double").alias("score"))
    return V.label_matrix(scores, G, teacher)


def _sc(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in ("score", "target", "loss", "value") else c for c in cols])


@register("in_batch_scores", sql("SELECT batch_id, q_idx, p_idx, round(score, 6) AS score FROM scored", extra=SCORE_CTES))
def q_in_batch_scores(spark, sf):
    return _sc(scored_batches(spark, sf)[0], ["batch_id", "q_idx", "p_idx", "score"])


@register("label_matrix", sql("SELECT batch_id, q_idx, p_idx, round(target, 6) AS target FROM targets", extra=SCORE_CTES))
def q_label_matrix(spark, sf):
    return _sc(with_teacher(spark, sf), ["batch_id", "q_idx", "p_idx", "target"])


GATHER_CTES = SCORE_CTES + [
    ("gq", f"SELECT batch_id // 2 AS step, (batch_id % 2) * {B} + q_idx AS q_idx, qid FROM ordb"),
    ("gp", f"SELECT batch_id // 2 AS step, (batch_id % 2) * {B * G} + p_idx AS p_idx, docid FROM bg"),
    ("gdots", "SELECT q.step, q.q_idx, p.p_idx, sum(qv.v * pv.v) AS s FROM gq q JOIN gp p ON p.step = q.step "
              "JOIN bow_vec qv ON qv.side = 'q' AND qv.id = q.qid JOIN bow_vec pv ON pv.side = 'p' AND pv.id = p.docid "
              "AND pv.b = qv.b GROUP BY q.step, q.q_idx, p.p_idx")]


@register("gather_batches", sql(
    "SELECT CAST(q.step AS BIGINT) AS batch_id, q.q_idx, p.p_idx, round(coalesce(d.s, 0.0), 6) AS score "
    "FROM gq q JOIN gp p ON p.step = q.step LEFT JOIN gdots d ON d.step = q.step AND d.q_idx = q.q_idx AND d.p_idx = p.p_idx",
    extra=GATHER_CTES))
def q_gather_batches(spark, sf):
    """Two devices: each query meets the passages of both batches of its global step."""
    queries, passages, _ = batch_vectors(spark, sf)
    scores = V.in_batch_scores(V.gather_batches(queries, 2, B, G), V.gather_batches(passages, 2, B, G))
    return _sc(scores, ["batch_id", "q_idx", "p_idx", "score"])


PER_Q = ("perq", "SELECT batch_id, q_idx, m + ln(z) AS lse, ts, tsum, pe, z FROM (SELECT batch_id, q_idx, max(m) AS m, "
                 "sum(exp(score - m)) AS z, sum(target * score) AS ts, sum(target) AS tsum, sum(target * exp(score - m)) AS pe "
                 "FROM (SELECT *, max(score) OVER (PARTITION BY batch_id, q_idx) AS m FROM {src}) GROUP BY batch_id, q_idx)")


def _loss_sql(src: str, agg: str) -> str:
    return sql(f"SELECT batch_id, round({agg}, 6) AS loss FROM perq GROUP BY batch_id",
               extra=SCORE_CTES + [(PER_Q[0], PER_Q[1].format(src=src))])


@register("loss_softmax", _loss_sql("onehot", "avg(tsum * lse - ts)"))
def q_loss_softmax(spark, sf):
    s = V.label_matrix(scored_batches(spark, sf)[0], G)
    return _sc(L.loss_softmax(s), ["batch_id", "loss"])


@register("loss_multi_softmax", _loss_sql("targets", "coalesce(sum(tsum * lse - ts) / nullif(count(*) FILTER "
                                                      "(WHERE tsum * lse - ts <> 0), 0), 0.0)"))
def q_loss_multi_softmax(spark, sf):
    return _sc(L.loss_multi_softmax(with_teacher(spark, sf)), ["batch_id", "loss"])


@register("loss_marginal", _loss_sql("targets", "coalesce(avg(CASE WHEN tsum > 0 THEN -ln(least(greatest(pe / z, 1e-9), 1.0)) "
                                                 "END), 0.0)"))
def q_loss_marginal(spark, sf):
    return _sc(L.loss_marginal(with_teacher(spark, sf)), ["batch_id", "loss"])


@register("loss_hinge", sql(
    "SELECT batch_id, round(avg(CASE WHEN 2 * target - 1 <> 1 THEN greatest(0.5 - (1 - score), 0.0) ELSE 0.0 END + "
    "CASE WHEN 2 * target - 1 <> -1 THEN 1 - score ELSE 0.0 END), 6) AS loss FROM targets GROUP BY batch_id",
    extra=SCORE_CTES))
def q_loss_hinge(spark, sf):
    return _sc(L.loss_hinge(with_teacher(spark, sf)), ["batch_id", "loss"])


# ---- vectors on embeddings -------------------------------------------------------
def _long(df, key, vec):
    return df.select(key, F.posexplode(vec).alias("dim", "value")).select(
        key, F.col("dim").cast("bigint").alias("dim"), F.round(F.col("value").cast("double"), 6).alias("value"))


D_LONG = ("SELECT {key}, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS dim, round(unnest(v), 6) AS value FROM ({src})")
D_PROJ = ("list_transform(range(64), lambda j: list_sum(list_transform(range(64), lambda i: "
          "CAST(embedding[i + 1] AS DOUBLE) * (((7 * i + 3 * j) % 11) - 5) / 10.0)))")


@register("pool_cls", sql(D_LONG.format(key="label", src="SELECT label, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS v "
                                                          "FROM embeddings GROUP BY label")))
def q_pool_cls(spark, sf):
    """Sequences = embeddings grouped by label in vec_id order; first vector."""
    e = fx.table(spark, sf, "embeddings")
    return _long(V.pool_cls(e, "label", "vec_id", "embedding"), "label", "embedding")


@register("pool_mean", sql(
    "SELECT label, CAST(i - 1 AS BIGINT) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS value FROM ("
    "SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i"))
def q_pool_mean(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    return _long(V.pool_mean(e, "label", "embedding"), "label", "embedding")


@register("linear_project", sql(D_LONG.format(key="vec_id", src=f"SELECT vec_id, {D_PROJ} AS v FROM embeddings")))
def q_linear_project(spark, sf):
    e = fx.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return _long(V.linear_project(e, "embedding", V.formula_weights(64, 64)), "vec_id", "projected")


@register("l2_normalize", sql(D_LONG.format(
    key="vec_id", src=f"SELECT vec_id, list_transform(p, lambda x: x / greatest(sqrt(list_sum(list_transform(p, lambda y: y * y))), 1e-12)) AS v "
                      f"FROM (SELECT vec_id, {D_PROJ} AS p FROM embeddings)")))
def q_l2_normalize(spark, sf):
    e = fx.table(spark, sf, "embeddings").select("vec_id", "embedding")
    p = V.linear_project(e, "embedding", V.formula_weights(64, 64))
    return _long(p.select("vec_id", V.l2_normalize("projected").alias("v")), "vec_id", "v")


@register("batch_encode", sql(
    "SELECT d.docid, CAST(t.b AS BIGINT) AS dim, round(CAST(CAST(coalesce(v.v, 0.0) AS FLOAT) AS DOUBLE), 6) AS value "
    "FROM fx_passages d CROSS JOIN range(64) t(b) LEFT JOIN bow_vec v ON v.id = d.docid AND v.b = t.b",
    extra=bow_ctes("SELECT 'p' AS side, docid AS id, text FROM fx_passages")))
def q_batch_encode(spark, sf):
    """The user-encoder path (``mapInPandas``), here with the Python twin of the stand-in."""
    d = fx.fx_passages(spark, sf)
    enc = V.batch_encode(d, "docid", "text", lambda: HashedBowEncoder(64), 64)
    return _long(enc, "docid", "embedding")
