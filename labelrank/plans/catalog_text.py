"""Registered queries: text functions, prompts, reply parsing, set operations
(SURVEY 2.2, 2.3, 2.4, 2.11)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from labelrank.functions import prompts as P
from labelrank.functions import replies as R
from labelrank.functions import text as T
from labelrank.operators.ranking import global_index
from labelrank.plans import fixtures as fx
from labelrank.plans.oracle import sql
from labelrank.plans.registry import register
from labelrank.session import write_once

STRIP = T.STRIP_PATTERN.replace("'", "''")


def d_strip(x: str) -> str:
    return f"regexp_replace({x}, '{STRIP}', '', 'g')"


def d_format_passage(text: str, title: str) -> str:
    return d_strip(f"{d_strip(f'coalesce({title}, {chr(39)}{chr(39)})')} || ' ' || {d_strip(text)}")


def d_trunc(x: str, n: int = 300) -> str:
    return f"array_to_string(string_split({x}, ' ')[1:{n}], ' ')"


def d_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@register("format_query", sql(f"SELECT query_id, {d_strip('query')} AS query FROM fx_queries"))
def q_format_query(spark, sf):
    return fx.fx_queries(spark, sf).select("query_id", T.format_query("query").alias("query"))


@register("format_passage", sql(f"SELECT docid, {d_format_passage('text', 'title')} AS passage FROM fx_passages"))
def q_format_passage(spark, sf):
    return fx.fx_passages(spark, sf).select("docid", T.format_passage("text", "title").alias("passage"))


@register("title_sep_join", sql(
    "SELECT docid, CASE WHEN title IS NOT NULL THEN title || '[SEP]' || text ELSE text END AS text FROM fx_passages"))
def q_title_sep_join(spark, sf):
    return fx.fx_passages(spark, sf).select("docid", T.title_sep_join("title", "text").alias("text"))


@register("truncate_words", sql(f"SELECT docid, {d_trunc('text')} AS text FROM fx_passages"))
def q_truncate_words(spark, sf):
    return fx.fx_passages(spark, sf).select("docid", T.truncate_words("text", 300).alias("text"))


# stand-in answer replies: derived from each candidate group, with a reasoning block
def fx_answers(spark, sf):
    c = fx.fx_candidates(spark, sf).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("title").alias("t"))
    return c.select("query_id", F.concat(F.lit("<think>draft for "), F.col("query_id").cast("string"),
                                         F.lit("</think>Answer drawn from "), F.col("n").cast("string"),
                                         F.lit(" passages of "), F.col("t"), F.lit(".")).alias("answer_output"))


FX_ANSWERS = ("fx_answers", "SELECT query_id, '<think>draft for ' || query_id || '</think>Answer drawn from ' "
                            "|| count(*) || ' passages of ' || min(title) || '.' AS answer_output "
                            "FROM fx_candidates GROUP BY query_id")
D_STRIP_REASONING = ("CASE WHEN contains({x}, '</think>') THEN string_split({x}, '</think>')[2] ELSE {x} END")


@register("strip_reasoning", sql("SELECT query_id, " + D_STRIP_REASONING.format(x="answer_output")
                                 + " AS answer FROM fx_answers UNION ALL SELECT query_id + 1000000000, "
                                 + D_STRIP_REASONING.format(x="relevance_output") + " FROM fx_reply",
                                 extra=[FX_ANSWERS]))
def q_strip_reasoning(spark, sf):
    a = fx_answers(spark, sf).select("query_id", T.strip_reasoning("answer_output").alias("answer"))
    r = fx.fx_reply(spark, sf).select((F.col("query_id") + 1000000000).alias("query_id"),
                                      T.strip_reasoning("relevance_output").alias("answer"))
    return a.unionByName(r)


PARSE_SEL_SQL = ("SELECT l.query_id, l.pos, l.docid, CAST(CASE WHEN list_contains(n.nums, l.pos) THEN 1 ELSE 0 END "
                 "AS INTEGER) AS relevance_score FROM fx_labels l JOIN (SELECT query_id, list_transform("
                 "regexp_extract_all(relevance_output, '\\[([0-9]+)\\]', 1), lambda x: TRY_CAST(x AS BIGINT) - 1) AS nums "
                 "FROM fx_reply) n USING (query_id)")


def parsed_selection(spark, sf):
    rep = fx.fx_reply(spark, sf)
    return rep.select("query_id", "passages_ids",
                      R.parse_selection("relevance_output", "passages_ids").alias("relevance_score"))


@register("parse_selection", sql(PARSE_SEL_SQL))
def q_parse_selection(spark, sf):
    p = parsed_selection(spark, sf)
    return p.select("query_id", F.posexplode(F.arrays_zip("passages_ids", "relevance_score")).alias("pos", "z")) \
            .select("query_id", F.col("pos").cast("bigint").alias("pos"), F.col("z.passages_ids").alias("docid"),
                    F.col("z.relevance_score").alias("relevance_score"))


@register("relevance_filter", sql(
    "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS idx, docid "
    "FROM sel WHERE relevance_score = 1", extra=[("sel", PARSE_SEL_SQL)]))
def q_relevance_filter(spark, sf):
    p = parsed_selection(spark, sf).select(
        "query_id", T.relevance_filter("passages_ids", "relevance_score").alias("ids"))
    return p.select("query_id", F.posexplode("ids").alias("idx", "docid")) \
            .select("query_id", F.col("idx").cast("bigint").alias("idx"), "docid")


def hard_lists(spark, sf):
    """Negatives-file style lists: ``split(',')`` of the joined negatives (``['']`` when none)."""
    lab = fx.fx_labels(spark, sf)
    g = lab.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(
        F.col("relevance_score") == 0, F.struct("pos", F.col("docid").cast("string").alias("d"))))).alias("s"))
    return g.select("query_id", F.split(F.array_join(F.transform("s", lambda x: x["d"]), ","), ",", -1).alias("hard"))


@register("has_hard_negatives", sql(
    "SELECT query_id, CAST(CASE WHEN h = [''] THEN 0 ELSE len(h) END AS BIGINT) AS n_hard, "
    "CASE WHEN h = [''] THEN '' ELSE array_to_string(h, ',') END AS hard FROM ("
    "SELECT query_id, string_split(coalesce(string_agg(CAST(docid AS VARCHAR), ',' ORDER BY pos) "
    "FILTER (WHERE relevance_score = 0), ''), ',') AS h FROM fx_labels GROUP BY query_id)"))
def q_has_hard(spark, sf):
    h = hard_lists(spark, sf).select("query_id", T.has_hard_negatives("hard").alias("h"))
    return h.select("query_id", F.size("h").cast("bigint").alias("n_hard"), F.array_join("h", ",").alias("hard"))


@register("shard_filter", sql(
    "SELECT docid, \"offset\" FROM (SELECT doc_id AS docid, row_number() OVER (ORDER BY doc_id) - 1 AS \"offset\", "
    "count(*) OVER () AS n FROM documents) WHERE \"offset\" >= (n // 3) * 1 + least(1, n % 3) "
    "AND \"offset\" < (n // 3) * 1 + least(1, n % 3) + n // 3 + CASE WHEN 1 < n % 3 THEN 1 ELSE 0 END"))
def q_shard_filter(spark, sf):
    """Shard 1 of 3 (contiguous) of the documents in doc_id order."""
    docs = fx.fx_passages(spark, sf).select("docid")
    idx = global_index(docs, ["docid"], "offset")
    return T.shard_filter(idx, 3, 1, "offset").select("docid", F.col("offset").cast("bigint").alias("offset"))


# ---- prompts ------------------------------------------------------------------
def formatted_candidates(spark, sf):
    lists = fx.fx_candidate_lists(spark, sf)
    return lists.select("query_id", "query", F.transform(
        "passages", lambda p: T.format_passage(p["text"], p["title"])).alias("passages"),
        F.transform("passages", lambda p: p["docid"]).alias("passages_ids"))


def explode_messages(df, col="messages"):
    return df.select("query_id", F.posexplode(col).alias("turn", "m")).select(
        "query_id", F.col("turn").cast("bigint").alias("turn"), F.col("m.role").alias("role"),
        F.col("m.content").alias("content"))


def d_messages(pre: list[tuple[str, str]], post: str, passages_src: str, trunc: bool = True) -> str:
    """DuckDB: preamble turns, two turns per passage, final turn, per query."""
    parts = []
    for i, (role, content) in enumerate(pre):
        parts.append(f"SELECT query_id, CAST({i} AS BIGINT) AS turn, '{role}' AS role, {content} AS content FROM qx")
    body = d_trunc("fp") if trunc else "fp"
    np_ = len(pre)
    parts.append(f"SELECT query_id, {np_} + 2 * pos AS turn, 'user' AS role, '[' || (pos + 1) || '] ' || {body} "
                 f"AS content FROM {passages_src}")
    parts.append(f"SELECT query_id, {np_ + 1} + 2 * pos AS turn, 'assistant' AS role, 'Received passage [' || "
                 f"(pos + 1) || '].' AS content FROM {passages_src}")
    parts.append(f"SELECT query_id, {np_} + 2 * num AS turn, 'user' AS role, {post} AS content FROM qx")
    return "\nUNION ALL\n".join(parts)


def d_fill(template: str, **exprs) -> str:
    import re
    out, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            out.append(d_lit(template[pos:m.start()]))
        out.append(f"CAST({exprs[m.group(1)]} AS VARCHAR)")
        pos = m.end()
    if pos < len(template):
        out.append(d_lit(template[pos:]))
    return "(" + " || ".join(out) + ")"


FP_CTE = ("fp_all", "SELECT c.query_id, c.pos, c.docid, "
          + d_format_passage("c.text", "c.title") + " AS fp FROM fx_candidates c")
QX_CTE = ("qx", "SELECT q.query_id, q.query, (SELECT count(*) FROM fp_all f WHERE f.query_id = q.query_id) AS num "
                "FROM fx_candidate_queries q")


@register("relevance_messages", sql(d_messages(
    [("user", d_lit(P.RELEVANCE_SYSTEM)), ("assistant", d_lit(P.RELEVANCE_ACK)),
     ("user", d_fill(P.RELEVANCE_TASK, num="num", query="query")), ("assistant", d_lit(P.RELEVANCE_READY))],
    d_fill(P.RELEVANCE_POST, query="query", instruct=d_lit(P.RELEVANCE_INSTRUCT)), "fp_all"),
    extra=[FP_CTE, QX_CTE]))
def q_relevance_messages(spark, sf):
    c = formatted_candidates(spark, sf)
    return explode_messages(c.select("query_id", P.relevance_messages(F.col("query"), F.col("passages")).alias("messages")))


@register("answer_messages", sql(
    "SELECT query_id, CAST(0 AS BIGINT) AS turn, 'user' AS role, " + d_lit(P.ANSWER_SYSTEM) + " AS content FROM qx "
    "UNION ALL SELECT query_id, 1, 'assistant', " + d_lit(P.ANSWER_ACK) + " FROM qx "
    "UNION ALL SELECT query_id, 2, 'user', " + d_fill(P.ANSWER_TASK, passages="pj", query="query") + " FROM qx2",
    extra=[FP_CTE, QX_CTE, ("qx2", "SELECT q.query_id, q.query, string_agg(f.fp, chr(10) ORDER BY f.pos) AS pj "
                                   "FROM qx q JOIN fp_all f USING (query_id) GROUP BY q.query_id, q.query")]))
def q_answer_messages(spark, sf):
    c = formatted_candidates(spark, sf)
    return explode_messages(c.select("query_id", P.answer_messages(F.col("query"), F.col("passages")).alias("messages")))


def utility_inputs(spark, sf):
    """Relevance-filtered passages (ordered) + stripped answers + query text."""
    sel = parsed_selection(spark, sf).select(
        "query_id", T.relevance_filter("passages_ids", "relevance_score").alias("ids"))
    from labelrank.operators.lookup import attach_passages
    fp = formatted_candidates(spark, sf).select("query_id", F.explode(F.arrays_zip("passages_ids", "passages")).alias("z")) \
        .select(F.col("z.passages_ids").alias("docid"), F.col("z.passages").alias("passage"))
    with_p = attach_passages(sel, fp, ids="ids", key="docid", value="passage", out="passages")
    ans = fx_answers(spark, sf).select("query_id", T.strip_reasoning("answer_output").alias("answer"))
    q = fx.fx_candidate_queries(spark, sf)
    return with_p.join(ans, "query_id").join(q, "query_id")


UT_SEL_CTE = ("sel", PARSE_SEL_SQL)
UT_CTES = [FP_CTE, UT_SEL_CTE, FX_ANSWERS,
           ("fp_sel", "SELECT s.query_id, row_number() OVER (PARTITION BY s.query_id ORDER BY s.pos) - 1 AS pos, f.fp "
                      "FROM sel s JOIN fp_all f ON f.query_id = s.query_id AND f.pos = s.pos WHERE s.relevance_score = 1"),
           ("qx", "SELECT q.query_id, q.query, " + D_STRIP_REASONING.format(x="a.answer_output") + " AS answer, "
                  "(SELECT count(*) FROM fp_sel f WHERE f.query_id = q.query_id) AS num "
                  "FROM fx_candidate_queries q JOIN fx_answers a USING (query_id)")]


@register("utility_messages", sql(d_messages(
    [("user", d_lit(P.UTILITY_SYSTEM)), ("assistant", d_lit(P.UTILITY_ACK)),
     ("user", d_fill(P.UTILITY_TASK, num="num", query="query")), ("assistant", d_lit(P.UTILITY_READY))],
    d_fill(P.UTILITY_POST, query="query", answer="answer", instruct=d_lit(P.UTILITY_INSTRUCT)), "fp_sel"),
    extra=UT_CTES))
def q_utility_messages(spark, sf):
    u = utility_inputs(spark, sf)
    return explode_messages(u.select("query_id", P.utility_messages(F.col("query"), F.col("passages"),
                                                                    F.col("answer")).alias("messages")))


@register("utility_ranking_messages", sql(d_messages(
    [("user", d_lit(P.RANKING_SYSTEM)), ("assistant", d_lit(P.RANKING_ACK)),
     ("user", d_fill(P.RANKING_TASK, num="num", query="query")), ("assistant", d_lit(P.RANKING_READY))],
    d_fill(P.RANKING_POST, query="query", answer="answer", num="num"), "fp_sel"), extra=UT_CTES))
def q_utility_ranking_messages(spark, sf):
    u = utility_inputs(spark, sf)
    return explode_messages(u.select("query_id", P.utility_ranking_messages(
        F.col("query"), F.col("passages"), F.col("answer")).alias("messages")))


@register("render_chat", sql(
    "SELECT query_id, string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10), '' "
    "ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS prompt FROM msgs GROUP BY query_id",
    extra=[FP_CTE, QX_CTE, ("msgs", d_messages(
        [("user", d_lit(P.RELEVANCE_SYSTEM)), ("assistant", d_lit(P.RELEVANCE_ACK)),
         ("user", d_fill(P.RELEVANCE_TASK, num="num", query="query")), ("assistant", d_lit(P.RELEVANCE_READY))],
        d_fill(P.RELEVANCE_POST, query="query", instruct=d_lit(P.RELEVANCE_INSTRUCT)), "fp_all"))]))
def q_render_chat(spark, sf):
    c = formatted_candidates(spark, sf)
    return c.select("query_id", P.render_chat(P.relevance_messages(F.col("query"), F.col("passages"))).alias("prompt"))


# ---- reply parsing -------------------------------------------------------------
@register("parse_ranking", sql(
    "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first_at) - 1 AS BIGINT) AS rank, "
    "n AS pos, passages_ids[n + 1] AS docid FROM ("
    "SELECT query_id, passages_ids, n, min(i) AS first_at FROM ("
    "SELECT query_id, passages_ids, unnest(nums) AS n, generate_subscripts(nums, 1) AS i FROM ("
    "SELECT query_id, passages_ids, list_transform(regexp_extract_all(utility_ranking, '\\[([0-9]+)\\]', 1), "
    "lambda x: TRY_CAST(x AS BIGINT) - 1) AS nums FROM fx_rank_reply)) "
    "WHERE n >= 0 AND n < len(passages_ids) GROUP BY query_id, passages_ids, n)"))
def q_parse_ranking(spark, sf):
    r = fx.fx_rank_reply(spark, sf)
    order, ids = R.parse_ranking("utility_ranking", "passages_ids")
    p = r.select("query_id", F.arrays_zip(order.alias("o"), ids.alias("d")).alias("z"))
    return p.select("query_id", F.posexplode("z").alias("rank", "x")).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), F.col("x.o").alias("pos"), F.col("x.d").alias("docid"))


PERM_DEPTH = 20


def perm_inputs(spark, sf):
    run = write_once(fx.fx_run(spark, sf, PERM_DEPTH), "permutation-run")  # read several times, searched once
    hits = run.select("qid", (F.col("rank") - 1).cast("bigint").alias("slot"), "pid",
                      F.col("rank").cast("bigint").alias("rank"), "score")
    g = run.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("pid")).alias("k"), F.col("rank")))).alias("s"))
    r = F.array_join(F.transform("s", lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("]"))), " > ")
    q = F.col("qid")
    replies = g.select("qid", fx._quirk(q, r, (F.concat(r, F.lit(" [0]")), F.concat(r, F.lit(" [99]")),
                                               F.concat(r, F.lit(" "), r), F.concat(F.lit("top5: "), r))).alias("reply"))
    return hits, replies


@register("apply_permutation", sql(
    "SELECT h.qid, h.slot, coalesce(m.pid, h.pid) AS pid, h.rank, round(h.score, 6) AS score "
    "FROM hits h LEFT JOIN moved m ON m.qid = h.qid AND m.slot = h.slot",
    extra=[("run20", "SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank, score "
                     f"FROM fx_scores QUALIFY rank <= {PERM_DEPTH}"),
           ("hits", "SELECT qid, CAST(rank - 1 AS BIGINT) AS slot, pid, CAST(rank AS BIGINT) AS rank, score FROM run20"),
           ("rep0", "SELECT qid, string_agg('[' || rank || ']', ' > ' ORDER BY pid DESC) AS r FROM run20 GROUP BY qid"),
           ("rep", "SELECT qid, CASE qid % 5 WHEN 0 THEN r WHEN 1 THEN r || ' [0]' WHEN 2 THEN r || ' [99]' "
                   "WHEN 3 THEN r || ' ' || r ELSE 'top5: ' || r END AS reply FROM rep0"),
           ("m", "SELECT qid, count(*) AS m FROM hits GROUP BY qid"),
           ("nums", "SELECT r.qid, m.m, unnest(list_transform(regexp_extract_all(r.reply, '[0-9]+'), "
                    "lambda x: TRY_CAST(x AS BIGINT) - 1)) AS x, generate_subscripts(regexp_extract_all(r.reply, '[0-9]+'), 1) AS i "
                    "FROM rep r JOIN m USING (qid)"),
           ("valid", "SELECT qid, m, x, min(i) AS i FROM nums WHERE x >= 0 AND x < m GROUP BY qid, m, x"),
           ("vpos", "SELECT qid, x, row_number() OVER (PARTITION BY qid ORDER BY i) - 1 AS j FROM valid"),
           ("nvalid", "SELECT qid, count(*) AS nv FROM valid GROUP BY qid"),
           ("missing", "SELECT h.qid, h.slot AS x, coalesce(n.nv, 0) + row_number() OVER (PARTITION BY h.qid ORDER BY h.slot) - 1 AS j "
                       "FROM hits h LEFT JOIN nvalid n USING (qid) WHERE NOT EXISTS (SELECT 1 FROM valid v WHERE v.qid = h.qid AND v.x = h.slot)"),
           ("perm", "SELECT qid, x, j FROM vpos UNION ALL SELECT qid, x, j FROM missing"),
           ("moved", "SELECT p.qid, p.j AS slot, h.pid FROM perm p JOIN hits h ON h.qid = p.qid AND h.slot = p.x")]))
def q_apply_permutation(spark, sf):
    hits, replies = perm_inputs(spark, sf)
    out = R.apply_permutation(hits, replies, 0, 100, moved=("pid",))
    return out.select("qid", "slot", "pid", "rank", F.round("score", 6).alias("score"))


@register("permute_records", sql(
    "SELECT query_id, side, CAST(row_number() OVER (PARTITION BY query_id, side ORDER BY "
    "md5(concat_ws('|', '0', query_id, side, pos, docid))) - 1 AS BIGINT) AS new_pos, docid FROM ("
    "SELECT query_id, CASE WHEN relevance_score = 1 THEN 'positive' ELSE 'negative' END AS side, "
    "row_number() OVER (PARTITION BY query_id, relevance_score ORDER BY pos) - 1 AS pos, docid FROM fx_labels)"))
def q_permute_records(spark, sf):
    lab = fx.fx_labels(spark, sf).withColumn(
        "side", F.when(F.col("relevance_score") == 1, "positive").otherwise("negative"))
    w = Window.partitionBy("query_id", "side").orderBy("pos")
    items = lab.select("query_id", "side", (F.row_number().over(w) - 1).alias("pos"), "docid")
    return R.permute_records(items, seed=0).select("query_id", "side", "new_pos", "docid")


@register("set_ops", sql(
    "SELECT query_id, 'concat' AS op, string_agg(CAST(d AS VARCHAR), ',' ORDER BY o) AS items FROM ("
    "SELECT query_id, docid AS d, pos AS o FROM fx_labels UNION ALL "
    "SELECT query_id, docid, 1000 + pos FROM fx_labels WHERE relevance_score = 1 OR pos >= 8) GROUP BY query_id "
    "UNION ALL SELECT query_id, 'intersect', string_agg(CAST(docid AS VARCHAR), ',' ORDER BY pos) FILTER "
    "(WHERE relevance_score = 1 OR pos >= 8) FROM fx_labels GROUP BY query_id "
    "UNION ALL SELECT query_id, 'except', string_agg(CAST(docid AS VARCHAR), ',' ORDER BY pos) FILTER "
    "(WHERE NOT (relevance_score = 1 OR pos >= 8)) FROM fx_labels GROUP BY query_id "
    "UNION ALL SELECT query_id, 'distinct', string_agg(CAST(docid AS VARCHAR), ',' ORDER BY pos) FROM fx_labels GROUP BY query_id"))
def q_set_ops(spark, sf):
    """Bag union (concat), intersection, difference and order-preserving distinct of two
    per-query lists: all candidates (A) and the positives plus the back half (B)."""
    lab = fx.fx_labels(spark, sf)
    g = lab.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "docid"))).alias("a"),
        F.array_sort(F.collect_list(F.when((F.col("relevance_score") == 1) | (F.col("pos") >= 8),
                                           F.struct("pos", "docid")))).alias("b"))
    a = F.transform("a", lambda x: x["docid"])
    b = F.transform("b", lambda x: x["docid"])
    j = lambda arr: F.array_join(F.transform(arr, lambda x: x.cast("string")), ",")
    ops = g.select("query_id", F.array(
        F.struct(F.lit("concat").alias("op"), j(F.concat(a, b)).alias("items")),
        F.struct(F.lit("intersect").alias("op"), j(F.array_intersect(a, b)).alias("items")),
        F.struct(F.lit("except").alias("op"), j(F.array_except(a, b)).alias("items")),
        F.struct(F.lit("distinct").alias("op"), j(F.array_distinct(F.concat(a, b))).alias("items"))).alias("r"))
    out = ops.select("query_id", F.explode("r").alias("x")).select("query_id", F.col("x.op").alias("op"),
                                                                 F.col("x.items").alias("items"))
    return out.withColumn("items", F.when(F.col("items") == "", None).otherwise(F.col("items")))
