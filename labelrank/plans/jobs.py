"""End-to-end jobs: annotate, rank, build training batches, retrieve, evaluate.

The model call is the only Python boundary (``mapInPandas`` over Arrow
batches, one generator per worker).  Its replies are written to Parquet and
read back before parsing, so a model is never re-run when the plan is reused
or a later stage is recomputed after an executor loss.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelrank.functions import prompts as P
from labelrank.functions import replies as R
from labelrank.functions import text as T
from labelrank.models import generate_in_pandas
from labelrank.operators import sampling as S
from labelrank.operators.lookup import attach_passages, attach_teacher_scores
from labelrank.operators.knn import knn_exact
from labelrank.operators.ledger import PROMPT_ROWS, generate_with_ledger
from labelrank.operators.metrics import TREC_CLI_CUTOFFS, eval_msmarco, eval_trec
from labelrank.operators.ranking import assign_batches, train_order
from labelrank.operators.vectors import pad_batch, tokenize_corpus, truncate_tokens
from labelrank.session import arrow_rows, ship_package
from labelrank.sources import files as io


def batch_generate(df: DataFrame, factory: Callable, out_col: str, keep: list[str],
                   context: list[str] | None = None, materialize: str | None = None,
                   ledger: str | None = None) -> DataFrame:
    """Prompt rows -> reply column.  ``keep`` columns pass through; ``context``
    columns are also shown to the generator (stand-ins use them, models read
    ``prompt``).  With ``materialize`` (a path) the replies are written and read back.
    With ``ledger`` (a folder) prompts that it answers are not sent again, also after a
    restart (:func:`labelrank.operators.ledger.generate_with_ledger`)."""
    ship_package(df.sparkSession)
    if ledger:
        return generate_with_ledger(df, factory, out_col, keep, ledger, context)
    cols = list(dict.fromkeys(keep + ["prompt"] + (context or [])))
    src = df.select(*cols)
    fields = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep)
    out = src.mapInPandas(lambda it: generate_in_pandas(it, factory, out_col, keep), f"{fields}, `{out_col}` string")
    if materialize:
        with arrow_rows(out.sparkSession, PROMPT_ROWS):
            out.write.mode("overwrite").parquet(materialize)
        return out.sparkSession.read.parquet(materialize)
    return out


def formatted(candidates: DataFrame) -> DataFrame:
    """(query_id, query, passages array<struct<docid,title,text>>) -> formatted texts and ids."""
    return candidates.select(
        "query_id", "query",
        F.transform("passages", lambda p: T.format_passage(p["text"], p["title"])).alias("passages"),
        F.transform("passages", lambda p: p["docid"]).alias("passages_ids"))


def _truncated(col="passages"):
    return F.transform(col, lambda p: T.truncate_words(p, P.MAX_WORDS)).alias("passages_trunc")


def annotate_relevance(candidates: DataFrame, factory: Callable, materialize: str | None = None,
                       zero: str = "ignore", strip: bool = False, ledger: str | None = None) -> DataFrame:
    """candidates -> relevance prompt -> generate -> 0/1 ``relevance_score`` per passage."""
    f = formatted(candidates)
    prompts = f.select("query_id", "query", "passages_ids", _truncated(),
                       P.render_chat(P.relevance_messages(F.col("query"), F.col("passages"))).alias("prompt"))
    gen = batch_generate(prompts.withColumnRenamed("passages_trunc", "passages"), factory, "relevance_output",
                         ["query_id", "passages_ids"], ["query", "passages"], materialize, ledger)
    return gen.withColumn("relevance_score", R.parse_selection("relevance_output", "passages_ids", zero, strip))


def annotate_answer(candidates: DataFrame, factory: Callable, materialize: str | None = None, ledger: str | None = None) -> DataFrame:
    """All candidates -> answer prompt -> generate -> reasoning stripped."""
    f = formatted(candidates)
    prompts = f.select("query_id", P.render_chat(P.answer_messages(F.col("query"), F.col("passages"))).alias("prompt"))
    gen = batch_generate(prompts, factory, "answer_output", ["query_id"], None, materialize, ledger)
    return gen.withColumn("answer", T.strip_reasoning("answer_output"))


def annotate_utility(candidates: DataFrame, relevance: DataFrame, answers: DataFrame, factory: Callable,
                     materialize: str | None = None, zero: str = "ignore", strip: bool = False, ledger: str | None = None) -> DataFrame:
    """Relevant passages (ordered) + stripped answer -> utility prompt -> generate -> 0/1 ``utility_score``."""
    f = formatted(candidates)
    lookup = f.select(F.explode(F.arrays_zip("passages_ids", "passages")).alias("z")).select(
        F.col("z.passages_ids").alias("docid"), F.col("z.passages").alias("passage"))
    rel = relevance.select("query_id", T.relevance_filter("passages_ids", "relevance_score").alias("ids"))
    with_p = attach_passages(rel, lookup, ids="ids", key="docid", value="passage", out="passages")
    rows = with_p.join(answers.select("query_id", "answer"), "query_id").join(f.select("query_id", "query"), "query_id")
    prompts = rows.select("query_id", "query", F.col("ids").alias("passages_ids"), _truncated(),
                          P.render_chat(P.utility_messages(F.col("query"), F.col("passages"), F.col("answer"))).alias("prompt"))
    gen = batch_generate(prompts.withColumnRenamed("passages_trunc", "passages"), factory, "utility_output",
                         ["query_id", "passages_ids"], ["query", "passages"], materialize, ledger)
    return gen.withColumn("utility_score", R.parse_selection("utility_output", "passages_ids", zero, strip))


def rank_utility(candidates: DataFrame, answers: DataFrame, factory: Callable,
                 materialize: str | None = None, ledger: str | None = None) -> DataFrame:
    """Listwise utility ranking prompt -> generate -> ``ranking_score``, ``ranked_passage_ids``."""
    f = formatted(candidates).join(answers.select("query_id", "answer"), "query_id")
    prompts = f.select("query_id", "query", "passages_ids", _truncated(),
                       P.render_chat(P.utility_ranking_messages(F.col("query"), F.col("passages"), F.col("answer")))
                       .alias("prompt"))
    gen = batch_generate(prompts.withColumnRenamed("passages_trunc", "passages"), factory, "utility_ranking",
                         ["query_id", "passages_ids"], ["query", "passages"], materialize, ledger)
    order, ids = R.parse_ranking("utility_ranking", "passages_ids")
    return gen.select("*", order.alias("ranking_score"), ids.alias("ranked_passage_ids"))


def export_training_sets(annotations: DataFrame, score_col: str = "relevance_score") -> dict[str, DataFrame]:
    """Parsed 0/1 annotations -> line tables for the positives file (``qid \\t p1,p2``),
    the negatives file and the teacher-score file (``qid did score``).  Queries
    without a positive are dropped (an empty positives line would read as ``['']``)."""
    z = annotations.select("query_id", F.posexplode(F.arrays_zip("passages_ids", score_col)).alias("pos", "z"))
    z = z.select("query_id", "pos", F.col("z.passages_ids").cast("string").alias("docid"),
                 F.col(f"z.{score_col}").alias("s"))
    keep = z.filter(F.col("s") == 1).select("query_id").distinct()
    z = z.join(keep, "query_id", "left_semi")

    def lines(flag):
        g = z.filter(F.col("s") == flag).groupBy("query_id").agg(
            F.array_sort(F.collect_list(F.struct("pos", "docid"))).alias("l"))
        return g.select("query_id", F.col("query_id").cast("string").alias("qid"),
                        F.concat(F.col("query_id").cast("string"), F.lit("\t"),
                                 F.array_join(F.transform("l", lambda x: x["docid"]), ",")).alias("line"))
    teacher = z.select("query_id", F.col("query_id").cast("string").alias("qid"), F.concat_ws(
        " ", F.col("query_id").cast("string"), "docid", F.col("s").cast("double").cast("string")).alias("line"))
    return {"positives": lines(1), "negatives": lines(0), "teacher": teacher}


def build_training(positives: DataFrame, negatives: DataFrame, corpus: DataFrame, docs: DataFrame,
                   teacher: DataFrame | None, qidx: DataFrame, group_size: int = 8, batch_size: int = 4,
                   hard: DataFrame | None = None, seed: int = 42, epoch: int = 0, passage_max_len: int = 128,
                   n_corpus: int | None = None) -> DataFrame:
    """Groups (slot 0 = rotated positive, rest filled from hard ++ negatives) ->
    teacher scores (0.0 default) -> seeded order -> batches -> token ids padded to
    the batch maximum.  Returns (batch_id, q_idx, p_idx, qid, docid, score, input_ids, attention_mask)."""
    if hard is None:
        hard = positives.limit(0)
    groups = S.group_rotate(qidx, positives, hard, negatives, corpus, group_size, 200, seed, epoch, n_corpus=n_corpus)
    groups = attach_teacher_scores(groups, teacher, "qid", "docid", "score")
    order = assign_batches(train_order(qidx, "idx", True, seed, epoch), batch_size)
    g = groups.join(order.select("qid", "batch_id", "q_idx"), "qid") \
        .withColumn("p_idx", (F.col("q_idx") * group_size + F.col("slot")).cast("bigint"))
    toks = tokenize_corpus(docs, "docid", "text", max_length=passage_max_len - 2)
    g = g.join(toks, "docid").withColumn("input_ids", truncate_tokens(F.col("input_ids"), passage_max_len))
    return pad_batch(g)


def write_training_sets(sets: dict[str, DataFrame], root: str) -> dict[str, str]:
    """Writes the line tables of :func:`export_training_sets`, queries in order; the paths."""
    paths = {}
    for name, df in sets.items():
        paths[name] = f"{root.rstrip('/')}/{name}"
        io.write_lines(df, F.col("line"), paths[name], ["query_id", "line"])
    return paths


def build_training_from_files(spark, paths: dict[str, str], corpus: DataFrame, docs: DataFrame,
                              group_size: int = 8, batch_size: int = 4, seed: int = 42, epoch: int = 0,
                              passage_max_len: int = 128, depth: int = 200,
                              n_corpus: int | None = None) -> DataFrame:
    """:func:`build_training` on the files of :func:`write_training_sets`; ids are strings.

    ``corpus`` (docid, offset) and ``docs`` (docid, text) have string ids.  Query order is the
    line order of the positives file; ``depth`` negatives per query are read."""
    positives = io.read_positives(spark, paths["positives"])
    negatives = io.read_negatives(spark, paths["negatives"], depth)
    teacher = io.read_teacher_scores(spark, paths["teacher"])
    if teacher is not None:
        teacher = teacher.withColumnRenamed("did", "docid")
    return build_training(positives.select("qid", "pos", "docid"), negatives, corpus, docs, teacher,
                          positives.select("qid", "idx").distinct(), group_size, batch_size, None, seed, epoch,
                          passage_max_len, n_corpus)


def retrieve(queries: DataFrame, corpus: DataFrame, encode: Callable, root: str, k: int = 1000) -> DataFrame:
    """Encode queries (qid, text) and corpus (pid, text), search, write the ranking file, read it.

    ``encode(df, id_col)`` returns (id_col, embedding).  Vectors are written before the search,
    so an encoder runs once; their counts size the search."""
    spark = queries.sparkSession
    root = root.rstrip("/")
    sides = {}
    for name, df, key in (("queries", queries, "qid"), ("corpus", corpus, "pid")):
        n = io.write_vectors(encode(df, key), f"{root}/{name}", key)
        sides[name] = (io.read_vectors(spark, f"{root}/{name}").withColumnRenamed("id", key), n)
    (q, nq), (p, np_) = sides["queries"], sides["corpus"]
    run = knn_exact(q, p, k, n_queries=nq, n_passages=np_)
    io.write_ranking(run, f"{root}/ranking")
    return io.read_run(spark, f"{root}/ranking", k)


def evaluate_trec(spark, run_path: str, qrels_path: str, metrics_path: str | None = None,
                  k_values=TREC_CLI_CUTOFFS) -> DataFrame:
    """TREC run file + graded qrels file -> NDCG, MAP, Recall and MRR (optionally written)."""
    run = io.read_run_trec(spark, run_path).select("qid", F.col("docid").alias("pid"), "score")
    qrels = io.read_qrels_trec(spark, qrels_path).withColumnRenamed("docid", "pid")
    m = eval_trec(run, qrels, k_values)
    if metrics_path:
        io.write_metrics(m, metrics_path)
    return m


def evaluate(spark, run_path: str, qrels_path: str, metrics_path: str | None = None) -> DataFrame:
    """Ranking file + qrels file -> MS MARCO metrics (optionally written as text)."""
    m = eval_msmarco(io.read_run(spark, run_path), io.read_qrels(spark, qrels_path))
    if metrics_path:
        io.write_metrics(m, metrics_path)
    return m
