"""Tokenise, encode, pool, normalise, project, score in batch, label matrices.

Built-in expressions wherever possible: the stand-in tokenizer and encoder are
pure SQL (hashing), pooling is ``posexplode`` + aggregate, normalisation is an
array expression.  User models run in ``mapInPandas`` (Arrow batches, one
model instance per worker).  The dense projection is a numpy matmul on Arrow
batches with the weight matrix (model-sized, not data-sized) in the closure.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelrank.functions.hashing import hash60, hash60_mod
from labelrank.functions.text import title_sep_join
from labelrank.models import CLS_ID, N_SPECIAL, PAD_ID, SEP_ID, instance
from labelrank.operators.knn import dot
from labelrank.session import ship_package

VOCAB = 30522
BOW_DIM = 64


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hash_token_ids(text, max_length: int | None = 512, vocab: int = VOCAB) -> Column:
    """Stand-in tokenizer: lower-cased non-empty space pieces -> ``md5`` bucket + 3
    (0 pad, 1 CLS, 2 SEP); no special tokens; cut to ``max_length``."""
    toks = F.array_remove(F.split(F.lower(_c(text)), " ", -1), "")
    if max_length:
        toks = F.slice(toks, 1, max_length)  # cut before hashing: only kept tokens are hashed
    return F.transform(toks, lambda t: (F.pmod(hash60(t), F.lit(vocab)) + N_SPECIAL).cast("int"))


def tokenize_corpus(df: DataFrame, id_col: str, text: str = "text", title: str | None = None,
                    use_title: bool = False, sep: str = "[SEP]", max_length: int = 512,
                    tokenizer_factory: Callable | None = None) -> DataFrame:
    """``(id, input_ids)``; the text columns are dropped.  ``tokenizer_factory``
    plugs a real tokenizer (run with ``mapInPandas``), else the hashed stand-in."""
    body = F.col(text)
    if use_title and title:
        body = F.when(F.col(title).isNotNull(), F.concat(F.col(title), F.lit(sep), F.col(text))).otherwise(F.col(text))
    src = df.select(id_col, body.alias("__t"))
    if tokenizer_factory is None:
        return src.select(id_col, hash_token_ids(F.col("__t"), max_length).alias("input_ids"))
    id_type = df.schema[id_col].dataType.simpleString()
    ship_package(df.sparkSession)

    def run(it):
        tok = instance(tokenizer_factory)
        for pdf in it:
            yield pd.DataFrame({id_col: pdf[id_col], "input_ids": tok.encode(pdf["__t"], max_length)})
    return src.mapInPandas(run, f"{id_col} {id_type}, input_ids array<int>")


def tokenize_records(records: DataFrame, query_max: int = 32, passage_max: int = 128, sep: str = "[SEP]",
                     tokenizer_factory: Callable | None = None) -> DataFrame:
    """Training records -> one row per text: (qid, side, pos, docid, input_ids).

    ``records``: (query_id, query, positive_passages, negative_passages) with passages
    of (docid, title, text).  Sides are ``query``, ``positive`` and ``negative``; a
    passage's title and text are joined by the bare separator."""
    def passages(name, side):
        p = records.select(F.col("query_id").alias("qid"), F.posexplode(name).alias("pos", "p"))
        return p.select("qid", F.lit(side).alias("side"), F.col("pos").cast("bigint").alias("pos"),
                        F.col("p.docid").alias("docid"), title_sep_join("p.title", "p.text", sep).alias("text"))

    both = passages("positive_passages", "positive").unionByName(passages("negative_passages", "negative"))
    docid = both.schema["docid"].dataType
    query = records.select(F.col("query_id").alias("qid"), F.lit("query").alias("side"), F.lit(0).cast("bigint").alias("pos"),
                           F.lit(None).cast(docid).alias("docid"), F.col("query").alias("text"))

    def ids(df, limit):
        key = F.struct("qid", "side", "pos", "docid").alias("key")
        t = tokenize_corpus(df.select(key, "text"), "key", "text", max_length=limit, tokenizer_factory=tokenizer_factory)
        return t.select("key.*", "input_ids")

    return ids(query, query_max).unionByName(ids(both, passage_max))


def truncate_tokens(ids, max_length: int) -> Column:
    """``[CLS] + ids[:max_length-2] + [SEP]`` (special tokens count toward the limit)."""
    return F.concat(F.array(F.lit(CLS_ID)), F.slice(_c(ids), 1, max_length - 2), F.array(F.lit(SEP_ID)))


def pad_batch(df: DataFrame, batch: str = "batch_id", ids: str = "input_ids", pad_id: int = PAD_ID) -> DataFrame:
    """Pad every sequence to the longest of its batch; add the attention mask.
    The window is one batch (B*G rows), so it is bounded."""
    w = Window.partitionBy(batch)
    longest = F.max(F.size(ids)).over(w)
    gap = longest - F.size(ids)
    return (df.withColumn("__gap", gap)
            .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.col("__gap"))))
            .withColumn(ids, F.concat(F.col(ids), F.array_repeat(F.lit(pad_id), F.col("__gap"))))
            .drop("__gap"))


def l2_normalize(v, eps: float = 1e-12) -> Column:
    """``v / max(||v||, eps)``."""
    vv = _c(v)
    norm = F.sqrt(F.aggregate(vv, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(vv, lambda x: x.cast("double") / F.greatest(norm, F.lit(eps)))


def hashed_bow_encode(df: DataFrame, id_col: str, text: str = "text", dim: int = BOW_DIM,
                      normalize: bool = True) -> DataFrame:
    """Stand-in encoder in pure SQL: lower-cased non-empty space tokens, bucket
    ``md5(token) mod dim``, counts, L2-normalised.  One aggregation keyed by id;
    the partial aggregate collapses each text inside its own task."""
    toks = df.select(id_col, F.explode_outer(F.array_remove(F.split(F.lower(F.col(text)), " ", -1), "")).alias("__t"))
    toks = toks.withColumn("__b", hash60_mod(dim, F.col("__t")))
    # one pass: dim conditional counts per text (codegen'd; the partial aggregate
    # combines each text inside its own task, so the shuffle is one row per text)
    counts = toks.groupBy(id_col).agg(*[F.count(F.when(F.col("__b") == b, True)).alias(f"__c{b}") for b in range(dim)])
    vec = F.array(*[F.col(f"__c{b}").cast("double") for b in range(dim)])
    return counts.select(id_col, (l2_normalize(vec) if normalize else vec).alias("embedding"))


def batch_encode(df: DataFrame, id_col: str, text: str, encoder_factory: Callable, dim: int) -> DataFrame:
    """User encoder over Arrow batches: ``(id, embedding array<float>)``."""
    id_type = df.schema[id_col].dataType.simpleString()
    ship_package(df.sparkSession)

    def run(it):
        enc = instance(encoder_factory)
        for pdf in it:
            m = np.asarray(enc.encode(pdf[text]), dtype=np.float32)
            yield pd.DataFrame({id_col: pdf[id_col], "embedding": list(m)})
    return df.select(id_col, text).mapInPandas(run, f"{id_col} {id_type}, embedding array<float>")


def pool_cls(tokens: DataFrame, seq: str, pos: str, vec: str) -> DataFrame:
    """First token vector of each sequence: ``min_by(vec, pos)``."""
    return tokens.groupBy(seq).agg(F.min_by(F.col(vec), F.col(pos)).alias(vec))


def pool_mean(tokens: DataFrame, seq: str, vec: str, mask: str | None = None,
              out: str = "embedding") -> DataFrame:
    """Masked mean of token vectors: one row ``(seq, out array<double>)`` per sequence.

    The vectors are exploded and averaged per (sequence, dimension), so a long sequence is
    averaged by partial aggregation; only the dimensions of one vector are collected.
    A sequence whose tokens are all masked has no row."""
    t = tokens if mask is None else tokens.filter(F.col(mask) == 1)
    ex = t.select(seq, F.posexplode(vec).alias("__dim", "__x"))
    mean = ex.groupBy(seq, "__dim").agg(F.avg(F.col("__x").cast("double")).alias("__v"))
    return (mean.groupBy(seq).agg(F.array_sort(F.collect_list(F.struct("__dim", "__v"))).alias("__s"))
            .select(seq, F.transform("__s", lambda s: s["__v"]).alias(out)))


def formula_weights(d_in: int, d_out: int) -> np.ndarray:
    """Stand-in projection weights ``w[i][j] = ((7i + 3j) mod 11 - 5) / 10``."""
    i = np.arange(d_in)[:, None]
    j = np.arange(d_out)[None, :]
    return (((7 * i + 3 * j) % 11) - 5) / 10.0


def linear_project(df: DataFrame, vec: str, weights: np.ndarray, bias: np.ndarray | None = None,
                   out: str = "projected") -> DataFrame:
    """Dense layer ``x @ W + b`` on a vector column (numpy on Arrow batches).
    Tied query/passage projection = the same weights for both sides; untied = two calls."""
    w = np.asarray(weights, dtype=np.float64)
    b = np.zeros(w.shape[1]) if bias is None else np.asarray(bias, dtype=np.float64)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    schema = f"{fields}, `{out}` array<double>"
    ship_package(df.sparkSession)

    def run(it):
        for pdf in it:
            m = np.stack(pdf[vec].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, w.shape[0]))
            pdf[out] = list(m @ w + b)
            yield pdf
    return df.mapInPandas(run, schema)


def in_batch_scores(queries: DataFrame, passages: DataFrame, temperature: float = 1.0,
                    batch: str = "batch_id") -> DataFrame:
    """Every query of a batch against all B*G passages of the batch: ``dot / temperature``.
    ``queries``: (batch_id, q_idx, q_vec); ``passages``: (batch_id, p_idx, p_vec)."""
    j = queries.join(passages, batch)
    return j.select(batch, "q_idx", "p_idx", (dot(F.col("q_vec"), F.col("p_vec")) / F.lit(float(temperature))).alias("score"))


def gather_batches(df: DataFrame, world_size: int, batch_size: int, group_size: int,
                   batch: str = "batch_id") -> DataFrame:
    """Gathers the queries, passages or teacher rows of W devices into global steps: batches
    ``s*W .. s*W+W-1`` form step s, with query and passage indices offset by the device rank.

    Gather both sides before :func:`in_batch_scores`, so that every query of a step meets the
    passages of all its devices: a full step has (W*B) * (W*B*G) scores."""
    rank = F.pmod(F.col(batch), F.lit(world_size))
    out = df.withColumn("q_idx", rank * batch_size + F.col("q_idx")) if "q_idx" in df.columns else df
    out = out.withColumn("p_idx", rank * batch_size * group_size + F.col("p_idx")) if "p_idx" in df.columns else out
    return out.withColumn(batch, F.floor(F.col(batch) / world_size).cast("bigint"))


def label_matrix(scores: DataFrame, group_size: int, teacher: DataFrame | None = None) -> DataFrame:
    """Target of every (query, passage) cell: the teacher score on the query's own
    block ``[i*G, i*G+G-1]`` (0 elsewhere), or 1 at ``i*G`` without a teacher.
    ``teacher``: (batch_id, q_idx, slot, score)."""
    own = F.col("p_idx") - F.col("q_idx") * group_size
    if teacher is None:
        return scores.withColumn("target", (own == 0).cast("double"))
    t = teacher.select("batch_id", "q_idx", F.col("slot").alias("__own"), F.col("score").alias("__t"))
    j = scores.withColumn("__own", own).join(t, ["batch_id", "q_idx", "__own"], "left")
    return j.withColumn("target", F.coalesce(F.col("__t"), F.lit(0.0))).drop("__own", "__t")
