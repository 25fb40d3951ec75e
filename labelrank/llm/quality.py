"""Quality classifier by importance resampling.

Two generative models over hashed n-grams are fitted: of the target (labelled good documents) and
of the raw corpus (all documents).  A document's log weight is the mean, over its n-grams, of the
log ratio of the two models (per hundred n-grams).  Only ratios of a fifth or less count, of
n-grams that labelled bad documents hold more often than chance explains: most n-grams of natural
text are rare, and their ratios are noise.  Documents are sampled by Gumbel top-k: those with the
largest (log weight / temperature + Gumbel noise).  For filtering, k is the number of documents whose
weight exceeds the cut that separates held-out labelled rows best.  A low temperature, a twentieth
of the cut at most, leaves the choice to the weights: a weight of 0 (no n-gram counts against the
document) then lies 20 units of noise above the cut.

N-grams: words (A-Z lower-cased), word beginnings of 4, 6 and 8 bytes, and triples of word shapes
(class of the first and last byte, letter case, length, equal to the word before), so that
shouting, markup and repetition have n-grams of their own.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelrank.llm import kernels as K
from labelrank.llm.components import write_scratch
from labelrank.llm.registry import register
from labelrank.session import ship_package, table

LOG = logging.getLogger(__name__)
U = np.uint64
#: Bytes of the word beginnings that are n-grams.
PREFIXES = (4, 6, 8)
#: Buckets: 2^20 of words, 2^16 of shapes, 2^18 of the beginnings of each length.
BUCKETS = (1 << 20) + (1 << 16) + len(PREFIXES) * (1 << 18)
#: Labelled rows used for fitting and calibration at most (a bounded sample, by hash of the id).
MAX_LABELLED = 50_000
#: Bytes of text that a task works on at a time.
TEXT_BYTES = 1 << 20
#: Pseudo-count of the ratio; least G statistic and greatest log ratio that count.
SHRINK, LEAST_G, MOST_RATIO = 0.5, 15.0, -1.6
#: Weights are per so many n-grams; texts count as this many at least.
PER, LEAST_GRAMS = 100, 20
#: What a share of good rows lost costs against a share of bad rows kept.
GOOD_COST = 2
#: Sampling temperature, and units of noise between a weight of 0 and a cut below 0 at least.
TEMPERATURE, MARGIN = 0.02, 20

_CLASS = np.zeros(256, np.int64)          # 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
for _i, _c in enumerate("!.,?|#$%&*"):     # frequent marks have classes of their own
    _CLASS[ord(_c)] = 5 + _i


def ngram_buckets(part: np.ndarray, offs: np.ndarray):
    """Buckets of all n-grams of a chunk and the document of each."""
    h, wo = K.words(part, offs)
    none = np.zeros(0, np.int64)
    if not len(h):
        return none, none
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(wo))
    solid = ~K.IS_SPACE[part]
    edge = np.zeros(len(part) + 1, dtype=bool)
    edge[offs] = True
    before = np.concatenate([[False], solid[:-1]])
    after = np.concatenate([solid[1:], [False]])
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    kinds = _CLASS[part]
    upper = np.add.reduceat((kinds == 2).astype(np.int64), starts)
    size = ends - starts
    case = np.where(upper == 0, 0, np.where(upper * 2 >= size, 2, 1))
    repeat = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])])
    shape = ((((kinds[starts] * 16 + kinds[ends - 1]) * 3 + case) * 5
              + np.searchsorted([2, 5, 10, 30], size)) * 2 + repeat).astype(U)
    same3 = doc[2:] == doc[:-2]
    p, inv = K._powers(len(part))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(K.TABLES[True][part] * p[:len(part)])])
    grams = [(h + U(1), 20), (((shape[:-2] * U(8192) + shape[1:-1]) * U(8192) + shape[2:] + U(3 << 60))[same3], 16)]
    docs = [doc, doc[2:][same3]]
    for n in PREFIXES:
        long = np.flatnonzero(size > n)
        at = starts[long]
        grams.append(((sums[at + n] - sums[at]) * inv[at] + U(n << 20), 18))
        docs.append(doc[long])
    base, out = 0, []
    for g, bits in grams:  # each kind has buckets of its own
        out.append((K.mix(g) >> U(64 - bits)).astype(np.int64) + base)
        base += 1 << bits
    return np.concatenate(out), np.concatenate(docs)


SLICES = 64
TABLES = ("raw", "target", "good_docs", "bad_docs")


def _counts(rows: DataFrame) -> np.ndarray:
    """Per bucket: n-grams of all rows, n-grams of the target rows (class 1), and documents of
    class 1 and of class 2 that hold it.

    Each task sends the buckets that it met, in slices that are summed apart; the sums have at
    most BUCKETS entries whatever the input."""
    width = -(-BUCKETS // SLICES)

    @K.tidy
    def run(batches):
        total = np.zeros((len(TABLES), BUCKETS), np.int32)
        for batch in batches:
            data, offs = K.text_parts(batch.column("text"))
            kind = batch.column("class").to_numpy()
            for i, j, part, rel in K.chunks(data, offs, TEXT_BYTES):
                b, d = ngram_buckets(part, rel)
                total[0] += np.bincount(b, minlength=BUCKETS).astype(np.int32)
                labelled = kind[i:j][d] > 0
                if labelled.any():
                    b, d = b[labelled], d[labelled]
                    good = kind[i:j][d] == 1
                    total[1] += np.bincount(b[good], minlength=BUCKETS).astype(np.int32)
                    held = np.unique(d * BUCKETS + b)
                    good = kind[i:j][held // BUCKETS] == 1
                    total[2] += np.bincount(held[good] % BUCKETS, minlength=BUCKETS).astype(np.int32)
                    total[3] += np.bincount(held[~good] % BUCKETS, minlength=BUCKETS).astype(np.int32)
        for s in range(SLICES):
            part = total[:, s * width:(s + 1) * width]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), pa.array([at.astype(np.int32).tobytes() + part.ravel()[at].tobytes()], pa.binary())],
                    ["slice", "blob"])

    def add(t: pa.Table) -> pa.Table:
        s = t.column("slice")[0].as_py()
        total = np.zeros(len(TABLES) * (min(BUCKETS, (s + 1) * width) - s * width), np.int64)
        for c in t.column("blob").chunks:
            for b in c:
                at, n = np.frombuffer(b.as_py(), np.int32).reshape(2, -1)
                total[at] += n
        return pa.table({"slice": pa.array([s], pa.int32()), "blob": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((len(TABLES), BUCKETS), np.int64)
    for r in (rows.mapInArrow(run, "slice int, blob binary").groupBy("slice")
              .applyInArrow(add, "slice int, blob binary").collect()):
        part = np.frombuffer(r.blob, np.int64).reshape(len(TABLES), -1)
        out[:, r.slice * width:r.slice * width + part.shape[1]] = part
    return out


def log_ratios(counts: np.ndarray, n_good: int, n_bad: int) -> np.ndarray:
    """Log ratio of target to raw model per bucket, where it counts; else 0.

    It counts where the target has a fifth of the raw model's share or less, and where more of the
    labelled bad documents hold the n-gram than chance explains (G statistic)."""
    raw, target, good, bad = counts.astype(np.float64)
    if not target.sum() or not n_bad:
        return np.zeros(counts.shape[1])
    expected = raw * (target.sum() / max(1, raw.sum()))
    share = n_bad / (n_good + n_bad)
    n = good + bad
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(bad > 0, bad * np.log(bad / (n * share)), 0)
                 + np.where(good > 0, good * np.log(good / (n * (1 - share))), 0))
        ratio = np.log((target + SHRINK) / (expected + SHRINK))
    return np.where((g >= LEAST_G) & (bad > n * share) & (ratio <= MOST_RATIO), ratio, 0.0)


def score(docs: DataFrame, ratios, columns: list[str], text_col: str = "text",
          name: str = "log_weight") -> DataFrame:
    """(columns, log weight) of every row; rows without n-grams have weight 0."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    @K.tidy
    def run(batches):
        table_ = ratios.value
        for batch in batches:
            data, offs = K.text_parts(batch.column(text_col))
            w = np.zeros(len(offs) - 1)
            for i, j, part, rel in K.chunks(data, offs, TEXT_BYTES):
                b, d = ngram_buckets(part, rel)
                n = np.maximum(np.bincount(d, minlength=j - i), LEAST_GRAMS)
                w[i:j] = PER * np.bincount(d, weights=table_[b], minlength=j - i) / n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(w)], [*columns, name])

    return docs.select(*columns, *([] if text_col in columns else [text_col])).mapInArrow(
        run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), f"{name} double"]))


def gumbel(key: Column, seed: int = 42) -> Column:
    """Standard Gumbel noise that depends on the row's key only."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def gumbel_top_k(scored: DataFrame, k: int, id_col: str, weight_col: str = "log_weight",
                 temperature: float = 1.0, seed: int = 42) -> DataFrame:
    """``k`` rows sampled without replacement with probability by weight; ties by id.

    The k-th key is found by counting keys per bin in three rounds (at most 4096 counts each),
    so neither the rows nor the sample pass through one task."""
    keyed = scored.withColumn("gumbel_key", F.col(weight_col) / temperature + gumbel(F.col(id_col), seed))
    if k <= 0:
        return keyed.limit(0)
    keyed = write_scratch(keyed, "gumbel")
    lo, hi, n = keyed.agg(F.min("gumbel_key"), F.max("gumbel_key"), F.count("*")).first()
    if k >= n:
        return keyed
    above = 0
    for _ in range(3):
        step = (hi - lo) / 4096 or 1.0
        b = F.least(F.floor((F.col("gumbel_key") - lo) / step), F.lit(4095))
        counts = dict(map(tuple, keyed.filter(F.col("gumbel_key").between(lo, hi)).groupBy(b).count().collect()))
        for i in sorted(counts, reverse=True):
            if above + counts[i] >= k:
                break
            above += counts[i]
        lo, hi = lo + i * step, min(hi, lo + (i + 1) * step)
    inside = F.col("gumbel_key").between(lo, hi)
    above = keyed.filter(F.col("gumbel_key") > hi).count()
    top = keyed.filter(inside).orderBy(F.col("gumbel_key").desc(), id_col).limit(k - above)
    return keyed.filter(F.col("gumbel_key") > hi).unionByName(top)


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """Cut that maximises GOOD_COST times the share of good rows above it and the share of bad
    rows below it."""
    if not good.any() or good.all():
        return -np.inf
    values = np.unique(weights)
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2])
    g, b = np.sort(weights[good]), np.sort(weights[~good])
    gain = GOOD_COST * (1 - np.searchsorted(g, cuts) / len(g)) + np.searchsorted(b, cuts) / len(b)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(cuts[best[len(best) // 2]])


def quality_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   quality_col: str = "quality", toxic_col: str = "toxic", k: int | None = None,
                   temperature: float = TEMPERATURE, report: dict | None = None) -> DataFrame:
    """The rows of ``docs`` that are sampled, with all their columns and ``log_weight``
    (which replaces a column of that name).

    Labelled documents with quality 1 that are not toxic are the target.  Up to MAX_LABELLED
    labelled documents are used (by hash of the id): four fifths to fit the target model, one
    fifth to choose the cut when ``k`` is not given; ``k`` is then the number of rows whose weight
    exceeds it.  The raw model counts all documents.

    Labels with a null id or quality are ignored; of several labels of an id the worst holds; a
    null toxic label counts as not toxic.  Null and empty texts have weight 0.  Repeated rows are
    weighed alike; without a given ``k``, rows that tie with the k-th key (rows of one id and weight)
    are all kept.  Without labels of both kinds every row is kept; empty tables give no rows."""
    spark = docs.sparkSession
    ship_package(spark)
    lab = (labels.filter(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull())
           .groupBy(F.col(id_col).cast("long").alias("label_id"))
           .agg(F.min(F.when((F.col(quality_col) == 1) & (F.coalesce(F.col(toxic_col), F.lit(0)) == 0), 1)
                      .otherwise(0)).alias("good")))
    n = lab.count()
    hashed = F.pmod(F.xxhash64(F.lit("labelled"), F.col("label_id")), F.lit(1 << 30))
    if n > MAX_LABELLED:
        lab = lab.filter(hashed < int((1 << 30) * 0.97 * MAX_LABELLED / n))
    lab = lab.withColumn("held", F.pmod(F.xxhash64(F.lit("fold"), F.col("label_id")), F.lit(5)) == 0)
    lab = write_scratch(lab, "labelled")
    rows = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).cast("string").alias("text"))
    marked = rows.join(F.broadcast(lab), "label_id", "left")  # bounded by MAX_LABELLED
    fit = lab.filter(~F.col("held")).groupBy("good").count().collect()
    n_class = {r["good"]: r["count"] for r in fit}
    kind = F.when(F.col("held") | F.col("good").isNull(), 0).when(F.col("good") == 1, 1).otherwise(2)
    counts = _counts(marked.select("text", kind.alias("class")))
    ratios = spark.sparkContext.broadcast(log_ratios(counts, n_class.get(1, 0), n_class.get(0, 0)))
    names = [c for c in docs.columns if c != "log_weight"]  # a column of that name is replaced
    full = docs.withColumn("__row_id", F.col(id_col).cast("long"))
    seen = text_col
    if dict(docs.dtypes)[text_col] != "string":
        full, seen = full.withColumn("__text", F.col(text_col).cast("string")), "__text"
    weighed = score(full, ratios, names + ["__row_id"], seen)
    if k is None:
        # one weight per held-out label, about a fifth of MAX_LABELLED
        known = rows.join(F.broadcast(lab.filter("held")), "label_id").select("label_id", "good", "text")
        held = np.array(score(known, ratios, ["label_id", "good"]).groupBy("label_id", "good")
                        .agg(F.min("log_weight").alias("log_weight")).select("log_weight", "good").collect(),
                        dtype=np.float64).reshape(-1, 2)
        cut = best_cut(held[:, 0], held[:, 1] == 1)
        LOG.info("cut %s of %s held-out labels", cut, len(held))
        if report is not None:
            report.update(cut=cut, rows=len(held), good_kept=float((held[held[:, 1] == 1, 0] > cut).mean()),
                          bad_dropped=float((held[held[:, 1] == 0, 0] <= cut).mean()))
        if cut < 0:
            temperature = min(temperature, -cut / MARGIN)
        # The draw works on ids and weights alone; the texts are read again for the rows drawn.
        weights = write_scratch(score(full, ratios, ["__row_id"], seen), "weights")
        k, n = weights.agg(F.count_if(F.col("log_weight") > cut), F.count("*")).first()
        LOG.info("k is %s of %s rows", k, n)
        if k == n:
            return weighed.drop("__row_id")
        edge = gumbel_top_k(weights, k, "__row_id", temperature=temperature).agg(F.min("gumbel_key")).first()[0]
        key = F.col("log_weight") / temperature + gumbel(F.col("__row_id"))
        return weighed.filter(key >= (float("inf") if edge is None else edge)).drop("__row_id")
    return gumbel_top_k(weighed, k, "__row_id", temperature=temperature).drop("__row_id", "gumbel_key")


@register("op3_quality_resampling")
def op3_quality_resampling(spark, sf_dir):
    """Documents that importance resampling keeps, with their log weights."""
    out = quality_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "log_weight")
