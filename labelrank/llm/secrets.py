"""Secret scans through a trigram index; DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived that every match
satisfies (:func:`trigram_query`).  The postings (trigram, document key) of the trigrams that
occur in any query are gathered per document key and the queries are answered from them; only
the candidates are verified with the expression itself.  A rule without a mandatory trigram
(a run of hex digits) scans every text.

Spans are found natively: the pieces between the matches of an expression and the matches
themselves have lengths, whose running sum gives every start in code points.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelrank.llm.components import write_scratch
from labelrank.llm.registry import register
from labelrank.session import table

#: Broadcast the candidates only up to this many rows (16 bytes each); beyond it, shuffle.
BROADCAST_ROWS = 2_000_000


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose group has ``least`` characters or more."""
    kind: str
    pattern: str
    group: int
    least: int


# The base rules, then further common credential formats.
BASE_RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
]
MORE_RULES = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("keyblock", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", 0, 1),
]


def trigram_query(pattern: str, most: int = 64):
    """Boolean query over lower-case trigrams that every text with a match satisfies.

    Returns a list of alternatives per required part: ``[[{trigrams}, ...], ...]`` means that
    for each part all trigrams of one of its alternatives occur.  An empty list: no query."""
    parser = re._parser
    parts: list[list[frozenset]] = []

    def flush(strings):
        sets = [frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings]
        if sets and all(sets):
            least = [s for s in set(sets) if not any(other < s for other in sets)]  # supersets are implied
            parts.append(sorted(least, key=sorted))

    def exact(node):
        """All strings of a node, or None where they are unknown or too many."""
        op, arg = node
        name = str(op)
        if name == "LITERAL":
            return {chr(arg).lower()}
        if name == "IN":
            if all(str(o) == "LITERAL" for o, _ in arg):
                return {chr(a).lower() for _, a in arg}
            return None
        if name == "SUBPATTERN":
            return product(arg[-1])
        if name == "BRANCH":
            found = [product(x) for x in arg[1]]
            return None if any(f is None for f in found) else set().union(*found)
        if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] == 1:
            inner = product(arg[2])
            return None if inner is None else inner | ({""} if arg[0] == 0 else set())
        return None

    def product(nodes):
        out = {""}
        for node in nodes:
            e = exact(node)
            if e is None or len(out) * len(e) > most:
                return None
            out = {a + b for a in out for b in e}
        return out

    strings = {""}
    for node in parser.parse(pattern):
        e = exact(node)
        if e is not None and len(strings) * len(e) <= most:
            strings = {a + b for a in strings for b in e}
            continue
        flush(strings)
        strings = {""} if e is None else e
    flush(strings)
    return parts


def _answer(query, held: Column) -> Column:
    """The query over the set of a document's trigrams."""
    def has(t):
        return F.array_contains(held, F.lit(t))
    return reduce(lambda a, b: a & b, [
        reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [has(t) for t in sorted(alt)])
                                    for alt in part]) for part in query])


def trigram_postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, key) of the wanted trigrams in the lower-cased ``text`` of (key, text)."""
    low = rows.select("key", F.lower("text").alias("low")).filter("low <> ''")
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select(F.explode(present).alias("trigram"), "key")


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Array of (start, rank, kind, end) of the rule's matches."""
    # A run of one character class is maximal, so its least length can be asked for at once.
    whole = re.fullmatch(r"\[[^\]]+\]\+", rule.pattern) is not None
    pattern = rule.pattern[:-1] + f"{{{rule.least},}}" if whole else rule.pattern
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
    rows = F.arrays_zip(found.alias("m"), held.alias("g"), F.split(text, pattern, -1).alias("p"))
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")

    def step(acc, row):
        start = acc["at"] + F.length(row["p"])
        end = start + F.coalesce(F.length(row["m"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"),
                        end.alias("end"))
        ok = row["m"].isNotNull() & (F.length(row["g"]) >= rule.least)
        return F.struct(end.alias("at"), F.when(ok, F.concat(acc["out"], F.array(span)))
                        .otherwise(acc["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    spans = F.aggregate(rows, first, step, lambda acc: acc["out"])
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(empty)


def scan_secrets(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None,
                 name: str = "secret_spans") -> DataFrame:
    """Adds the spans of secrets: array of (start, rank, kind, end), by start, then rule order.

    Positions are code points, ends exclusive; null and empty texts have no spans.  Every row is
    kept with all its columns, repeated rows and null keys included; whole texts are scanned."""
    rules = BASE_RULES + MORE_RULES if rules is None else rules
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    # The key is a hash of the text: a collision only makes one candidate more.
    keyed = docs.withColumn("__text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    keyed = keyed.withColumn("__key", F.xxhash64("__text"))
    flags = F.lit(0)
    if queries:
        rows = keyed.select(F.col("__key").alias("key"), F.col("__text").alias("text"))
        wanted = sorted({t for q in queries.values() for part in q for alt in part for t in alt})
        held = (trigram_postings(rows, wanted).groupBy("key")
                .agg(F.collect_set("trigram").alias("held")))
        mask = reduce(lambda a, b: a + b, [F.when(_answer(q, F.col("held")), 1 << i).otherwise(0)
                                           for i, q in queries.items()])
        candidates = write_scratch(held.select(F.col("key").alias("__key"), mask.alias("__mask"))
                                   .filter("__mask > 0"), "secret-candidates")
        few = candidates.count() <= BROADCAST_ROWS
        keyed = keyed.join(F.broadcast(candidates) if few else candidates, "__key", "left")
        flags = F.coalesce("__mask", F.lit(0))
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    per_rule = []
    for i, rule in enumerate(rules):
        spans = _spans(F.col("__text"), rule, i)
        per_rule.append(F.when(flags.bitwiseAND(1 << i) > 0, spans).otherwise(empty) if i in queries else spans)
    out = keyed.withColumn(name, F.array_sort(F.concat(*per_rule)))
    return out.drop("__text", "__key", "__mask")


def redact(scanned: DataFrame, text_col: str = "text", spans_col: str = "secret_spans",
           mark: str = "[SECRET]") -> DataFrame:
    """Replaces every span (overlapping ones as one) by ``mark``; null texts stay null."""
    text = F.col(text_col)

    def step(acc, s):
        new = s["start"] >= acc["at"]
        return F.struct(
            F.when(new, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]),
                                 F.lit(mark))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate(F.col(spans_col), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step,
                       lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return scanned.withColumn(text_col, F.when(F.size(spans_col) > 0, done).otherwise(text))


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _oracle() -> str:
    def lit(s):
        return "'" + s.replace("'", "''") + "'"
    per_rule, lists = [], []
    for i, r in enumerate(BASE_RULES + MORE_RULES):
        per_rule.append(
            f"regexp_extract_all(t, {lit(r.pattern)}, 0) AS m{i}, regexp_extract_all(t, {lit(r.pattern)}, {r.group}) AS g{i}, "
            f"regexp_split_to_array(t, {lit(r.pattern)}) AS p{i}")
        lists.append(
            f"list_filter(list_transform(range(1, len(m{i}) + 1), lambda k: {{'s': "
            f"list_sum(list_transform(p{i}[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m{i}[1:k-1], lambda x: length(x))), 0), "
            f"'r': {i}, 'k': '{r.kind}', 'l': length(m{i}[k]), 'g': length(g{i}[k])}}), lambda x: x.g >= {r.least}) AS s{i}")
    n = len(per_rule)
    text = "list_aggregate(list_transform(list_sort({}), lambda x: x.k || ':' || x.s::BIGINT || ':' || (x.s + x.l)::BIGINT), 'string_agg', ',')"
    base = text.format("list_concat(list_concat(s0, s1), s2)")
    every = "s0"
    for i in range(1, n):
        every = f"list_concat({every}, s{i})"
    return (f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), "
            f"m AS (SELECT doc_id, {', '.join(per_rule)} FROM d), s AS (SELECT doc_id, {', '.join(lists)} FROM m) "
            f"SELECT doc_id, len(s0)::BIGINT AS n_assign, len(s1)::BIGINT AS n_access, len(s2)::BIGINT AS n_hex, "
            f"sha256(coalesce({base}, '')) AS base_sha256, coalesce({text.format(every)}, '') AS spans FROM s")


@register("op8_secret_scan", _oracle())
def op8_secret_scan(spark, sf_dir):
    """Secrets in whole ``documents``: counts and digest of the base rules, all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan_secrets(docs)
    spans = F.col("secret_spans")

    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["rank"] < len(BASE_RULES))
    return out.select("doc_id", count("assign"), count("access"), count("hex"),
                      F.sha2(_listed(base), 256).alias("base_sha256"), _listed(spans).alias("spans"))
