"""Chat formatting into budgeted windows; DataFrame functions only.

Prefix sums of the turn tokens place every turn of a conversation on a line.  A window takes the
turns that begin within one stride (budget less history) of it, so windows are aligned to turns
and no turn is cut.  Each later window repeats the system turn and the last turns of the window
before it, as far as they lie within the history limit.  Only assistant turns that are new in a
window are under its loss mask, so every assistant text is a target once.

Template: ``### role: text </turn>\\n`` per turn.  Inside roles and texts a backslash becomes
``\\b``, ``#`` becomes ``\\h``, ``<`` becomes ``\\l`` (and ``:`` in roles ``\\c``), so neither marker
can come from a text and reading back is exact.

The prefix sums are made in two levels (sums per run of turn numbers, then inside the runs), so a
very long conversation is spread over many tasks; only windows, which are bounded by the budget
and the longest turn, are gathered as lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelrank.llm.registry import register
from labelrank.session import table

OPEN, CLOSE = "### ", " </turn>\n"
#: Turn numbers that share one run of the first level.
RUN = 256
ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")]


def escape(c: Column, role: bool = False) -> Column:
    for plain, safe in ESCAPES + ([(":", "\\c")] if role else []):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for plain, safe in [(":", "\\c"), *reversed(ESCAPES)]:
        c = F.replace(c, F.lit(safe), F.lit(plain))
    return c


def token_count(text: Column) -> Column:
    """Tokens of a turn for the budget: pieces between blanks, and four for the markers."""
    return F.size(F.split(text, "[ \t\r\n]+", -1)).cast("long") + 4


def _placed(turns: DataFrame) -> DataFrame:
    """Adds pos (from 0) and the token prefix sums before and after each turn."""
    run = F.floor(F.col("turn") / RUN).alias("run")
    rows = turns.withColumn("run", run).withColumn("tokens", token_count(F.col("text")))
    sums = rows.groupBy("conv", "run").agg(F.sum("tokens").alias("t"), F.count("*").alias("c"))
    before = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy("conv")
    sums = sums.select(F.col("conv").alias("conv2"), F.col("run").alias("run2"),
                       F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"),
                       F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"),
                       F.sum("t").over(total).alias("total"))
    here = Window.partitionBy("conv", "run").orderBy("turn", "role", "text")
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    rows = (rows.withColumn("n", F.row_number().over(here).cast("long"))
            .withColumn("s", F.sum("tokens").over(upto)))
    return (rows.join(sums, F.col("conv").eqNullSafe(F.col("conv2")) & F.col("run").eqNullSafe(F.col("run2")))
            .select("conv", "role", "text", (F.col("c0") + F.col("n") - 1).alias("pos"),
                    (F.col("t0") + F.col("s") - F.col("tokens")).alias("begin"),
                    (F.col("t0") + F.col("s")).alias("finish"), "total"))


def chat_windows(conversations: DataFrame, budget: int = 512, history: int = 128,
                 conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """One row per window: ``(<conv_col>, window, n_repeated, n_new, formatted, loss_spans)``.

    ``loss_spans`` holds (start, end) of the targets in ``formatted``, in code points.  A window
    holds at most ``budget`` tokens, the system turn and the overhang of its last turn besides.
    Turns go by turn number, then role, then text; a null turn number comes first; repeated rows
    are turns of their own; null roles and texts count as empty; a null conversation id is a
    conversation.  Other columns are ignored; an empty table gives no rows.
    """
    stride = budget - history
    if stride <= 0 or history < 0:
        raise ValueError("budget must exceed history, and history must not be negative")
    turns = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    placed = _placed(turns).withColumn("window", F.floor(F.col("begin") / stride))
    system = (placed.filter("role = 'system'").groupBy(F.col("conv").alias("sconv"))
              .agg(F.min(F.struct("pos", "window", "role", "text")).alias("sys")))
    w = Window.partitionBy("conv", "window")
    rows = (placed.join(system.select("sconv", F.col("sys.pos").alias("spos")),
                        F.col("conv").eqNullSafe(F.col("sconv")), "left").drop("sconv")
            .withColumn("next", F.max("finish").over(w)))
    is_system = F.coalesce(F.col("pos") == F.col("spos"), F.lit(False))
    new = rows.select("conv", "window", F.lit(2).alias("part"), "pos", "role", "text")
    repeated = (rows.filter((F.col("next") < F.col("total"))
                            & (F.col("next") - F.col("begin") <= history) & ~is_system)
                .select("conv", F.floor(F.col("next") / stride).alias("window"),
                        F.lit(1).alias("part"), "pos", "role", "text"))
    held = (placed.select("conv", "window").distinct()
            .join(system, (F.col("conv").eqNullSafe(F.col("sconv"))) & (F.col("window") > F.col("sys.window")))
            .select("conv", "window", F.lit(0).alias("part"), "sys.pos", "sys.role", "sys.text"))
    piece = F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(": "),
                     escape(F.col("text")), F.lit(CLOSE))
    target = (F.col("part") == 2) & (F.col("role") == "assistant")
    gathered = (new.unionByName(repeated).unionByName(held)
                .select("conv", "window", F.struct(
                    "part", "pos", piece.alias("piece"), target.alias("target"),
                    (F.length(escape(F.col("role"), role=True)) + len(OPEN) + 2).alias("lead")).alias("p"))
                .groupBy("conv", "window").agg(F.array_sort(F.collect_list("p")).alias("pieces")))

    def step(acc, p):
        end = acc["at"] + F.length(p["piece"])
        span = F.struct((acc["at"] + p["lead"]).alias("start"), (end - len(CLOSE)).alias("end"))
        return F.struct(end.alias("at"), F.when(p["target"], F.concat(acc["out"], F.array(span)))
                        .otherwise(acc["out"]).alias("out"))

    empty = F.array().cast("array<struct<start:int,end:int>>")
    spans = F.aggregate("pieces", F.struct(F.lit(0).alias("at"), empty.alias("out")), step,
                        lambda acc: acc["out"])
    return gathered.select(
        F.col("conv").alias(conv_col), "window",
        F.size(F.filter("pieces", lambda p: p["part"] < 2)).alias("n_repeated"),
        F.size(F.filter("pieces", lambda p: p["part"] == 2)).alias("n_new"),
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        spans.alias("loss_spans"))


def read_windows(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Reads formatted windows back: per window the new turns (role, text) and the target texts."""
    marked = F.split("formatted", CLOSE.replace("/", "\\/"), -1)
    pieces = F.slice(marked, F.col("n_repeated") + 1, F.col("n_new"))

    def turn(p):
        body = F.substring(p, F.lit(len(OPEN) + 1), F.length(p))
        at = F.instr(body, ": ")
        return F.struct(unescape(F.substring(body, F.lit(1), at - 1)).alias("role"),
                        unescape(F.substring(body, at + 2, F.length(body))).alias("text"))

    targets = F.transform("loss_spans", lambda s: unescape(
        F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return windows.select(conv_col, "window", F.transform(pieces, turn).alias("turns"),
                          targets.alias("targets"), F.length("formatted").alias("chars"))


def conversation_digests(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, from the windows read back: turns, targets and their digests."""
    back = read_windows(windows, conv_col).select(
        conv_col, F.size("turns").alias("n"), F.col("chars"), F.struct(
            "window",
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join("targets", "").alias("loss")).alias("w"))
    per = back.groupBy(conv_col).agg(F.sum("n").alias("n_turns"), F.sum(F.col("chars").cast("long")).alias("formatted_chars"),
                                     F.array_sort(F.collect_list("w")).alias("ws"))
    turns = F.array_join(F.transform("ws", lambda w: w["turns"]), "")
    loss = F.array_join(F.transform("ws", lambda w: w["loss"]), "")
    return per.select(conv_col, F.col("n_turns").cast("long").alias("n_turns"),
                      F.sha2(turns, 256).alias("turns_sha256"),
                      F.length(loss).cast("long").alias("loss_chars"),
                      F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


BUDGET, HISTORY = 512, 128
EXTRA_TEXT = "\\### Assistant: </turn> ok"


def _oracle() -> str:
    def esc(c, role):
        out = c
        for plain, safe in ESCAPES + ([(":", "\\c")] if role else []):
            out = f"replace({out}, '{plain}', '{safe}')"
        return out
    stride = BUDGET - HISTORY
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{EXTRA_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{EXTRA_TEXT}'),
t AS (SELECT *, len(regexp_split_to_array(text, '[ \\t\\r\\n]+')) + 4 AS tokens,
  row_number() OVER o AS pos FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos)::BIGINT AS finish,
  sum(tokens) OVER (PARTITION BY conv_id)::BIGINT AS total,
  min(CASE WHEN role = 'system' THEN pos END) OVER (PARTITION BY conv_id) AS spos FROM t),
w AS (SELECT *, finish - tokens AS start, (finish - tokens) // {stride} AS win FROM p),
n AS (SELECT *, max(finish) OVER (PARTITION BY conv_id, win) AS nxt FROM w),
v AS (SELECT *, (SELECT count(DISTINCT x.win) FROM w x WHERE x.conv_id = n.conv_id AND x.win > n.win) AS later FROM n),
l AS (SELECT *, length({esc('role', True)}) + length({esc('text', False)}) + {len(OPEN) + 2 + len(CLOSE)} AS piece,
  CASE WHEN pos = spos THEN later WHEN nxt < total AND nxt - start <= {HISTORY} THEN 1 ELSE 0 END AS repeats FROM v)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(piece * (1 + repeats))::BIGINT AS formatted_chars
FROM l GROUP BY conv_id"""


@register("op2_chat_windows", _oracle())
def op2_chat_windows(spark, sf_dir):
    """All ``conversations`` and one full of control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(EXTRA_TEXT).alias("text"))
    return conversation_digests(chat_windows(turns.unionByName(extra), BUDGET, HISTORY))
