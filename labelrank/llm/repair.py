"""Conversation structure repair: cheapest edits that make turn roles follow ``(s?(ua)+)?``.

The states of the role grammar are the nodes of a DAG with one layer per turn.  What happens at a
turn - an optional inserted turn, then Keep, Rerole or Delete - is one edge.  Its weight is one
integer: the cost stands in the high digits, the audit letters of the edge in two low digits whose
place belongs to the turn (0 pads an edge of one letter and the end).  An edge starts either with I
and a second letter or with another letter alone, so of two audits the first edge that differs
decides, and comparing weights compares cost first, then audits.  Ordinary integer minima decide
everything.  Two insertions with no turn kept between them are never cheapest (leaving both out, or
deleting a lone system turn, costs less), so one insertion before each turn and one at the end do.

A conversation of any length is cut into blocks of ``BLOCK`` turns.  A block gives the least weight
from every state to every state; for the next level it acts as one turn whose digits are the ranks
of its audits.  A conversation is a tree of such blocks, each a small task; only the last step, the
edits in order, passes a conversation through one task, as a stream.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelrank.llm.components import write_scratch
from labelrank.llm.registry import register
from labelrank.operators.ranking import global_index
from labelrank.session import ship_package, table

#: Turns of a block, and blocks of a block of the next level.
BLOCK = 512
COST = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED_COST = 3
LETTERS = ["", "D", "I", "K", "R"]  # a letter's digit is its place
DIGIT = 6  # bits: two letters of three bits, or a rank up to 16
#: State: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn.
STEP = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
NEEDS = ["u", "u", "a", "u"]
STATES = range(4)
ROLE = {"u": "user", "a": "assistant"}
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"


@functools.cache
def turn_edges(symbol: str) -> tuple:
    """Per (state before, state after) the lightest edge (cost, letters as digits) of a turn.

    The symbol is the initial of its role (x: another one), a capital where the text is truncated,
    or d for a turn that must go."""
    out: list = [None] * 16
    for g in STATES:
        inserted = STEP[g][NEEDS[g]]
        for start, cost, first in ((g, 0, ""), (inserted, COST["I"], "I")):
            ways = [(start, COST["D"], "D")]
            if symbol != "d":
                extra = TRUNCATED_COST if symbol.isupper() else 0
                ways.append((STEP[start][NEEDS[start]], COST["R"] + extra, "R"))
                kept = STEP[start].get(symbol.lower())
                if kept is not None:
                    ways.append((kept, COST["K"] + extra, "K"))
            for end, c, letter in ways:
                word = (first + letter).ljust(2)
                edge = (cost + c, LETTERS.index(word[0]) * 8 + LETTERS.index(word[1].strip()))
                if out[g * 4 + end] is None or edge < out[g * 4 + end]:
                    out[g * 4 + end] = edge
    return tuple(out)


def lightest_paths(items: list[tuple]) -> list:
    """Per (state before, state after) of a block: (cost, rank of its audit, entry per item) or None.

    An item holds per (state before, state after) an edge (cost, digit) or None."""
    m = len(items)
    high = DIGIT * m
    found: dict[int, tuple] = {}
    for g0 in STATES:
        best = {g0: 0}
        for i, item in enumerate(items):
            place, after = DIGIT * (m - 1 - i), {}
            for g, weight in best.items():
                for h in STATES:
                    edge = item[g * 4 + h]
                    if edge is not None:
                        w = weight + (edge[0] << high) + (edge[1] << place)
                        if h not in after or w < after[h]:
                            after[h] = w
            best = after
        for h, weight in best.items():
            g, path = g0, bytearray()
            for i, item in enumerate(items):  # state and digit determine the next state
                digit = weight >> (DIGIT * (m - 1 - i)) & 63
                g = next(x for x in STATES if item[g * 4 + x] is not None and item[g * 4 + x][1] == digit)
                path.append((path[-1] % 4 if path else g0) * 4 + g)
            found[g0 * 4 + h] = (weight >> high, weight & ((1 << high) - 1), bytes(path))
    ranks = {d: r for r, d in enumerate(sorted({x[1] for x in found.values()}), 1)}
    return [(found[e][0], ranks[found[e][1]], found[e][2]) if e in found else None for e in range(16)]


@functools.lru_cache(maxsize=20_000)
def _turn_block(symbols: str) -> list:
    return lightest_paths([turn_edges(s) for s in symbols])


def _closing(edges) -> int:
    """Entry from state 0 that the end makes lightest; after a user turn an insertion closes it."""
    ends = {0: (0, 0), 3: (0, 0), 2: (COST["I"], LETTERS.index("I"))}
    return min((edges[h][0] + c, edges[h][1], digit, h) for h, (c, digit) in ends.items() if edges[h] is not None)[-1]


_NODE = "costs array<long>, ranks array<int>, paths array<binary>"


def _node_columns(nodes: list[list]) -> list[pa.Array]:
    return [pa.array([[e[0] if e else None for e in n] for n in nodes], pa.list_(pa.int64())),
            pa.array([[e[1] if e else None for e in n] for n in nodes], pa.list_(pa.int32())),
            pa.array([[e[2] if e else None for e in n] for n in nodes], pa.list_(pa.binary()))]


def _turn_blocks(batches):
    for batch in batches:
        nodes = [_turn_block(s) for s in batch.column("symbols").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("ckey", "b", "first", "symbols")] + _node_columns(nodes),
            ["ckey", "b", "first", "symbols", "costs", "ranks", "paths"])


def _upper_blocks(batches):
    for batch in batches:
        nodes = []
        for children in batch.column("children").to_pylist():
            nodes.append(lightest_paths([tuple(None if c is None else (c, r) for c, r in zip(x["costs"], x["ranks"]))
                                         for x in children]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("ckey"), batch.column("b"), pa.array([[x["b"] for x in c] for c in batch.column("children").to_pylist()],
                                                               pa.list_(pa.int64()))] + _node_columns(nodes),
            ["ckey", "b", "below", "costs", "ranks", "paths"])


def _closings(batches):
    for batch in batches:
        entry = [_closing([None if c is None else (c, r) for c, r in zip(cs, rs)])
                 for cs, rs in zip(batch.column("costs").to_pylist(), batch.column("ranks").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("ckey"), batch.column("b"), pa.array(entry, pa.int32())],
                                         ["ckey", "b", "entry"])


def block_choices(turns: DataFrame, rows: int) -> DataFrame:
    """``(ckey, first, symbols, path)`` of every block of turns: the chosen entry of each turn.

    ``turns`` holds (ckey, idx, symbol), numbered by idx over all conversations, ``rows`` of them.
    Going up, blocks of a conversation join until one is left (log of ``rows`` to the base BLOCK
    levels); going down, each names the entries of its parts."""
    item = F.struct("idx", "symbol")
    leaves = write_scratch(
        turns.withColumn("b", F.expr(f"idx div {BLOCK}")).groupBy("ckey", "b")
        .agg(F.min("idx").alias("first"), F.array_sort(F.collect_list(item)).alias("items"))
        .select("ckey", "b", "first", F.array_join(F.col("items.symbol"), "").alias("symbols"))
        .mapInArrow(_turn_blocks, f"ckey string, b long, first long, symbols string, {_NODE}"), "repair-leaves")
    levels, count = [leaves], -(-rows // BLOCK)
    while count > 1:
        count = -(-count // BLOCK)
        below = levels[-1].select("ckey", F.expr(f"b div {BLOCK}").alias("b"), F.struct("b", "costs", "ranks").alias("child"))
        levels.append(write_scratch(
            below.groupBy("ckey", "b").agg(F.array_sort(F.collect_list("child")).alias("children"))
            .mapInArrow(_upper_blocks, f"ckey string, b long, below array<long>, {_NODE}"), "repair-blocks"))
    chosen = levels[-1].select("ckey", "b", "costs", "ranks").mapInArrow(_closings, "ckey string, b long, entry int")
    for level in levels[:0:-1]:
        path = (chosen.join(level, ["ckey", "b"])
                .select("ckey", "below", F.hex(F.get("paths", F.col("entry"))).alias("path")))
        part = F.conv(F.substring("path", F.col("at") * 2 + 1, F.lit(2)), 16, 10).cast("int")
        chosen = path.select("ckey", "path", F.posexplode("below").alias("at", "b")).select("ckey", "b", part.alias("entry"))
    return (chosen.join(leaves, ["ckey", "b"])
            .select("ckey", "first", "symbols", F.get("paths", F.col("entry")).alias("path")))


_EDITS = "position long, edit string, turn long, role string, text string, fault string, new_role string"
_FIELDS = [f.split()[0] for f in _EDITS.split(", ")]
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]


def _edit_stream(batches):
    """Edits in order, from rows sorted by conversation: a block's choices come before its turns."""
    key, conv, state, at, words = None, None, 0, 0, iter(())

    def closing(out):
        if state == 2:
            out.append((conv, at, "I", None, None, None, None, ROLE["a"]))

    id_type = None
    for batch in batches:
        id_type, out = batch.schema.field("conv").type, []
        for row in batch.to_pylist():
            if row["ckey"] != key:
                closing(out)
                key, conv, state, at = row["ckey"], row["conv"], 0, 0
            if row["path"] is not None:
                words = iter([turn_edges(s)[e][1] for s, e in zip(row["symbols"], row["path"])])
                continue
            conv, word = row["conv"], next(words)
            letters = LETTERS[word >> 3] + LETTERS[word & 7]
            for letter in letters:
                role = None
                if letter in "IR":
                    role = ROLE[NEEDS[state]]
                elif letter == "K":
                    role = row["role"]
                if role is not None:
                    state = STEP[state][role[0]]
                kept = letter != "I"
                out.append((conv, at, letter, *((row["turn"], row["role"], row["text"], row["fault"]) if kept else (None,) * 4), role))
                at += 1
        yield _edit_batch(out, id_type)
    if id_type is not None:
        out = []
        closing(out)
        yield _edit_batch(out, id_type)


def _edit_batch(out, id_type):
    columns = list(zip(*out)) or [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [id_type, *_TYPES])], ["conv", *_FIELDS])


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every edit of every conversation: ``(conv, position, edit, turn, role, text, fault, new_role)``.

    ``edit`` is K, R, D or I; ``new_role`` is null for deleted turns; turn, role, text and fault are
    null for inserted ones, whose text is empty.  Turns are taken by ``turn`` (nulls first), those of
    one turn by role and by the hash of the text.  ``fault`` is the first that holds: blank (nothing
    but white space), duplicate (role and text of an earlier turn of the conversation) or truncated
    (its last character that is no white space is none of ``.!?``), else empty.  The edits are the
    cheapest, ties with the least audit string in ASCII order.  Null roles and texts count as one
    space; an empty role has no initial, so it can't be kept.  Null ids are one conversation.  The
    rows of the result lie together by conversation and in order of position.  Other columns are
    ignored; an empty table gives no rows.  A repeated row is a duplicate.
    """
    spark = rows.sparkSession
    ship_package(spark)

    def text_of(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    src = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                      text_of(role_col).alias("role"), text_of(text_col).alias("text"))
    src = src.select("*", F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")).alias("ckey"),
                     F.sha2("text", 256).alias("hash"))
    ordered = global_index(src, ["ckey", "turn", "role", "hash"], "idx")
    first = ordered.groupBy("ckey", "role", "hash").agg(F.min("idx").alias("first_idx"))
    initial = F.substring("role", 1, 1)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    keys = (ordered.select("ckey", "role", "hash", "idx", blank.alias("blank"), cut.alias("cut"))
            .join(first, ["ckey", "role", "hash"])
            .withColumn("fault", F.when(F.col("blank"), BLANK).when(F.col("idx") > F.col("first_idx"), DUPLICATE)
                        .when(F.col("cut"), TRUNCATED).otherwise("")))
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    keys = write_scratch(keys.select(
        "ckey", "idx", "fault", F.when(F.col("fault").isin(BLANK, DUPLICATE), "d")
        .when(F.col("fault") == TRUNCATED, F.upper(letter)).otherwise(letter).alias("symbol")), "repair-turns")
    choices = block_choices(keys.select("ckey", "idx", "symbol"), keys.count())
    # A fault travels in its symbol, but d stands for two: blank ones are told by the text.
    none = F.lit(None)
    turns = ordered.select(
        "ckey", "idx", F.lit(1).alias("kind"), "conv", "turn", "role", "text",
        none.cast("string").alias("symbols"), none.cast("binary").alias("path"))
    heads = choices.select(
        "ckey", F.col("first").alias("idx"), F.lit(0).alias("kind"), none.cast(src.schema["conv"].dataType).alias("conv"),
        none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"),
        "symbols", "path")
    faults = {"s": "", "u": "", "a": "", "x": "", "S": TRUNCATED, "U": TRUNCATED, "A": TRUNCATED, "X": TRUNCATED}
    space = " \t\n\x0b\x0c\r"

    def run(batches):
        def with_faults():
            symbols = iter(())
            for batch in batches:
                found = []
                for path, names, text in zip(batch.column("path"), batch.column("symbols"), batch.column("text")):
                    if path.is_valid:
                        symbols = iter(names.as_py())
                        found.append(None)
                    else:
                        s = next(symbols)
                        found.append(faults[s] if s != "d" else DUPLICATE if text.as_py().strip(space) else BLANK)
                yield batch.append_column("fault", pa.array(found, pa.string()))
        return _edit_stream(with_faults())

    conv_type = src.schema["conv"].dataType.simpleString()
    return (turns.unionByName(heads).repartition("ckey").sortWithinPartitions("ckey", "idx", "kind")
            .mapInArrow(run, f"conv {conv_type}, {_EDITS}"))


DIGESTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = ("su", "ua", "au")


def repair_digests(edits: DataFrame) -> DataFrame:
    """Per conversation of :func:`repair_conversations`: gaps between turns, faults by kind, illegal
    neighbours, cost, audit and the digest of the repaired turns.

    A conversation is read as a stream in one task, as a digest over all its texts needs; only the
    audit, one letter per edit, is held."""
    fields = [f.split()[0] for f in DIGESTS.split(", ")]
    conv_type = edits.schema["conv"].dataType.simpleString()

    class Tally:
        def __init__(self, conv):
            self.conv, self.audit, self.cost, self.illegal = conv, bytearray(), 0, 0
            self.faults = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0}
            self.low = self.last = self.initial = None
            self.turns, self.digest, self.kept = 0, hashlib.sha256(), 0

        def add(self, r):
            edit = r["edit"]
            self.audit += edit.encode()
            self.cost += COST[edit]
            if edit != "I":
                if r["fault"]:
                    self.faults[r["fault"]] += 1
                    if r["fault"] == TRUNCATED and edit != "D":
                        self.cost += TRUNCATED_COST
                if self.initial is not None and self.initial + r["role"][:1] not in LEGAL:
                    self.illegal += 1
                self.initial = r["role"][:1]
                if r["turn"] is not None and r["turn"] != self.last:
                    self.low = r["turn"] if self.low is None else self.low
                    self.last, self.turns = r["turn"], self.turns + 1
            if edit != "D":
                line = f"{r['new_role']}:{r['text'] if edit != 'I' else ''}"
                self.digest.update((("\n" if self.kept else "") + line).encode())
                self.kept += 1

        def row(self):
            gaps = self.last - self.low + 1 - self.turns if self.turns else 0
            return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, self.audit.decode(), self.digest.hexdigest())

    def run(batches):
        now, id_type = None, None
        for batch in batches:
            id_type, out = batch.schema.field("conv").type, []
            for r in batch.to_pylist():
                if now is None or r["position"] == 0:
                    if now is not None:
                        out.append(now.row())
                    now = Tally(r["conv"])
                now.add(r)
            yield digest_batch(out, id_type)
        if now is not None:
            yield digest_batch([now.row()], id_type)

    def digest_batch(out, id_type):
        columns = list(zip(*out)) or [()] * (len(fields) + 1)
        types = [id_type] + [pa.int64()] * 6 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv", *fields])

    return edits.mapInArrow(run, f"conv {conv_type}, {DIGESTS}")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that op11's contract puts in, by ``crc32(conv_id:turn) % 20``; nulls of
    any of the four columns count as one space there, null turns and ids stay null."""
    def filled(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    code = F.crc32(F.concat_ws(":", filled("conv_id"), filled("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"),
                                code.alias("code")).filter("code <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """Digest columns of every conv_id of ``conversations`` after :func:`damage` and repair."""
    done = repair_digests(repair_conversations(damage(conversations))).withColumnRenamed("conv", "conv_id")
    every = conversations.select("conv_id").distinct().toDF("original")
    out = every.join(done, F.col("original").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("original").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _sql() -> str:
    """The same in SQL: the least of strings (cost, audit) per grammar state, turn after turn."""
    def add(state, cost, letters):
        return f"lpad(((({state})[1:9])::BIGINT + {cost})::VARCHAR, 9, '0') || ({state})[10:] || '{letters}'"

    def after(end):
        ways = []
        for before in ([(f"v{g}", g, "") for g in STATES] + [("i2", 2, "I"), ("i3", 3, "I")]):
            state, g, _ = before
            if g == end:
                ways.append(add(state, 4, "D"))
            if STEP[g][NEEDS[g]] == end:
                ways.append(f"CASE WHEN NOT gone THEN {add(state, '3 + extra', 'R')} END")
            ways += [f"CASE WHEN NOT gone AND initial = '{c}' THEN {add(state, 'extra', 'K')} END" for c, h in STEP[g].items() if h == end]
        return f"least({', '.join(ways)})"

    user = f"least({add('v0', 3, 'I')}, {add('v1', 3, 'I')}, {add('v3', 3, 'I')})"
    return f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i::UBIGINT, 0, 1, 2, 3, 4, 5, 6, 7],
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS tab),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
coded AS (SELECT src.*, xor(4294967295::UBIGINT, list_reduce(list_concat([4294967295::UBIGINT],
    list_transform(range(1, strlen(k) + 1), lambda i: ascii(k[i])::UBIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255)::BIGINT + 1]))) % 20 AS code FROM src, tab),
dam AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM coded WHERE code <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM dam),
flt AS (SELECT *, role[1:1] AS initial, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
    lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1:1] AS pair FROM num),
sym AS (SELECT conv_id, i, initial, fault IN ('blank', 'duplicate') AS gone,
    CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM flt),
dp AS (SELECT conv_id, 0::BIGINT AS i, '000000000' AS v0, NULL::VARCHAR AS v1, NULL::VARCHAR AS v2, NULL::VARCHAR AS v3
    FROM (SELECT DISTINCT conv_id FROM num)
  UNION ALL SELECT conv_id, i, {", ".join(f"{after(g)} AS v{g}" for g in STATES)} FROM (
    SELECT s.*, v0, v1, v2, v3, {user} AS i2, {add("v2", 3, "I")} AS i3
    FROM dp JOIN sym s ON s.conv_id IS NOT DISTINCT FROM dp.conv_id AND s.i = dp.i + 1)),
best AS (SELECT conv_id, least(v0, v3, {add("v2", 3, "I")}) AS v
    FROM dp WHERE i = (SELECT max(i) FROM num n WHERE n.conv_id IS NOT DISTINCT FROM dp.conv_id)),
word AS (SELECT conv_id, unnest(regexp_extract_all(v[10:], 'I?[DKR]|I')) AS w,
    generate_subscripts(regexp_extract_all(v[10:], 'I?[DKR]|I'), 1) AS i FROM best),
letter AS (SELECT word.conv_id, word.i, o, w[o] AS letter, role, text FROM (
    SELECT *, unnest(range(1, strlen(w) + 1)) AS o FROM word) word
    LEFT JOIN num ON num.conv_id IS NOT DISTINCT FROM word.conv_id AND num.i = word.i),
kept AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i, o) AS p,
    first_value(letter = 'K' AND role[1:1] = 's') OVER (PARTITION BY conv_id ORDER BY i, o) AS headed
    FROM letter WHERE letter <> 'D'),
line AS (SELECT conv_id, p, CASE WHEN letter = 'K' THEN role
    WHEN (p - CASE WHEN headed THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END AS line FROM kept),
text AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS t FROM line GROUP BY conv_id),
tally AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM flt GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v[1:9]::BIGINT, 0) AS cost,
  coalesce(v[10:], '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN tally ON tally.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN text ON text.conv_id IS NOT DISTINCT FROM c.conv_id"""


@register("op11_conversation_repair", _sql())
def op11_conversation_repair(spark, sf_dir):
    """All of ``conversations``, damaged as stated and repaired."""
    return damaged_and_repaired(table(spark, sf_dir, "conversations"))
