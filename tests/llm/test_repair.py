"""Conversation repair against a search over all edits, on conversations of every kind."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from labelrank.llm import repair as R
from tests.llm.helpers import same_as_sql

SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (2 if code == 3 else 1)


def cheapest(rows, faults):
    """Least (cost, audit) over all edits, two insertions in a row allowed."""
    grammar = re.compile("(s?(ua)+)?")
    @cache
    def go(i, last, inserted):
        # ``last`` holds what the grammar needs to know of the initials so far
        best = [(0, "")] if i == len(rows) and grammar.fullmatch(last) else []

        def after(c):
            s = (last + c).replace("uaua", "ua")
            return s if re.fullmatch("s?(ua)*u?", s) else None

        def add(cost, letter, state, j, ins):
            if state is not None:
                rest = go(j, state, ins)
                if rest is not None:
                    best.append((cost + rest[0], letter + rest[1]))

        if inserted < 2:
            for c in "ua":
                add(3, "I", after(c), i, inserted + 1)
        if i < len(rows):
            role, fault = rows[i][2], faults[i]
            add(4, "D", last, i + 1, 0)
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if role[:1] and role[0] in "sua":
                    add(extra, "K", after(role[0]), i + 1, 0)
                for c in "ua":
                    add(3 + extra, "R", after(c), i + 1, 0)
        return min(best) if best else None
    for i in reversed(range(len(rows))):  # ends first: no deep recursion
        for last in ("", "s", "u", "su", "ua", "sua", "uau", "suau"):
            go(i, last, 0)
    return go(0, "", 0)


def expected(original):
    out = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv, *_ in original}
    by_conv = {}
    for row in damaged(original):
        by_conv.setdefault(row[0], []).append(row)
    for conv, rows in by_conv.items():
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in rows:
            body = text.strip(SPACE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen
                          else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(tuple(rows), tuple(faults))
        kept, at = [], iter(rows)
        for letter in audit:
            nxt = "assistant" if kept and kept[-1][0][0] == "u" else "user"
            if letter == "I":
                kept.append((nxt, ""))
            else:
                _, _, role, text = next(at)
                if letter != "D":
                    kept.append((role if letter == "K" else nxt, text))
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                     hashlib.sha256(text.encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def check(spark, rows, block=None, monkeypatch=None):
    if block:
        monkeypatch.setattr(R, "BLOCK", block)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in R.damaged_and_repaired(df).collect()}
    want = expected(rows)
    assert got == want


def some_rows(seed, convs, longest):
    rnd = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rnd.randrange(1, longest)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice([f"Text {t}.", f"text {t}", "again.", "  \n", None, "ü!\t ", f"why {t}?"])
            rows.append((c, t * rnd.choice([1, 1, 2]) if rnd.random() > 0.1 else None, role, text))
    return list({(r[0], r[1]): r for r in rows}.values())


def test_random_conversations(spark):
    check(spark, some_rows(1, 60, 9))


@pytest.mark.parametrize("block", [2, 3])
def test_blocks_of_blocks(spark, monkeypatch, block):
    check(spark, some_rows(block, 12, 30), block, monkeypatch)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 3, "user", "a."), (7, 1, "user", "x."), (7, 1, "user", "x."), (8, 5, "assistant", "long. " * 20_000),
            (9, None, "system", "s."), (9, None, "system", "s."), (10, 2, "assistant", "A."), (10, 2, "user", "B.")]
    check(spark, rows)


def test_sql_agrees(spark):
    rows = [r for r in some_rows(5, 30, 8)]
    df = spark.createDataFrame(rows, SCHEMA)
    same_as_sql(R.damaged_and_repaired(df), R._sql(), conversations=df.toArrow())


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert R.damaged_and_repaired(empty).collect() == []
    rows = spark.createDataFrame([(1, 0, "user", "Q.", 1, "x")], SCHEMA + ", idx int, ckey string")
    edits = R.repair_conversations(rows).collect()
    assert [(e.edit, e.new_role) for e in edits] == [("K", "user"), ("I", "assistant")]


def test_long_conversation_is_cut(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}.") for t in range(2_000)] + [(2, 0, "user", "q.")]
    check(spark, rows)


def test_edges_start_apart():
    """No audit word of an edge is the beginning of another, so digits compare as letters do."""
    words = {R.LETTERS[e[1] >> 3] + R.LETTERS[e[1] & 7] for s in "suaxSUAXd" for e in R.turn_edges(s) if e}
    assert not any(a != b and b.startswith(a) for a in words for b in words)
    assert list(R.LETTERS) == sorted(R.LETTERS)
