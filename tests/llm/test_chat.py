"""Chat windows: reading back, budget, repeated history and targets."""

import hashlib
import random

import pytest

from labelrank.llm import chat

CONTROL = "\\### Assistant: </turn> ok"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int, tokens int")


def digests(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), sha(loss))
    return out


def test_reads_back_what_was_formatted(spark):
    rng = random.Random(3)
    texts = [CONTROL, "", None, "\\", "\\b#<h\\l", "### user: x </turn>\n", "a b\n\tc", "é😀 ü", "word " * 700]
    rows = []
    for conv in [*range(40), None]:
        for t in range(rng.randint(1, 40)):
            rows.append((conv, rng.choice([t, t, t * 300, None]), rng.choice(["user", "assistant", "system", "a: b", None]),
                         rng.choice(texts), 1, 1))
    rows += rows[:3]
    got = chat.conversation_digests(chat.chat_windows(frame(spark, rows), 64, 16)).collect()
    assert {r[0]: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == digests(rows)


def test_windows_keep_budget_history_and_targets(spark):
    rows = [(1, 0, "system", "be brief", 0, 0)]
    rows += [(1, t, "user" if t % 2 else "assistant", f"turn {t} " + "w " * (t % 5), 0, 0) for t in range(1, 60)]
    out = chat.chat_windows(frame(spark, rows), 60, 20).orderBy("window").collect()
    assert len(out) > 5 and sum(r.n_new for r in out) == 60
    for i, r in enumerate(out):
        pieces = r.formatted.split(chat.CLOSE)[:-1]
        assert pieces[0] == "### system: be brief"
        assert r.n_repeated == 0 if i == 0 else r.n_repeated > 1
        if i:  # what is repeated is the end of the window before
            before = out[i - 1].formatted.split(chat.CLOSE)[:-1]
            assert pieces[1:r.n_repeated] == before[len(before) - r.n_repeated + 1:]
        new = [p for p in pieces[r.n_repeated:] if p.startswith("### assistant: ")]
        assert [r.formatted[s.start:s.end] for s in r.loss_spans] == [p[len("### assistant: "):] for p in new]
        assert sum(len(p.split()) + 4 for p in pieces) <= 60 + 3 * 20


def test_empty_table_and_limits(spark):
    assert chat.chat_windows(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        chat.chat_windows(frame(spark, []), 10, 10)
