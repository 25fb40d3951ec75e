"""Generation that survives restarts: what is sent again, what is kept."""

import os

import pandas as pd
import pytest

from labelrank.models import PromptLengthAnswerer
from labelrank.operators import ledger as L
from labelrank.plans import jobs as J

KEEP = ["id"]


class Counting:
    """Answers in capitals and notes every prompt; dies or fails where a marker file says so."""

    def __init__(self, folder):
        self.folder = folder

    def generate(self, batch: pd.DataFrame) -> pd.Series:
        for p in batch["prompt"]:
            if p == "p13" and os.path.exists(f"{self.folder}/die"):
                os._exit(3)
        if "p7" in set(batch["prompt"]) and os.path.exists(f"{self.folder}/fail"):
            raise ValueError("no answer to p7")
        with open(f"{self.folder}/sent", "a") as f:
            f.writelines(f"{p}\n" for p in batch["prompt"])
        return batch["prompt"].str.upper()


def sent(folder):
    path = f"{folder}/sent"
    return sorted(open(path).read().split()) if os.path.exists(path) else []


def prompts(spark, n=40):
    return spark.createDataFrame([(i, f"p{i}") for i in range(n)], "id long, prompt string")


def run(spark, tmp_path, df, **more):
    folder = str(tmp_path)
    return L.generate_with_ledger(df, lambda: Counting(folder), "reply", KEEP, f"{folder}/ledger", partitions=2, flush_rows=4, **more)


def test_a_dead_worker_loses_little(spark, tmp_path):
    df = prompts(spark)
    (tmp_path / "die").touch()
    with pytest.raises(Exception):
        run(spark, tmp_path, df).collect()
    kept = L.read_ledger(spark, f"{tmp_path}/ledger")
    before = {r.key for r in kept.collect()}
    first = sent(tmp_path)
    assert 0 < len(before) < 40
    os.remove(tmp_path / "die")
    os.rename(tmp_path / "sent", tmp_path / "sent-first")
    got = {r.id: r.reply for r in run(spark, tmp_path, df).collect()}
    assert got == {i: f"P{i}" for i in range(40)}
    assert len(sent(tmp_path)) == 40 - len(before)  # the second run sends only what was not answered
    assert len(first) - len(before) <= 2 * 4        # and what the first lost is a file's worth a task
    os.rename(tmp_path / "sent", tmp_path / "sent-second")
    run(spark, tmp_path, df).collect()
    assert sent(tmp_path) == []


def test_one_failing_prompt(spark, tmp_path):
    df = prompts(spark, 20)
    (tmp_path / "fail").touch()
    with pytest.raises(L.UnansweredPrompts, match="1 prompts"):
        run(spark, tmp_path, df)
    assert sent(tmp_path) == sorted(f"p{i}" for i in range(20) if i != 7)
    rows = {r.id: r.reply for r in run(spark, tmp_path, df, strict=False).collect()}
    assert rows == {i: f"P{i}" if i != 7 else None for i in range(20)}
    errors = [r for r in L.read_ledger(spark, f"{tmp_path}/ledger").collect() if r.error]
    assert len(errors) == 1 and errors[0].error == "ValueError: no answer to p7" and errors[0].sends == 2
    os.remove(tmp_path / "fail")
    assert {r.id: r.reply for r in run(spark, tmp_path, df).collect()}[7] == "P7"
    assert len(sent(tmp_path)) == 20


def test_equal_and_null_prompts_and_tags(spark, tmp_path):
    df = spark.createDataFrame([(1, "same"), (2, "same"), (None, "other"), (4, None), (5, "")], "id long, prompt string")
    got = sorted(map(tuple, run(spark, tmp_path, df).collect()), key=str)
    assert got == sorted([(1, "SAME"), (2, "SAME"), (None, "OTHER"), (4, None), (5, "")], key=str)
    assert sent(tmp_path) == ["other", "same"]  # the empty prompt leaves a blank line
    run(spark, tmp_path, df, tag="another model").collect()
    assert sent(tmp_path) == ["other", "other", "same", "same"]
    assert run(spark, tmp_path, df.limit(0)).collect() == []


def test_a_repeated_task_skips_what_it_has_written(spark, tmp_path):
    ledger = str(tmp_path / "l")
    rows = pd.DataFrame({"key": ["a", "b"], "prompt": ["x", "y"]})
    table = L._replies(Counting(str(tmp_path)), rows)
    assert table.column("reply").to_pylist() == ["X", "Y"] and table.column("error").null_count == 2
    assert L.read_ledger(spark, ledger).collect() == []
    open(f"{ledger}/_half-written.parquet", "wb").write(b"PAR1")  # a file without its name yet is no reply
    assert L.read_ledger(spark, ledger).collect() == []


def test_jobs_take_a_ledger(spark, tmp_path):
    passages = "passages array<struct<docid:long,title:string,text:string>>"
    df = spark.createDataFrame([(1, "q", [(1, "t", "x y"), (2, None, "z")])], f"query_id long, query string, {passages}")
    plain = J.annotate_answer(df, PromptLengthAnswerer).collect()
    for _ in range(2):
        assert J.annotate_answer(df, PromptLengthAnswerer, ledger=str(tmp_path / "l")).collect() == plain
    assert [r.sends for r in L.read_ledger(spark, str(tmp_path / "l")).collect()] == [1]
