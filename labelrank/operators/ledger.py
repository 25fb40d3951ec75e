"""Model replies that survive a restart: a ledger of answered prompts.

A prompt's key is a hash of its text and of a tag that names model and parameters.  Tasks write their
replies in small files as they come, each file complete when it gets its name, so what has been
answered stays answered when a task, an executor or the whole job ends early.  The next run, and a
task that is tried again, send only what the ledger lacks.  A prompt that fails is tried alone, so
it doesn't take its batch with it, and its error is kept beside the replies.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelrank.models import instance
from labelrank.session import arrow_rows, ship_package
from labelrank.sources.storage import file_system

SCHEMA = "key string, reply string, error string"
_ARROW = pa.schema([("key", pa.string()), ("reply", pa.string()), ("error", pa.string())])
#: Replies of one file: what a task that dies can lose at most, besides those on the way.
FLUSH_ROWS = 256
#: Prompts that a worker gets at once, at least; a prompt with its passages is long.
PROMPT_ROWS = 64


class UnansweredPrompts(RuntimeError):
    """Some prompts have no reply; the replies of the others are in the ledger."""


def prompt_key(prompt, tag: str = "") -> Column:
    """Key of a prompt, null for a null prompt."""
    return F.sha2(F.concat(F.lit(tag), F.lit("\x1f"), prompt if isinstance(prompt, Column) else F.col(prompt)), 256)


def _files(fs, inner: str, prefix: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True))
    return [f.path for f in found if f.is_file and f.base_name.startswith(prefix) and f.base_name.endswith(".parquet")]


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """``(key, reply, error, sends)``: one row per prompt that was sent, with its reply if it has one
    (of several, the least), else an error; ``sends`` counts its entries."""
    fs, inner = file_system(path)
    fs.create_dir(inner, recursive=True)
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows.groupBy("key").agg(F.min("reply").alias("reply"), F.min("error").alias("error"), F.count("*").alias("sends"))


def _replies(generator, rows: pd.DataFrame) -> pa.Table:
    """Replies of a batch; where the batch fails, of each prompt by itself."""
    try:
        replies = [None if r is None else str(r) for r in generator.generate(rows)]
        if len(replies) != len(rows):
            raise ValueError(f"{len(replies)} replies to {len(rows)} prompts")
        errors = [None if r is not None else "no reply" for r in replies]
    except Exception as whole:  # the batch is lost, not its prompts
        if len(rows) == 1:
            replies, errors = [None], [f"{type(whole).__name__}: {whole}"]
        else:
            return pa.concat_tables([_replies(generator, rows.iloc[i:i + 1]) for i in range(len(rows))])
    return pa.table([pa.array(list(rows["key"]), pa.string()), pa.array(replies, pa.string()), pa.array(errors, pa.string())], schema=_ARROW)


def answer_into(pending: DataFrame, factory: Callable, path: str, flush_rows: int = FLUSH_ROWS) -> tuple[int, int]:
    """Sends every row of ``pending`` (key, prompt, ...) and writes the replies under ``path``; returns how
    many were answered and how many failed."""
    ship_package(pending.sparkSession)
    run_id = uuid.uuid4().hex

    def send(batches):
        fs, inner = file_system(path)
        mine = f"{run_id}-{TaskContext.get().partitionId():06d}-"
        done = set()  # what an earlier attempt at this task has written
        for name in _files(fs, inner, mine):
            with fs.open_input_file(name) as f:
                done.update(pq.read_table(f, columns=["key"]).column("key").to_pylist())
        generator = instance(factory)
        for batch in batches:
            batch = batch[~batch["key"].isin(done)]
            for at in range(0, len(batch), flush_rows):
                table = _replies(generator, batch.iloc[at:at + flush_rows])
                name = f"{mine}{uuid.uuid4().hex}.parquet"
                with fs.open_output_stream(f"{inner}/_{name}") as f:  # readers pass over names with _
                    pq.write_table(table, f)
                fs.move(f"{inner}/_{name}", f"{inner}/{name}")
                failed = table.column("error").length() - table.column("error").null_count
                yield pd.DataFrame({"answered": [table.num_rows - failed], "failed": [failed]})

    with arrow_rows(pending.sparkSession, max(flush_rows, PROMPT_ROWS)):  # prompts are long: a worker holds few
        sums = pending.mapInPandas(send, "answered long, failed long").agg(F.sum("answered").alias("a"), F.sum("failed").alias("f")).first()
    return sums.a or 0, sums.f or 0


def generate_with_ledger(df: DataFrame, factory: Callable, out_col: str, keep: list[str], ledger: str,
                         context: list[str] | None = None, tag: str = "", flush_rows: int = FLUSH_ROWS,
                         partitions: int | None = None, strict: bool = True) -> DataFrame:
    """``keep`` columns and the reply to ``prompt`` of every row, sending only prompts that ``ledger``
    (a folder) does not answer yet.

    Equal prompts are sent once.  ``context`` columns are shown to the generator and should follow from
    the prompt.  Rows with a null prompt are not sent and get a null reply.  Prompts that failed before
    are sent again.  If some fail now, the job raises :class:`UnansweredPrompts` after all were tried, or
    leaves their replies null where ``strict`` is False.  ``partitions`` tasks send at a time."""
    spark = df.sparkSession
    cols = list(dict.fromkeys(keep + ["prompt"] + (context or [])))
    rows = df.select(*cols, prompt_key("prompt", tag).alias("key"))
    answered = read_ledger(spark, ledger).filter("reply is not null")
    n = partitions or spark.sparkContext.defaultParallelism
    pending = (rows.filter("key is not null").join(answered.select("key"), "key", "left_anti")
               .dropDuplicates(["key"]).repartition(n, "key"))
    _, failed = answer_into(pending, factory, ledger, flush_rows)
    if failed and strict:
        raise UnansweredPrompts(f"{failed} prompts have no reply; all others are in {ledger}")
    replies = read_ledger(spark, ledger).select("key", F.col("reply").alias(out_col))
    return rows.join(replies, "key", "left").select(*keep, out_col)
