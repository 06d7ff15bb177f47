"""Staged execution: each step's question depends on the answers before it.

All samples run a step together, as one table; the model is a function over batches of prompts.  A step's
result is written to the shared folder before the next begins, which bounds lineage and lets a lost
executor's work be read again.  ``run_incremental`` does the same for what a stream has brought since the
last batch.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.answers import parsed_answer
from ..plans.prompts import with_answers

#: Replies that end a sample.
TERMINAL = ("CONTEXT_OVERFLOW", "CUDA_OOM")
SKIPPED = "SKIPPED_PREVIOUS_FAILURE"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where that is unset, a master inside this process gets a folder of its own and a cluster an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = shared_folder.own = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="loomstone-")
    return top.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder, read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def batches(lengths: list[int], most_rows: int, most_tokens: int, reserve: int = 0) -> list[list[int]]:
    """Row numbers in batches, shortest first: a batch ends before its rows, each padded to its longest, and ``reserve`` for each reply would pass the budget. A row that is too long by itself is a batch of its own. Lengths are in whatever unit the budget is."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        grown = len(out[-1]) + 1 if out else 1
        if out and grown <= most_rows and grown * (lengths[i] + reserve) <= most_tokens:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def guarded(model: Callable[[list[str]], list[str]], prompts: list[str], context: int | None = None, most_rows: int = 32, most_tokens: int = 32_768, length: Callable[[str], int] = len) -> list[str]:
    """Replies of a model: prompts over its context get a sentinel, a batch that runs out of memory is halved, a single prompt that does gets a sentinel.

    ``length`` tells a prompt's size in the unit of ``context`` and ``most_tokens``; unless a model's tokeniser is given these are characters.
    """
    sizes = [length(p) for p in prompts]
    out = [TERMINAL[0] if context and n > context else "" for n in sizes]

    def call(rows: list[int]) -> None:
        try:
            for i, reply in zip(rows, model([prompts[i] for i in rows]), strict=True):
                out[i] = reply
        except MemoryError:
            if len(rows) == 1:
                out[rows[0]] = TERMINAL[1]
            else:
                call(rows[: len(rows) // 2])
                call(rows[len(rows) // 2 :])

    todo = [i for i, o in enumerate(out) if not o]
    for group in batches([sizes[i] for i in todo], most_rows, most_tokens):
        call([todo[g] for g in group])
    return out


def generated(df: DataFrame, model: Callable[[list[str]], list[str]], prompt: str = "prompt", context: int | None = None, length: Callable[[str], int] = len) -> DataFrame:
    """Adds ``raw_answer``, the model's reply to each row's prompt."""
    names = df.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[names].assign(raw_answer=guarded(model, frame[prompt].tolist(), context, length=length))

    return df.mapInPandas(run, f"{kinds}, raw_answer string")


def run_staged(prompts: DataFrame, model: Callable[[list[str]], list[str]], context: int | None = None, done: DataFrame | None = None, parser: Callable = parsed_answer) -> DataFrame:
    """(qid, answers, raw_answers, confidences, status) from ``prompts(qid, step, prompt)``.

    [PPn] in a prompt is filled with the answer of step n.  A reply that can't be parsed counts as no
    answer and the sample goes on; a terminal reply ends it: its later steps are skipped and failed.
    Samples in ``done`` are left out.  ``parser`` makes struct<confidence,answer> of a reply.  Prompts are
    written once, so their evidence isn't joined anew for each step.
    """
    todo = written(prompts if done is None else prompts.join(done.select("qid").distinct(), "qid", "left_anti"), "prompts")
    steps = todo.agg(F.max("step")).first()[0] or 0
    empty = F.array().cast("array<string>")
    state = todo.select("qid").distinct().select("qid", empty.alias("answers"), empty.alias("raw_answers"), empty.alias("confidences"), F.lit("ok").alias("status"))
    for step in range(1, steps + 1):
        here = todo.where(F.col("step") == step).select("qid", "prompt").join(state, "qid")
        live = here.where("status = 'ok'").withColumn("prompt", with_answers(F.col("prompt"), F.col("answers")))
        replied = generated(live, model, context=context).withColumn("p", parser("raw_answer"))
        ended = F.col("raw_answer").isin(*TERMINAL)
        push = lambda c, x: F.concat(F.col(c), F.array(x)).alias(c)
        ran = replied.select("qid", push("answers", F.col("p.answer")), push("raw_answers", F.col("raw_answer")), push("confidences", F.col("p.confidence")), F.when(ended, F.lower("raw_answer")).otherwise(F.col("status")).alias("status"))
        skipped = here.where("status <> 'ok'").select("qid", push("answers", F.lit("None")), push("raw_answers", F.lit(SKIPPED)), push("confidences", F.lit("failed")), "status")
        over = state.join(here.select("qid"), "qid", "left_anti")
        state = written(ran.unionByName(skipped).unionByName(over.select("qid", "answers", "raw_answers", "confidences", "status")), "stage")
    return state


def finished(spark: SparkSession, out_dir: str) -> DataFrame | None:
    """(qid) of the samples that a run's output has; None where there is no output yet."""
    try:
        return spark.read.parquet(out_dir).select("qid").distinct()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def run_incremental(spark: SparkSession, prompt_dir: str, schema: str, out_dir: str, model: Callable[[list[str]], list[str]], checkpoint: str) -> None:
    """Runs every sample that has come into a folder of prompt files since the last run.

    The stream's checkpoint remembers which files have been read, the output which samples are done: a batch leaves out
    what the output has and is added to it in one commit.  So a sample runs once, also when it comes again in a
    later file, when a batch is repeated after a loss, and when the checkpoint is lost.
    """

    def batch(df: DataFrame, number: int) -> None:
        new = df.dropDuplicates(["qid", "step"])
        run_staged(new, model, done=finished(spark, out_dir)).withColumn("batch", F.lit(number)).write.mode("append").partitionBy("batch").parquet(out_dir)

    stream = spark.readStream.schema(schema).json(prompt_dir)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
