"""Generation that pays for every answer once: a log of answered batches, read at restart.

A batch is one Spark task, and the log is a Parquet table whose files are moved into place when
their task ends, not when the job does.  Whatever stops a job half-way (a killed driver, lost
executors, a predictor that takes its worker down) loses the batches in flight only; the next
call subtracts what the log has and goes on.  A batch whose predictor raises is written too,
as failed, and tried again in a later attempt; after the last one its rows stay, marked, with
the error.  A file is named by its job and task, so a task that runs twice writes it once.

Log: ``(<keys>, attempt, status, generation, error)`` with status ``ok`` or ``failed``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUND_BATCHES = 10_000  # batches per job
#: Task output counts as soon as the task has ended.
COMMIT_BY_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def log_schema(df: DataFrame, keys: list[str]) -> T.StructType:
    own = [T.StructField(k, df.schema[k].dataType) for k in keys]
    return T.StructType([*own, T.StructField("attempt", T.IntegerType()), T.StructField("status", T.StringType()),
                         T.StructField("generation", T.StringType()), T.StructField("error", T.StringType())])


def read_log(df: DataFrame, keys: list[str], log: str) -> DataFrame:
    """The log as it is now; one that was never written to is empty."""
    spark, schema = df.sparkSession, log_schema(df, keys)
    try:
        return spark.read.schema(schema).parquet(log)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _same(left: str, right: str, keys: list[str]) -> F.Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def _predict_batches(predictor_factory, keys: list[str], attempt: int, batch_size: int):
    """mapInPandas body: a predictor per task, batches of at most ``batch_size`` prompts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = None
        for frame in frames:
            for i in range(0, len(frame), batch_size):
                batch = frame.iloc[i : i + batch_size]
                out = batch[keys].copy()
                out["attempt"], out["status"], out["generation"], out["error"] = attempt, "ok", None, None
                try:
                    predict = predict or predictor_factory()
                    got = predict(batch["_prompt"].fillna("").tolist())
                    if len(got) != len(batch):
                        raise ValueError("predictor must return one output per prompt")
                    out["generation"] = list(got)
                except Exception as e:  # noqa: BLE001  a failed batch is recorded, whatever its reason
                    out["status"], out["error"] = "failed", f"{type(e).__name__}: {e}"[:1000]
                yield out

    return run


def run_attempt(df: DataFrame, predictor_factory, log: str, attempt: int, *, keys: list[str], prompt_col: str, batch_size: int,
                round_batches: int = ROUND_BATCHES) -> None:
    """Ask for every prompt that has no answer yet and has not failed in this attempt, in jobs of
    at most ``round_batches`` batches."""
    prompts = df.select(*keys, F.col(prompt_col).alias("_prompt")).alias("p")
    for turn in count(1):
        settled = read_log(df, keys, log).where((F.col("status") == "ok") | (F.col("attempt") >= attempt)).alias("l")
        todo = prompts.join(settled, _same("p", "l", keys), "left_anti")
        n = todo.count()
        if not n:
            return
        rounds = -(-n // (batch_size * round_batches))
        if rounds > 1:  # about a rounds-th of what is open; the rest is seen again
            todo = todo.where(F.pmod(F.xxhash64(*keys, F.lit(turn)), F.lit(rounds)) == 0)
            n = -(-n // rounds)
        asked = todo.repartition(max(1, -(-n // batch_size)))
        done = asked.mapInPandas(_predict_batches(predictor_factory, keys, attempt, batch_size), log_schema(df, keys))
        done.write.mode("append").options(**COMMIT_BY_TASK).parquet(log)


def generate_logged(df: DataFrame, predictor_factory: Callable[[], Callable[[list[str]], list[str]]], log: str, *, keys=("run_id", "idx"),
                    prompt_col: str = "prompt", batch_size: int = 350, max_attempts: int = 3, round_batches: int = ROUND_BATCHES) -> DataFrame:
    """``df`` with ``generation``, ``status``, ``attempt`` and ``error``; every prompt is answered
    once, across calls with the same ``log`` (a folder that all executors share).

    ``keys`` must identify a row.  Prompts that fail ``max_attempts`` times stay, with status
    ``failed``; a later call with more attempts goes on with them.  The jobs run when this is
    called; the result reads the log, so using it again asks for nothing.  An empty ``df`` gives
    an empty result and no log."""
    keys = list(keys)
    for attempt in range(1, max_attempts + 1):
        run_attempt(df, predictor_factory, log, attempt, keys=keys, prompt_col=prompt_col, batch_size=batch_size, round_batches=round_batches)
    # an answer counts before failures; rows that a restart wrote twice are one
    order = F.struct((F.col("status") != "ok").alias("f"), (F.when(F.col("status") == "ok", 1).otherwise(-1) * F.col("attempt")).alias("a"), "generation", "error")
    best = read_log(df, keys, log).groupBy(*keys).agg(F.min(F.struct(order.alias("o"), "status", "attempt")).alias("b")).alias("l")
    out = df.alias("p").join(best, _same("p", "l", keys), "left")
    return out.select("p.*", F.col("b.o.generation").alias("generation"), F.col("b.status").alias("status"), F.col("b.attempt").alias("attempt"),
                      F.col("b.o.error").alias("error"))
