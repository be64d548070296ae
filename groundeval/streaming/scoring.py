"""Score predictions as they arrive (Structured Streaming).

The reference scores finished runs only; here the same batch operators run per
micro-batch, so a generation job can drop prediction files into a folder and the scores
appear incrementally.  ``foreachBatch`` keeps the exact overlap plan (jobs run while it is
built).  Every micro-batch overwrites its own ``batch_id=`` folder, so a batch
that is replayed after a failure leaves the same rows once.  ``running_metrics`` keeps
per-run means as streaming state.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from groundeval.operators import evaluate as EV
from groundeval.operators import metrics as M
from groundeval.operators import sketch as SK
from groundeval.session import checkpoint_dir

PREDICTION_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()), T.StructField("pair_id", T.LongType()),
    T.StructField("dataset_name", T.StringType()), T.StructField("output_format", T.StringType()),
    T.StructField("pred", T.StringType()), T.StructField("golds", T.ArrayType(T.StringType())),
    T.StructField("provenance", T.ArrayType(T.StringType())),
])


def read_prediction_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(PREDICTION_SCHEMA).option("maxFilesPerTrigger", max_files).json(folder)


def score_batch(preds: DataFrame, corpus: DataFrame | None = None, *, sketch: DataFrame | None = None,
                m_bits: int | None = None) -> DataFrame:
    """Per prediction and target: em, f1, rougel, plus its overlap with the corpus.

    With ``sketch`` (a Bloom table from ``bloom_sketch`` and its ``m_bits``) the overlap is
    read from the sketch — one join per batch, no corpus scan, the right choice for a
    long-running stream over a large corpus.  Otherwise the exact corpus scan runs."""
    if sketch is None:
        return EV.score_rows(preds, corpus).select("pair_id", "run_id", "target", "em", "f1", "rougel", "overlap")
    scored = EV.score_rows(preds, None).drop("overlap")
    texts = preds.select(F.struct("run_id", "pair_id").alias("id"), F.col("pred").alias("text"))
    ov = SK.bloom_overlap(texts, sketch, m_bits=m_bits, id_col="id")
    ov = ov.select("id.run_id", "id.pair_id", "overlap")
    return scored.join(ov, ["run_id", "pair_id"], "left").select("pair_id", "run_id", "target", "em", "f1", "rougel", "overlap")


def start_scoring(stream: DataFrame, corpus: DataFrame | None, sink: str, *, name: str = "scores",
                  available_now: bool = True, sketch: DataFrame | None = None, m_bits: int | None = None) -> StreamingQuery:
    """Per-prediction scores of every micro-batch as parquet in ``sink/batch_id=N``.  Pass a
    persisted Bloom ``sketch`` (and its ``m_bits``) to avoid touching the corpus per batch."""
    spark = stream.sparkSession
    ckpt = os.path.join(checkpoint_dir(spark), f"stream-{name}")

    def process(batch: DataFrame, batch_id: int) -> None:
        out = score_batch(batch, corpus, sketch=sketch, m_bits=m_bits)
        out.write.mode("overwrite").parquet(os.path.join(sink, f"batch_id={batch_id}"))

    w = stream.writeStream.foreachBatch(process).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


SCORE_SCHEMA = T.StructType([
    T.StructField("pair_id", T.LongType()), T.StructField("run_id", T.LongType()), T.StructField("target", T.StringType()),
    T.StructField("em", T.DoubleType()), T.StructField("f1", T.DoubleType()), T.StructField("rougel", T.DoubleType()),
    T.StructField("overlap", T.DoubleType()), T.StructField("batch_id", T.LongType()),
])


def running_metrics(scores: DataFrame) -> DataFrame:
    """Per-(run, target) means; on a stream the sums and counts live in the state store."""
    return M.run_metrics(scores, run_cols=("run_id", "target"), metrics=("em", "f1", "rougel", "overlap"))


def start_running_metrics(spark: SparkSession, scores_folder: str, table: str, *, name: str = "running",
                          available_now: bool = True) -> StreamingQuery:
    """Stream the appended score files into per-run running means (stateful aggregation,
    ``update`` mode), upserting each micro-batch's changed runs into the parquet table at
    ``table`` path (one folder per batch id; the latest row per run wins)."""
    ckpt = os.path.join(checkpoint_dir(spark), f"stream-{name}")
    agg = running_metrics(spark.readStream.schema(SCORE_SCHEMA).parquet(scores_folder))

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(table, f"batch_id={batch_id}"))

    w = agg.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def latest_running_metrics(spark: SparkSession, table: str) -> DataFrame:
    """The current value per run from the upserted table (highest batch id wins)."""
    t = spark.read.parquet(table)
    latest = t.groupBy("run_id", "target").agg(F.max("batch_id").alias("batch_id"))
    return t.join(latest, ["run_id", "target", "batch_id"]).drop("batch_id")
