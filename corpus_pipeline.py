"""A corpus pipeline from the training-data operators; every stage reads what the one
before it kept.  ``run`` applies all stages to ``documents``.

The mixing stage repeats documents of small sources (in whole and part epochs) and drops
none; the copies are rows with the same ``doc_id``, which packing treats like any others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from groundeval.llm import exact_dedup, lang_id, mixing, order_minhash, packing
from groundeval.llm.common import checkpoint_dir, table
from groundeval.llm.queries import tokenizer_file


def stage_lang_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, and texts far from every learned language, go."""
    return lang_id.keep_identified(docs, min_score=0.1)


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (the largest identifier) stays."""
    return exact_dedup.drop_duplicates(docs, keep="max")


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (the smallest identifier) stays."""
    return order_minhash.keep_one(docs)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are levelled as far as repeating none more than 1.5 times allows."""
    return mixing.mix(docs, max_repetition=1.5).select(*docs.columns)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token sequences, related documents side by side."""
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("lang_id", stage_lang_id),
    ("exact_dedup", stage_exact_dedup),
    ("near_dedup", stage_near_dedup),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]

#: Profiles, sketches and the retrieval order have no SQL form; tests/llm holds the stages'
#: operators against brute force and runs the whole on planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply ``STAGES`` in order; each result is written to the shared folder and read again."""
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
