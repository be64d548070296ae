"""Reading a dataset by name: the registry gives location, format and adapter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundeval.operators import qa as Q
from groundeval.registry import BY_NAME
from groundeval.sources import readers as RD

ADAPTERS = {
    "canonical": Q.canonical_by_position,
    "open": Q.open_qa,
    "nested_aliases": Q.nested_alias_qa,
    "multiple_choice": Q.multiple_choice_qa,
    "long_answer": Q.long_answer_qa,
    "entailment": Q.entailment_qa,
    "multihop": Q.multihop_qa,
    "code_task": Q.code_task_qa,
    "passthrough": Q.passthrough_qa,
}


def load_dataset(spark: SparkSession, name: str, root: str, schema: T.StructType | None = None) -> DataFrame:
    """The dataset ``name`` below ``root`` in the canonical columns.

    Files named ``.jsonl`` / ``.json`` hold JSON lines and ``.csv`` a table with a leading
    index; other locations are hub datasets, stored as parquet.  Without a ``schema``
    JSON columns come in the canonical order."""
    spec = BY_NAME[name]
    path = f"{root}/{spec.location}"
    if path.endswith((".jsonl", ".json")):
        df = RD.read_jsonl(spark, path, schema or T.StructType(RD.QA_SCHEMA.fields[:4]))
    elif path.endswith(".csv"):
        lists = {c: T.ArrayType(T.StringType()) for c in ("answers", "provenance")}
        df = RD.read_indexed_csv(spark, path, lists).withColumn("popularity", F.col("popularity").cast("long"))
    else:
        df = spark.read.parquet(path)
    return ADAPTERS[spec.adapter](df)


def load_datasets(spark: SparkSession, names: list[str], root: str) -> DataFrame:
    """Several datasets in one table with ``dataset``; code tasks have other columns."""
    out = None
    for name in names:
        df = load_dataset(spark, name, root).withColumn("dataset", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
