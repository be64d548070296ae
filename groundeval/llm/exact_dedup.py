"""Exact de-duplication by a tree-merge of sorted digest runs.

1. One pass over the texts gives a narrow digest table ``(id, digest, check, size, run)``:
   SHA-256 of the normalised text, and an independent 64-bit hash and the byte length that
   verify equality at every later step.  ``run`` is the partition that read the row.  The
   table is checkpointed, so texts are read once and run numbers never change afterwards.
2. Every run is reduced to one row per digest (smallest identifier, count) and sorted.
3. Binomial rounds: in each round the runs ``fan_in * k .. fan_in * k + fan_in - 1`` of one
   digest bucket meet in one place and are merged in digest order into run ``k``; a digest
   found in several runs keeps the verified smallest identifier and the summed count.  The
   digest space is cut into buckets, so all rounds, the last included, use every task, and
   a text that makes up a third of the corpus is one row per run.
4. The result goes back to the documents through ``(run, digest)``: first the leaf runs
   fetch it by digest (one row per run and digest), then the documents of a run by
   ``(digest, run)``, so that no join key ever holds all copies of a text.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from groundeval.llm.common import as_bytes, cut_lineage, fresh, shuffle_partitions

KEY = ["digest", "check", "size"]


def _digest_batches(batches):
    for b in batches:
        ids, texts = b.column(0), pc.fill_null(b.column(1).cast(pa.string()), "")
        low = [as_bytes(t) for t in pc.ascii_lower(texts).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array([hashlib.sha256(t).digest() for t in low], pa.binary()),
                pa.array([xxhash.xxh64_intdigest(t) - (1 << 63) for t in low], pa.int64()),
                pa.array([len(t) for t in low], pa.int64()),
            ],
            names=["id", "digest", "check", "size"],
        )


def _with_digest(text_col: str, name: str):
    def run(batches):
        for b in batches:
            low = pc.ascii_lower(pc.fill_null(b.column(text_col).cast(pa.string()), "")).to_pylist()
            yield b.append_column(name, pa.array([hashlib.sha256(as_bytes(t)).digest() for t in low], pa.binary()))

    return run


def digest_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, digest, check, size, run, row)``; texts equal but for the case of A-Z share a
    digest; ``row`` is unique and tells apart rows that repeat an identifier."""
    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = narrow.mapInArrow(_digest_batches, "id bigint, digest binary, check bigint, size bigint")
    return out.withColumn("run", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())


def merge_runs(runs: DataFrame, n_runs: int, fan_in: int, buckets: int, pick) -> DataFrame:
    """Merge sorted runs ``(digest, check, size, run, best, n)`` in rounds of ``fan_in`` until
    one run per digest bucket is left; returns one row per digest."""
    parts = shuffle_partitions(runs.sparkSession)
    cur = runs.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
    while n_runs > 1:
        n_runs = -(-n_runs // fan_in)
        cur = (
            cur.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .repartition(parts, "bucket", "run")
            .sortWithinPartitions("bucket", "run", *KEY)
            .groupBy("bucket", "run", *KEY)
            .agg(pick("best").alias("best"), F.sum("n").alias("n"))
        )
    return cur.drop("bucket", "run")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fan_in: int = 16
) -> DataFrame:
    """One row per input row: ``(<id_col>, keep_id, group_size, kept, text_sha256)``.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the
    smallest (``keep='max'``: largest) identifier stays, a null identifier only if no other
    row has the text.  A null text counts as empty; empty texts form one group like any
    other.  Rows that repeat an identifier and a text all count and exactly one is kept.
    Very long texts are hashed whole.  An empty table gives an empty result; columns other
    than the two named are not read, so they may have any name.
    """
    digests = cut_lineage(digest_table(docs, id_col, text_col))
    pick, known = (F.max, F.col("id").isNotNull()) if keep == "max" else (F.min, F.col("id").isNull())
    best = F.struct(known.alias("known"), F.col("id"), F.col("row"))
    leaves = digests.groupBy("run", *KEY).agg(pick(best).alias("best"), F.count("*").alias("n"))
    n_runs = max(1, digests.rdd.getNumPartitions())
    buckets = 4 * shuffle_partitions(docs.sparkSession)
    merged = merge_runs(leaves, n_runs, fan_in, buckets, pick)
    down = leaves.select("run", *KEY).join(merged, KEY)
    out = digests.join(down, ["run", *KEY])
    return out.select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fan_in: int = 16
) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns.

    Rows to go are found by identifier (null equals null) and digest; of rows that repeat an
    identifier and a text one is left.
    """
    marks = exact_dedup(docs, id_col, text_col, keep, fan_in)
    flags = (
        marks.groupBy(F.col(id_col).alias("f_id"), F.unhex("text_sha256").alias("f_digest"))
        .agg(F.max("kept").alias("f_kept"), F.count("*").alias("f_n"))
        .where(~F.col("f_kept") | (F.col("f_n") > 1))
    )
    digest = fresh(docs, "text_digest")
    tagged = docs.mapInArrow(_with_digest(text_col, digest), StructType([*docs.schema.fields, StructField(digest, BinaryType())]))
    joined = tagged.join(
        flags.withColumnsRenamed({c: fresh(docs, c) for c in flags.columns}),
        F.col(id_col).eqNullSafe(F.col(fresh(docs, "f_id"))) & (F.col(digest) == F.col(fresh(docs, "f_digest"))),
        "left",
    )
    kept = F.col(fresh(docs, "f_kept"))
    once = joined.where(kept).dropDuplicates([id_col, digest])
    return joined.where(kept.isNull()).unionByName(once).select(*docs.columns)
