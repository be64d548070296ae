"""Shards that all have the corpus's mixture, by proportional stratified interleaving.

1. Rows are shuffled inside each source by a seeded digest of identifier, text and source
   (rows equal in all three are told apart by a running number), and ranked in that order.
2. A row's fractional rank is ``(rank + u) / n``, ``n`` the rows of its source and ``u`` a
   seeded offset of the source in [0, 1): the rows of every source are spread evenly over the
   unit interval, small sources at random places.
3. All rows are sorted by fractional rank and cut into shards of equal row counts.  Any
   stretch of the interval holds its share of every source to within one row, so every
   shard has each source's share to within a few rows.

No window holds a source or a shard: digests and fractional ranks are both uniform, so ranges
of them are buckets of equal size, and a row's place is its place in the bucket plus the rows
of the buckets before it.  Only narrow rows are moved; the texts move once, when shards are
written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundeval.llm.common import cut_lineage, fresh, shuffle_partitions

UNIT = 1 << 32  # eight hexadecimal digits of a digest, as a number


def _draw(hexed: Column) -> Column:
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("bigint")


def _before(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """``counts`` with the rows ``before`` in smaller buckets and ``total`` of the group."""
    group = Window.partitionBy(*by)
    upto = group.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("total", F.sum("n").over(group))


def narrow_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, row: Column | None = None) -> DataFrame:
    """``(row, part, id, size, crc, source, key)``: one row per input row, without its text.
    ``row`` tells rows apart; by default it is made up and holds once the result is stored."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    ident = F.coalesce(F.col(id_col).cast("bigint").cast("string"), F.lit(""))
    return docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
        F.spark_partition_id().alias("part"),
        F.col(id_col).cast("bigint").alias("id"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        source.alias("source"),
        F.md5(F.concat_ws("|", F.lit(str(seed)), ident, F.md5(text), source)).alias("key"),
    )


def tell_apart(rows: DataFrame) -> DataFrame:
    """Give rows that share a key keys of their own: the n-th (from 0) of them gets the digest
    of key and n.  Counted per partition first, so a key that many rows share is no hot spot."""
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    again = rows.join(shared, "key", "left_semi").select("row", "part", "key")
    local = Window.partitionBy("key", "part").orderBy("row")
    counts = _before(again.groupBy("key", "part").agg(F.count("*").alias("n")), ["key"], "part")
    nth = again.withColumn("nth", F.row_number().over(local)).join(counts.select("key", "part", "before"), ["key", "part"])
    later = nth.select("row", (F.col("before") + F.col("nth") - 1).alias("nth")).where("nth > 0")
    out = rows.join(later, "row", "left")
    key = F.when(F.col("nth").isNull(), F.col("key")).otherwise(F.md5(F.concat_ws("|", "key", F.col("nth").cast("string"))))
    return out.withColumn("key", key).drop("nth", "part")


def fractional_ranks(rows: DataFrame, seed: int, buckets: int) -> DataFrame:
    """``rows`` with ``at``, the fractional rank in the source."""
    dealt = rows.withColumn("bucket", F.floor(_draw(F.col("key")) * buckets / UNIT))
    counts = _before(dealt.groupBy("source", "bucket").agg(F.count("*").alias("n")), ["source"], "bucket").drop("n")
    inside = Window.partitionBy("source", "bucket").orderBy("key")
    ranked = dealt.withColumn("rank", F.row_number().over(inside) - 1).join(counts, ["source", "bucket"])
    offset = _draw(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("source")))) / F.lit(float(UNIT))
    at = (F.col("before") + F.col("rank") + offset) / F.col("total")
    return ranked.withColumn("at", at).drop("bucket", "rank", "before", "total")


def cut_evenly(rows: DataFrame, n_shards: int, buckets: int) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``: sorted by fractional rank, cut at equal counts."""
    dealt = rows.withColumn("bucket", F.least(F.floor(F.col("at") * buckets), F.lit(buckets - 1)))
    counts = _before(dealt.groupBy("bucket").agg(F.count("*").alias("n")), [], "bucket").drop("n")  # at most `buckets` rows
    inside = Window.partitionBy("bucket").orderBy("at", "source", "key")
    placed = dealt.withColumn("place", F.row_number().over(inside) - 1).join(counts, "bucket")
    placed = placed.withColumn("place", F.col("place") + F.col("before"))
    shard = F.expr(f"(place * {n_shards}L) div total")
    first = F.expr(f"(shard * total + {n_shards - 1}L) div {n_shards}L")
    placed = placed.withColumn("shard", shard).withColumn("slot", F.col("place") - first)
    return placed.withColumn("shard", F.col("shard").cast("int")).drop("bucket", "place", "before", "total")


def _assigned(rows: DataFrame, n_shards: int, seed: int) -> DataFrame:
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    buckets = 4 * shuffle_partitions(rows.sparkSession)
    ranked = cut_lineage(fractional_ranks(tell_apart(rows), seed, buckets))
    return cut_evenly(ranked, n_shards, buckets)


def assign_shards(
    docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17
) -> DataFrame:
    """One row per input row: ``(<id_col>, size, text_crc32, source, shard, slot)``.

    ``size`` is the text's UTF-8 bytes plus 8.  Shards have row counts at most one apart and
    every source's share to within a few rows; ``slot`` numbers a shard's rows from 0.  The
    result depends on the rows and the seed only, not on how the input is partitioned (rows
    equal in identifier, text and source are interchangeable).  A null text counts as empty, a
    null source is a source of its own, null identifiers are allowed.  Fewer rows than shards
    leave shards empty; an empty table gives an empty result.  Columns other than the three
    named are not read; long texts are digested whole.
    """
    rows = cut_lineage(narrow_rows(docs, id_col, text_col, source_col, seed))
    out = _assigned(rows, n_shards, seed)
    source = F.when(F.col("source") == "", None).otherwise(F.expr("substring(source, 2)"))
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), source.alias("source"), "shard", "slot")


def shard_documents(
    docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17
) -> DataFrame:
    """All columns of ``docs``, then ``shard`` and ``slot`` (names lengthened if taken)."""
    row, shard, slot = fresh(docs, "row"), fresh(docs, "shard"), fresh(docs, "slot")
    numbered = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    narrow = narrow_rows(numbered, id_col, text_col, source_col, seed, F.col(row))
    placed = _assigned(cut_lineage(narrow), n_shards, seed)
    placed = placed.select(F.col("row").alias(row), F.col("shard").alias(shard), F.col("slot").alias(slot))
    return numbered.join(placed, row).select(*docs.columns, shard, slot)


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, **columns) -> None:
    """Write ``shard_documents`` as Parquet below ``path/shard=N``; the files of a shard, in order
    of their names, hold its rows in order of ``slot``.  A shard may be many files."""
    out = shard_documents(docs, n_shards, **columns)
    shard, slot = out.columns[-2:]
    parts = max(n_shards, shuffle_partitions(docs.sparkSession))
    out.repartitionByRange(parts, shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
