"""Records whose borders no byte alone marks, read by many tasks: rows of a CSV with line breaks
inside quotes, entries of one large JSON object in one file.

Spark's text reader cuts a file into pieces at a separator, by byte ranges.  Whether a separator
ends a record depends on all pieces before it: on the parity of quotes, and for JSON on the
depth of brackets outside strings.  Both are running totals, so they are carried across pieces
as sums: inside a byte range by a window, across ranges by the totals of the ranges before,
a table of a row per range.  Pieces between two borders are joined again and handed to Spark's
own parsers.  A task holds one byte range, and a record, never a file.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundeval.session import cut_lineage

_RANGE = ["_file", "_start"]


def pieces(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """``(value, _file, _start, _seq)``: the text between separators, with its byte range and a
    number that rises inside the range.  Stored once: later steps see the same numbers."""
    raw = spark.read.option("lineSep", sep).text(path)
    at = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    return cut_lineage(raw.select("value", *at, F.monotonically_increasing_id().alias("_seq")))


def running_total(df: DataFrame, amount: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over the pieces of the file up to this one."""
    inside = Window.partitionBy(*_RANGE).orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn(name, F.sum(amount).over(inside))
    ranges = out.groupBy(*_RANGE).agg(F.max_by(name, "_seq").alias("_sum"))
    earlier = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select(*_RANGE, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    return out.join(before, _RANGE).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def joined(df: DataFrame, marks: DataFrame, ends: Column, sep: str) -> DataFrame:
    """``(file, record, text, last)``: the pieces of ``df`` up to each one that ``ends`` a record, put
    together; records are numbered from 0 in a file, ``last`` marks its end.  ``marks`` has the
    pieces' running totals without their text, which moves only when records are put together."""
    done = running_total(marks.withColumn("_end", ends.cast("long")), F.col("_end"), "_ended")
    numbered = done.select(*_RANGE, "_seq", (F.col("_ended") - F.col("_end")).alias("record"))
    whole = F.array_sort(F.collect_list(F.struct("_start", "_seq", "value")))
    out = df.join(numbered, [*_RANGE, "_seq"]).groupBy("_file", "record").agg(F.array_join(F.transform(whole, lambda x: x["value"]), sep).alias("text"))
    final = numbered.groupBy("_file").agg(F.max("record").alias("_last"))
    return out.join(final, "_file").select(F.col("_file").alias("file"), "record", "text", (F.col("record") == F.col("_last")).alias("last"))


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, record, text, last)``: rows of CSV text, line breaks inside double quotes kept.
    Quotes are doubled inside quoted fields and do not occur in others."""
    df = pieces(spark, path, "\n")
    marks = df.select(*_RANGE, "_seq", _count(F.col("value"), '"').cast("long").alias("_q"))
    out = joined(df, running_total(marks, F.col("_q"), "_quotes"), F.col("_quotes") % 2 == 0, "\n")
    return out.withColumn("text", F.regexp_replace("text", "\r$", "")).where("text != ''")


def read_multiline_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with the same header line and text columns; fields may hold line breaks."""
    records = csv_records(spark, path)
    head = records.where("record = 0").orderBy("file").limit(1).collect()
    if not head:
        return spark.createDataFrame([], "value string").drop("value")
    names = [n or f"_c{i}" for i, n in enumerate(next(csv.reader([head[0].text])))]  # one line of the driver
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rows = records.where("record > 0").select(F.from_csv("text", ddl, {"escape": '"', "multiLine": "true"}).alias("r"))
    return rows.select(*[F.col("r").getField(n).alias(n) for n in names])


def json_entries(spark: SparkSession, path: str) -> DataFrame:
    """``(file, record, text, last)``: the entries ``"key": value`` of the JSON object that each file
    holds, whatever its layout.  An object without entries gives none."""
    df = pieces(spark, path, ",")
    # between quotes that are not escaped, every other part lies outside strings
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    depth = lambda odd: F.aggregate(
        F.filter(parts, lambda _, i: i % 2 == odd), F.lit(0).cast("long"), lambda s, p: s + _count(p, "{[") - _count(p, "}]")
    )
    marks = df.select(*_RANGE, "_seq", (F.size(parts) - 1).cast("long").alias("_q"), depth(0).alias("_outside"), depth(1).alias("_inside"))
    marks = running_total(marks, F.col("_q"), "_quotes")
    opened = F.when((F.col("_quotes") - F.col("_q")) % 2 == 0, F.col("_outside")).otherwise(F.col("_inside"))
    marks = cut_lineage(running_total(marks, opened, "_depth").select(*_RANGE, "_seq", "_quotes", "_depth"))
    out = joined(df, marks, (F.col("_quotes") % 2 == 0) & (F.col("_depth") <= 1), ",")
    text = F.when(F.col("record") == 0, F.regexp_replace("text", r"^[\s\x{FEFF}]*\{", "")).otherwise(F.col("text"))
    text = F.when(F.col("last"), F.regexp_replace(text, r"\}\s*$", "")).otherwise(text)
    return out.withColumn("text", text).where(F.trim(F.regexp_replace("text", r"\s", "")) != "")
