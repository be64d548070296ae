"""Popularity bins, the capped per-bin sample and per-bin score curves.

Bins are a small list of right-closed intervals turned into one CASE expression (no join
at all).  The capped sample is ``row_number() <= cap`` per bin ordered by a seeded md5:
reproducible on any cluster and in SQL, and because the cap is a small constant Spark
plans it with a per-task window group limit, so a bin holding a third of the rows is cut
to ``cap`` rows in every map task before its single shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundeval.operators.ordinal import dense_ordinal

# The two bin presets of the reference (right-closed intervals).
SAMPLING_BINS = [(-1, 0), (1, 10), (10, 100), (100, 1000), (1000, 10000)]
PLOTTING_BINS = [(-1, 0), (0, 10), (10, 100), (100, 1000), (1000, 10000)]
SAMPLE_CAP = 400
SAMPLE_SEED = 12


def interval_label(lo, hi) -> str:
    return f"({lo}, {hi}]"


def bin_id(value, bins=SAMPLING_BINS) -> Column:
    """0-based index of the right-closed interval holding ``value``; null outside all bins."""
    v = F.col(value) if isinstance(value, str) else value
    expr = None
    for i, (lo, hi) in enumerate(bins):
        cond = (v > lo) & (v <= hi)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.otherwise(F.lit(None).cast("int"))


def bin_label(value, bins=SAMPLING_BINS) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    expr = None
    for lo, hi in bins:
        cond = (v > lo) & (v <= hi)
        lab = F.lit(interval_label(lo, hi))
        expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
    return expr.otherwise(F.lit(None).cast("string"))


def bin_rows(df: DataFrame, value: str = "popularity", bins=SAMPLING_BINS) -> DataFrame:
    """Adds ``bin_id`` and ``bin`` and drops rows outside every bin."""
    return df.withColumn("bin_id", bin_id(value, bins)).withColumn("bin", bin_label(value, bins)).where(F.col("bin_id").isNotNull())


def stratified_sample(binned: DataFrame, id_col: str = "id", cap: int = SAMPLE_CAP, seed: int = SAMPLE_SEED) -> DataFrame:
    """At most ``cap`` rows per bin, chosen by ``md5(id || seed)`` (ties by id); adds ``rn``."""
    key = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))
    w = Window.partitionBy("bin_id").orderBy(key, F.col(id_col))
    return binned.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap)


def curve(df: DataFrame, by, score: str) -> DataFrame:
    """Mean and standard error (sample std / sqrt(n)) of ``score`` per group."""
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("mean"),
        (F.stddev_samp(score) / F.sqrt(F.count(F.lit(1)))).alias("se"),
    )


def popularity_set(splits: list[DataFrame], *, key: str, title: str, answers: Column, popularity: str = "popularity",
                   id_col: str | None = None, cap: int = SAMPLE_CAP, seed: int = SAMPLE_SEED) -> DataFrame:
    """Evaluation set of a capped sample per popularity bin over the union of ``splits``:
    ``id, title, answers, provenance (''), popularity``.

    ``key`` identifies a row over all splits and seeds the sample.  ``id`` is the column
    ``id_col`` (question ids of the trivia shape) or, without one, the row's position in
    (bin, sample) order (the open shape)."""
    whole = splits[0]
    for s in splits[1:]:
        whole = whole.unionByName(s)
    got = stratified_sample(bin_rows(whole, popularity), key, cap, seed)
    if id_col is None:
        got = dense_ordinal(got, [], ["bin_id", "rn"], name="_id")
    return got.select(F.col(id_col or "_id").alias("id"), F.col(title).cast("string").alias("title"), answers.alias("answers"),
                      F.lit("").alias("provenance"), F.col(popularity).cast("int").alias("popularity"))
