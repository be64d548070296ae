"""Run summaries and the tables behind the reference's figures and LaTeX tables.

All reports are hash aggregations (partial + final) over the run table; dimension lookups
are broadcast joins against fixed, tiny tables; cross-dataset alignment is a pivot over a
declared value list (no self-join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundeval.functions import prompts as P
from groundeval.functions.format import format_fixed1
from groundeval.registry import HEADLINE_METRIC, TABLE_DATASETS

METRICS = ["ds-25-overlap", "em", "f1", "rougel", "bleu", "average_tokens"]

# Model name → size for the size study.
SIZE_MODEL_MAP = {
    "gpt3-text-ada-001": "ada",
    "gpt3-text-babbage-001": "babbage",
    "gpt3-text-curie-001": "curie",
    "gpt3-text-davinci-003": "davinci",
    "t5-google/flan-t5-small": "small",
    "t5-google/flan-t5-base": "base",
    "t5-google/flan-t5-large": "large",
    "t5-google/flan-t5-xl": "xl",
    "t5-google/flan-t5-xxl": "xxl",
}
SIZE_ORDER = ["small", "base", "large", "xl", "xxl", "ada", "babbage", "curie", "davinci"]

# Model name → size for the family comparison.
COMPARE_MODEL_MAP = {
    "gpt3-text-ada-001": "base",
    "gpt3-text-babbage-001": "large",
    "gpt3-text-curie-001": "xl",
    "gpt3-text-davinci-003": "xxl",
    "t5-google/flan-t5-small": "small",
    "t5-google/flan-t5-base": "base",
    "t5-google/flan-t5-large": "large",
    "t5-google/flan-t5-xl": "xl",
    "t5-google/flan-t5-xxl": "xxl",
    "t5-t5-base": "base",
    "t5-t5-large": "large",
    "t5-t5-3b": "xl",
    "t5-t5-11b": "xxl",
    "t5-google/t5-xxl-lm-adapt": "xxl",
}
COMPARE_ORDER = ["small", "base", "large", "xl", "xxl"]


def dimension(spark: SparkSession, mapping: dict[str, str], order: list[str], key="model", value="model_size") -> DataFrame:
    """A fixed lookup table ``(key, value, sort_key)``; tiny by construction."""
    rows = [(k, v, order.index(v)) for k, v in mapping.items()]
    return spark.createDataFrame(rows, f"{key} string, {value} string, sort_key int")


def flatten_runs(runs: DataFrame) -> DataFrame:
    """Nested run records → one flat row per run (the summary input)."""
    p, r = F.col("params"), F.col("results")
    return runs.select(
        "run_id",
        p["dataset"].alias("dataset"),
        F.concat(p["model_name"], F.lit("-"), p["specific_name"]).alias("model"),
        P.prompt_key(p["prompt_before"], p["prompt_after"]).alias("prompt"),
        r["datasketch"]["avg_percent_overlap"].alias("ds-25-overlap"),
        r["answers"]["em"].alias("em"),
        r["answers"]["f1"].alias("f1"),
        r["answers"]["rougel"].alias("rougel"),
        r["answers"]["bleu"].alias("bleu"),
        F.try_divide(r["total_tokens_used"], F.size(r["answers"]["f1_list"])).alias("average_tokens"),
    )


def summary_mean_std(flat: DataFrame, by=("model", "dataset", "prompt"), metrics=METRICS) -> DataFrame:
    """Mean and sample standard deviation of every metric per (model, dataset, prompt);
    one run → std NULL.  One hash aggregation (partial + final); unsorted, because the
    reports built on it re-aggregate (``sort_by_overlap`` gives the file order)."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(F.col(f"`{m}`")).alias(f"{m}-mean"), F.stddev_samp(F.col(f"`{m}`")).alias(f"{m}-std")]
    return flat.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("n_runs"))


def sort_by_overlap(summary: DataFrame, file=("model", "dataset")) -> DataFrame:
    """The summary files' order: overlap mean descending; ``file_rank`` is a row's place in
    its file (ties by prompt)."""
    order = F.desc_nulls_last("`ds-25-overlap-mean`")
    place = Window.partitionBy(*file).orderBy(order, "prompt")
    return summary.withColumn("file_rank", F.row_number().over(place).cast("long")).orderBy(order)


def lookup(df: DataFrame, dim: DataFrame, key: str = "model") -> DataFrame:
    """Left join against a dimension; ``matched`` marks misses for audit."""
    return df.join(dim.withColumn("matched", F.lit(True)), key, "left").withColumn(
        "matched", F.coalesce("matched", F.lit(False))
    )


def prompt_dataset_table(summary: DataFrame, by=("model",), binary: bool = False) -> DataFrame:
    """Prompt × dataset table: per prompt label, overlap and the dataset's headline metric
    (×100) for the four datasets, with the number of summary rows behind each cell.

    ``rank`` is the row's place in ascending overlap of the first (driving) dataset within
    ``by``, ties by label, rows without it last.  ``binary`` replaces the prompts by whether
    they ask for attribution."""
    label = P.attribution_label("prompt") if binary else P.strip_boilerplate("prompt", drop_escaped_newlines=True)
    headline = F.lit(None).cast("double")
    for ds, metric in HEADLINE_METRIC.items():
        headline = F.when(F.col("dataset") == ds, F.col(f"`{metric}-mean`")).otherwise(headline)
    base = summary.where(F.col("dataset").isin(*TABLE_DATASETS)).select(
        *by, label.alias("label"), "dataset", F.col("`ds-25-overlap-mean`").alias("ov"), headline.alias("hm")
    )
    piv = base.groupBy(*by, "label").pivot("dataset", TABLE_DATASETS).agg(
        F.round(F.avg("ov") * 100, 9).alias("overlap"), F.round(F.avg("hm") * 100, 9).alias("metric"), F.count(F.lit(1)).alias("n")
    )
    order = Window.partitionBy(*by).orderBy(F.asc_nulls_last(f"{TABLE_DATASETS[0]}_overlap"), "label")
    return piv.withColumn("display", P.display_text("label")).withColumn("rank", F.row_number().over(order).cast("long"))


def format_pct(c) -> F.Column:
    """``'%.1f' % x`` exactly as Python formats it, as a native expression (see
    ``functions.format``; Java's ``format_string`` rounds ties differently)."""
    return format_fixed1(c)


def format_change(c) -> Column:
    """A change in percent as the tables print it: one digit and a percent sign."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.concat(format_fixed1(c), F.lit("%")))


def model_type(model="model") -> Column:
    """OpenAI, FLAN-T5 or T5, by model name."""
    m = F.col(model) if isinstance(model, str) else model
    return F.when(~m.startswith("t5-"), F.lit("OpenAI")).when(m.contains("flan-t5"), F.lit("FLAN-T5")).otherwise(F.lit("T5"))


def relative_change(summary: DataFrame, by=("model", "dataset")) -> DataFrame:
    """(grounded − null) / null × 100 for the overlap and the dataset's headline metric,
    by conditional averages over the two prompt labels; null when the base is 0 or absent."""
    lab = P.attribution_label("prompt")
    headline = F.lit(None).cast("double")
    for ds, metric in HEADLINE_METRIC.items():
        headline = F.when(F.col("dataset") == ds, F.col(f"`{metric}-mean`")).otherwise(headline)
    s = summary.select(*by, lab.alias("label"), F.col("`ds-25-overlap-mean`").alias("ov"), headline.alias("hm"))
    is_null = F.col("label") == "null"
    agg = s.groupBy(*by).agg(
        F.avg(F.when(is_null, F.col("ov"))).alias("ov_null"), F.avg(F.when(~is_null, F.col("ov"))).alias("ov_grounded"),
        F.avg(F.when(is_null, F.col("hm"))).alias("hm_null"), F.avg(F.when(~is_null, F.col("hm"))).alias("hm_grounded"),
    )
    return agg.select(
        *by,
        (F.try_divide(F.col("ov_grounded") - F.col("ov_null"), F.col("ov_null")) * 100).alias("overlap_change"),
        (F.try_divide(F.col("hm_grounded") - F.col("hm_null"), F.col("hm_null")) * 100).alias("metric_change"),
    )


def size_curve(summary: DataFrame, dim: DataFrame) -> DataFrame:
    """Overlap by model size × prompt type (Null / Grounded): mean, standard error and
    twice the mean per-row std, with the model type, ordered by the declared size order."""
    j = lookup(summary, dim).where("matched")
    j = j.withColumn("prompt_type", P.null_vs_grounded("prompt"))
    g = j.withColumn("model_type", model_type()).groupBy("model_type", "model_size", "sort_key", "prompt_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("`ds-25-overlap-mean`").alias("overlap"),
        (F.stddev_samp("`ds-25-overlap-mean`") / F.sqrt(F.count(F.lit(1)))).alias("overlap_se"),
        (2 * F.avg("`ds-25-overlap-std`")).alias("overlap_2std"),
    )
    return g.orderBy("sort_key", "prompt_type")


def family_compare(summary: DataFrame, dim: DataFrame, size: str = "xxl") -> DataFrame:
    """Model family (T5 and FLAN-T5) × prompt type at one size: mean and SE of overlap and
    ROUGE-L."""
    j = lookup(summary, dim).where(F.col("matched") & (F.col("model_size") == size))
    j = j.withColumn("family", model_type()).where("family != 'OpenAI'").withColumn("prompt_type", P.grounded_marker_label("prompt"))
    n = F.count(F.lit(1))
    return j.groupBy("family", "prompt_type").agg(
        n.alias("n"),
        F.avg("`ds-25-overlap-mean`").alias("overlap"), (F.stddev_samp("`ds-25-overlap-mean`") / F.sqrt(n)).alias("overlap_se"),
        F.avg("`rougel-mean`").alias("rougel"), (F.stddev_samp("`rougel-mean`") / F.sqrt(n)).alias("rougel_se"),
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"))


def union_runs(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
