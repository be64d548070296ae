"""Report queries over run records derived from ``lineitem`` (one line item = one run)."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundeval.functions import prompts as P
from groundeval.operators import qa as Q
from groundeval.operators import reports as R
from groundeval.plans import duck as D
from groundeval.plans import fixtures as fx
from groundeval.plans.catalog import register

# Model of a run: l_partkey % 15 picks one of the comparison map's 14 names, or an unknown one.
MODEL_KEYS = list(R.COMPARE_MODEL_MAP) + ["t5-unknown-model"]
BOILERPLATE_RAW = P.BOILERPLATE.replace("\\n", "\n")
AFTER_ATTRIB = "?\n\nRespond to this question using only information that can be attributed to Wikipedia."
AFTER_PLAIN = " \nAnswer according to Wikipedia."


def _runs_nested(spark, d):
    li = fx.table(spark, d, "lineitem")
    k = (F.col("l_partkey") % len(MODEL_KEYS) + 1).cast("int")
    key = F.element_at(F.array(*[F.lit(m) for m in MODEL_KEYS]), k)
    f1 = F.col("l_quantity") / 50
    params = F.struct(
        F.when(F.col("l_linenumber") % 2 == 0, F.lit(BOILERPLATE_RAW)).otherwise(F.lit("")).alias("prompt_before"),
        F.element_at(F.array(F.lit(""), F.lit(AFTER_ATTRIB), F.lit(AFTER_PLAIN)), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("prompt_after"),
        F.substring_index(key, "-", 1).alias("model_name"),
        F.expr("substr(_key, instr(_key, '-') + 1)").alias("specific_name"),
        F.element_at(F.array(*[F.lit(x) for x in R.TABLE_DATASETS]), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("dataset"),
    )
    results = F.struct(
        F.struct(F.col("l_discount").alias("avg_percent_overlap")).alias("datasketch"),
        F.struct(
            F.col("l_tax").alias("em"), f1.alias("f1"), (F.col("l_quantity") / 100 + F.col("l_discount")).alias("rougel"),
            (F.col("l_tax") * 100).alias("bleu"), F.array_repeat(f1, F.col("l_linenumber")).alias("f1_list"),
        ).alias("answers"),
        F.col("l_partkey").alias("total_tokens_used"),
    )
    return li.withColumn("_key", key).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("run_id"), params.alias("params"), results.alias("results")
    )


def _flat(spark, d):
    return R.flatten_runs(_runs_nested(spark, d))


def _summary(spark, d):
    return R.summary_mean_std(_flat(spark, d))


_KEYS_SQL = "[" + ", ".join(D.lit(m) for m in MODEL_KEYS) + "]"
_DS_SQL = "[" + ", ".join(D.lit(x) for x in R.TABLE_DATASETS) + "]"
FLAT_SQL = f"""
flat AS (
  SELECT (l_orderkey * 8 + l_linenumber)::BIGINT AS run_id,
         ({_DS_SQL})[l_suppkey % 4 + 1] AS dataset,
         ({_KEYS_SQL})[l_partkey % {len(MODEL_KEYS)} + 1] AS model,
         replace(CASE WHEN l_linenumber % 2 = 0 THEN {D.lit(BOILERPLATE_RAW)} ELSE '' END, chr(10), '\\n') || '{{{{ QUESTION }}}}' ||
           replace(([{D.lit('')}, {D.lit(AFTER_ATTRIB)}, {D.lit(AFTER_PLAIN)}])[l_linenumber % 3 + 1], chr(10), '\\n') AS prompt,
         l_discount AS "ds-25-overlap", l_tax AS em, l_quantity / 50 AS f1, l_quantity / 100 + l_discount AS rougel,
         l_tax * 100 AS bleu, l_partkey / l_linenumber AS average_tokens
  FROM lineitem
)"""


@register("run_flatten", "WITH " + FLAT_SQL + """
SELECT run_id, dataset, model, prompt, "ds-25-overlap", em, f1, rougel, bleu, average_tokens FROM flat""", ("B15", "B16", "E6"))
def run_flatten(spark, d):
    return _flat(spark, d)


_SUM_COLS = ", ".join(f'avg("{m}") AS "{m}-mean", stddev_samp("{m}") AS "{m}-std"' for m in R.METRICS)
_SUM_OUT = ", ".join(f'round("{m}-mean", 9) AS "{m}-mean", round("{m}-std", 9) AS "{m}-std"' for m in R.METRICS)
SUMMARY_SQL = "WITH " + FLAT_SQL + f""",
summary AS (SELECT model, dataset, prompt, {_SUM_COLS}, count(*)::BIGINT AS n_runs FROM flat GROUP BY model, dataset, prompt)"""


def _rounded(df, skip=()):
    return df.select(*[F.round(F.col(f"`{c}`"), 9).alias(c) if t == "double" and c not in skip else F.col(f"`{c}`")
                       for c, t in df.dtypes])


@register("summary_mean_std", SUMMARY_SQL + f"\nSELECT model, dataset, prompt, {_SUM_OUT}, n_runs, row_number() OVER (PARTITION BY model, dataset ORDER BY round(\"ds-25-overlap-mean\", 9) DESC NULLS LAST, prompt)::BIGINT AS file_rank FROM summary", ("E5", "D7"))
def summary_mean_std(spark, d):
    return R.sort_by_overlap(_rounded(_summary(spark, d)))


def _dim_sql(name: str, mapping: dict, order: list) -> str:
    rows = ", ".join(f"({D.lit(k)}, {D.lit(v)}, {order.index(v)})" for k, v in mapping.items())
    return f"{name}(model, model_size, sort_key) AS (VALUES {rows})"


def _headline_sql() -> str:
    return "CASE " + " ".join(f"WHEN dataset = '{ds}' THEN \"{m}-mean\"" for ds, m in R.HEADLINE_METRIC.items()) + " END"


def _strip_sql(x: str, escaped: bool) -> str:
    s = f"replace(replace(replace({x}, {D.lit(P.BOILERPLATE)}, ''), '}}}}?', '}}}}'), '}}}} ', '}}}}')"
    return f"replace({s}, '\\n', '')" if escaped else s


def _fmt_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE printf('%.1f', {x}) END"


_TYPE_SQL = "CASE WHEN NOT starts_with(s.model, 't5-') THEN 'OpenAI' WHEN contains(s.model, 'flan-t5') THEN 'FLAN-T5' ELSE 'T5' END"
_ATTRIB_SQL = f"CASE WHEN contains(prompt, {D.lit(P.ATTRIBUTION_SENTENCE)}) THEN {D.lit(P.ATTRIBUTION_SENTENCE)} ELSE 'null' END"


def _table_sql(binary: bool = False) -> str:
    label = _ATTRIB_SQL if binary else _strip_sql('prompt', True)
    cells = []
    for ds in R.TABLE_DATASETS:
        cells += [
            f"round(avg(CASE WHEN dataset = '{ds}' THEN ov END) * 100, 9) AS \"{ds}_overlap\"",
            f"round(avg(CASE WHEN dataset = '{ds}' THEN hm END) * 100, 9) AS \"{ds}_metric\"",
            f"count(CASE WHEN dataset = '{ds}' THEN 1 END)::BIGINT AS \"{ds}_n\"",
        ]
    fmts = []
    for ds in R.TABLE_DATASETS:
        fmts += [f"{_fmt_sql(chr(34) + ds + '_overlap' + chr(34))} AS \"{ds}_overlap_fmt\"",
                 f"{_fmt_sql(chr(34) + ds + '_metric' + chr(34))} AS \"{ds}_metric_fmt\""]
    disp = D.strip("replace(label, '\\n', ' ')")
    return SUMMARY_SQL + f""",
base AS (SELECT model, {label} AS label, dataset, "ds-25-overlap-mean" AS ov, {_headline_sql()} AS hm
         FROM summary WHERE dataset IN ({', '.join(D.lit(x) for x in R.TABLE_DATASETS)})),
piv AS (SELECT model, label, {', '.join(cells)} FROM base GROUP BY model, label),
dd AS (SELECT *, replace({disp}, '{{{{ QUESTION }}}}', '') AS d FROM piv)
SELECT * EXCLUDE (d), CASE WHEN d = '' THEN {D.lit(P.NULL_PROMPT_TEXT)} ELSE {D.strip('d')} END AS display,
       {', '.join(fmts)},
       row_number() OVER (PARTITION BY model ORDER BY "{R.TABLE_DATASETS[0]}_overlap" ASC NULLS LAST, label)::BIGINT AS rank
FROM dd"""


def _table(spark, d, binary):
    t = R.prompt_dataset_table(_summary(spark, d), binary=binary)
    cols = ["model", "label"]
    for ds in R.TABLE_DATASETS:
        cols += [F.round(f"{ds}_overlap", 9).alias(f"{ds}_overlap"), F.round(f"{ds}_metric", 9).alias(f"{ds}_metric"),
                 F.col(f"{ds}_n").cast("long").alias(f"{ds}_n")]
    out = t.select(*cols, "display", "rank")
    fmts = []
    for ds in R.TABLE_DATASETS:
        for part in ("overlap", "metric"):
            c = F.col(f"{ds}_{part}")
            fmts.append(F.when(c.isNull(), F.lit(None)).otherwise(R.format_pct(c)).alias(f"{ds}_{part}_fmt"))
    return out.select("*", *fmts)


@register("prompt_dataset_table", _table_sql(), ("C12", "E12", "S20", "B17", "B19"))
def prompt_dataset_table(spark, d):
    return _table(spark, d, False)


@register("attribution_table", _table_sql(binary=True), ("C12", "E12", "B18"))
def attribution_table(spark, d):
    """The table with one row for prompts that ask for attribution and one for the others."""
    return _table(spark, d, True)


@register("relative_change", SUMMARY_SQL + f""",
s AS (SELECT model, dataset,
             {_ATTRIB_SQL} AS label,
             "ds-25-overlap-mean" AS ov, {_headline_sql()} AS hm FROM summary),
a AS (SELECT model, dataset,
             avg(CASE WHEN label = 'null' THEN ov END) AS ovn, avg(CASE WHEN label <> 'null' THEN ov END) AS ovg,
             avg(CASE WHEN label = 'null' THEN hm END) AS hmn, avg(CASE WHEN label <> 'null' THEN hm END) AS hmg
      FROM s GROUP BY model, dataset),
c AS (SELECT model, dataset,
       round(CASE WHEN ovn = 0 THEN NULL ELSE (ovg - ovn) / ovn END * 100, 6) AS overlap_change,
       round(CASE WHEN hmn = 0 THEN NULL ELSE (hmg - hmn) / hmn END * 100, 6) AS metric_change
FROM a)
SELECT *, CASE WHEN overlap_change IS NOT NULL THEN printf('%.1f', overlap_change) || '%' END AS overlap_change_fmt,
       CASE WHEN metric_change IS NOT NULL THEN printf('%.1f', metric_change) || '%' END AS metric_change_fmt
FROM c""", ("C11", "E11", "S20"))
def relative_change(spark, d):
    r = R.relative_change(_summary(spark, d))
    r = r.select("model", "dataset", F.round("overlap_change", 6).alias("overlap_change"),
                 F.round("metric_change", 6).alias("metric_change"))
    return r.select("*", *[R.format_change(c).alias(f"{c}_fmt") for c in ("overlap_change", "metric_change")])


@register("size_curve", SUMMARY_SQL + ",\n" + _dim_sql("dim", R.SIZE_MODEL_MAP, R.SIZE_ORDER) + """,
j AS (SELECT s.*, d.model_size, d.sort_key, """ + _TYPE_SQL + """ AS model_type,
             CASE WHEN s.prompt = '{{ QUESTION }}' THEN 'Null' ELSE 'Grounded' END AS prompt_type
      FROM summary s JOIN dim d ON s.model = d.model)
SELECT model_type, model_size, sort_key, prompt_type, count(*)::BIGINT AS n, round(avg("ds-25-overlap-mean"), 6) AS overlap,
       round(stddev_samp("ds-25-overlap-mean") / sqrt(count(*)), 6) AS overlap_se, round(2 * avg("ds-25-overlap-std"), 6) AS overlap_2std
FROM j GROUP BY model_type, model_size, sort_key, prompt_type""", ("E9", "D8", "C9"))
def size_curve(spark, d):
    c = R.size_curve(_summary(spark, d), R.dimension(spark, R.SIZE_MODEL_MAP, R.SIZE_ORDER))
    return c.select("model_type", "model_size", "sort_key", "prompt_type", F.col("n").cast("long"),
                    *[F.round(x, 6).alias(x) for x in ("overlap", "overlap_se", "overlap_2std")])


@register("model_family_compare", SUMMARY_SQL + ",\n" + _dim_sql("dim", R.COMPARE_MODEL_MAP, R.COMPARE_ORDER) + """,
j AS (SELECT s.*, """ + _TYPE_SQL + """ AS family,
             CASE WHEN contains(s.prompt, 'Respond to this question using') THEN 'Grounded' ELSE 'Null' END AS prompt_type
      FROM summary s JOIN dim d ON s.model = d.model WHERE d.model_size = 'xxl')
SELECT family, prompt_type, count(*)::BIGINT AS n,
       round(avg("ds-25-overlap-mean"), 6) AS overlap, round(stddev_samp("ds-25-overlap-mean") / sqrt(count(*)), 6) AS overlap_se,
       round(avg("rougel-mean"), 6) AS rougel, round(stddev_samp("rougel-mean") / sqrt(count(*)), 6) AS rougel_se
FROM j WHERE family <> 'OpenAI' GROUP BY family, prompt_type""", ("E10", "D4"))
def model_family_compare(spark, d):
    c = R.family_compare(_summary(spark, d), R.dimension(spark, R.COMPARE_MODEL_MAP, R.COMPARE_ORDER))
    return c.select("family", "prompt_type", F.col("n").cast("long"),
                    *[F.round(x, 6).alias(x) for x in ("overlap", "overlap_se", "rougel", "rougel_se")])


@register("size_counts", SUMMARY_SQL + ",\n" + _dim_sql("dim", R.SIZE_MODEL_MAP, R.SIZE_ORDER) + """
SELECT d.model_size, count(*)::BIGINT AS count FROM summary s JOIN dim d ON s.model = d.model GROUP BY d.model_size""", "E13")
def size_counts(spark, d):
    j = R.lookup(_summary(spark, d), R.dimension(spark, R.SIZE_MODEL_MAP, R.SIZE_ORDER)).where("matched")
    return R.value_counts(j, "model_size").select("model_size", F.col("count").cast("long"))


@register("model_size_lookup", SUMMARY_SQL + ",\n" + _dim_sql("dim", R.COMPARE_MODEL_MAP, R.COMPARE_ORDER) + """
SELECT m.model, d.model_size, d.sort_key, (d.model IS NOT NULL) AS matched
FROM (SELECT DISTINCT model FROM summary) m LEFT JOIN dim d ON m.model = d.model""", "C9")
def model_size_lookup(spark, d):
    models = _summary(spark, d).select("model").distinct()
    return R.lookup(models, R.dimension(spark, R.COMPARE_MODEL_MAP, R.COMPARE_ORDER)).select("model", "model_size", "sort_key", "matched")


@register("union_runs", "WITH " + FLAT_SQL + """
SELECT run_id, model, "ds-25-overlap", NULL::DOUBLE AS bleu, NULL::VARCHAR AS family FROM flat WHERE run_id % 8 <= 3
UNION ALL
SELECT run_id, model, "ds-25-overlap", bleu, CASE WHEN contains(model, 'flan-t5') THEN 'FLAN-T5' ELSE 'T5' END
FROM flat WHERE run_id % 8 > 3""", "D9")
def union_runs(spark, d):
    f = _flat(spark, d)
    a = f.where(F.col("run_id") % 8 <= 3).select("run_id", "model", "`ds-25-overlap`")
    b = f.where(F.col("run_id") % 8 > 3).select(
        "run_id", "model", "`ds-25-overlap`", "bleu",
        F.when(F.col("model").contains("flan-t5"), F.lit("FLAN-T5")).otherwise(F.lit("T5")).alias("family"))
    return R.union_runs(a, b)


@register("registry_merge", """
WITH u AS (
  SELECT 'ds' || CAST(p_partkey AS VARCHAR) AS name, 'qa/' || p_name || '.jsonl' AS path, 0::BIGINT AS source_rank FROM part
  UNION ALL
  SELECT 'ds' || CAST(p_partkey * 2 AS VARCHAR), 'dialogue/' || p_brand || '.jsonl', 1::BIGINT FROM part
)
SELECT name, max(source_rank) AS source_rank, arg_max(path, source_rank) AS path FROM u GROUP BY name""", ("D10", "A7"))
def registry_merge(spark, d):
    """Two name → path groups (from ``part``); a name in both keeps the second group's path."""
    p = fx.table(spark, d, "part")
    a = p.select(F.concat(F.lit("ds"), F.col("p_partkey").cast("string")).alias("name"),
                 F.concat(F.lit("qa/"), "p_name", F.lit(".jsonl")).alias("path"), F.lit(0).cast("long").alias("source_rank"))
    b = p.select(F.concat(F.lit("ds"), (F.col("p_partkey") * 2).cast("string")).alias("name"),
                 F.concat(F.lit("dialogue/"), "p_brand", F.lit(".jsonl")).alias("path"), F.lit(1).cast("long").alias("source_rank"))
    return Q.keyed_union_last_wins(a.unionByName(b), "name", "source_rank").select("name", "source_rank", "path")
