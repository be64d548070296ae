"""Grid, expansion and prompt queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundeval.functions import prompts as P
from groundeval.operators import grid as G
from groundeval.plans import duck as D
from groundeval.plans import fixtures as fx
from groundeval.plans.catalog import register

_GRID_COLS = ("config_id, prompt_id, prompt_before, prompt_after, model_name, specific_name, num_examples, "
              "temperature, dataset_name, output_format, prompt_set, batch_size")

GRID_SQL = "WITH " + fx.CONFIGS_SQL + "," + fx.PROMPTS_SQL + """,
grid AS (
  SELECT config_id, NULL::BIGINT AS prompt_id, prompt_before, prompt_after, model_name, specific_name, num_examples,
         temperature, dataset_name, output_format, prompt_set, 4::BIGINT AS batch_size
  FROM configs
  UNION ALL
  SELECT c.config_id, p.prompt_id,
         CASE WHEN p.location = 'before' THEN (CASE WHEN p.location_specific = 'before' THEN p.prompt || c.prompt_before
                                                   ELSE c.prompt_before || p.prompt END)
              ELSE c.prompt_before END,
         CASE WHEN p.location = 'after' THEN (CASE WHEN p.location_specific = 'after' THEN c.prompt_after || p.prompt
                                                  ELSE p.prompt || c.prompt_after END)
              ELSE c.prompt_after END,
         c.model_name, c.specific_name, c.num_examples, c.temperature, c.dataset_name, c.output_format, c.prompt_set,
         4::BIGINT
  FROM configs c JOIN prompts p ON c.prompt_set = p.prompt_set
)"""


def _grid(spark, d):
    return G.experiment_grid(fx.configs(spark, d), fx.prompts(spark, d))


@register("experiment_grid", GRID_SQL + f"\nSELECT {_GRID_COLS} FROM grid", ("C6", "S12", "S13"))
def experiment_grid(spark, d):
    return _grid(spark, d).select(*[c.strip() for c in _GRID_COLS.split(",")])


_EXPAND_SQL = GRID_SQL + ",\n" + fx.QA_SQL + """,
ex AS (
  SELECT g.*, (g.config_id * 100 + coalesce(g.prompt_id + 1, 0))::BIGINT AS run_id, q.id, q.title, q.ordinal
  FROM grid g JOIN qa q ON g.dataset_name = q.dataset_name
  WHERE q.ordinal < g.num_examples
)"""


def _runs(spark, d):
    return _grid(spark, d).withColumn("run_id", (F.col("config_id") * 100 + F.coalesce(F.col("prompt_id") + 1, F.lit(0))).cast("long"))


def _expanded(spark, d):
    return G.run_expand(_runs(spark, d), fx.qa_table(spark, d), run_cols=["run_id"])


def _rendered(spark, d):
    runs, qa = G.prepare_prompts(_runs(spark, d), fx.qa_table(spark, d))
    return G.render_prompts(G.run_expand(runs, qa, run_cols=["run_id"]))


@register("run_expand", _EXPAND_SQL + "\nSELECT run_id, dataset_name, id, ordinal FROM ex", ("C7", "D2", "W1"))
def run_expand(spark, d):
    return _expanded(spark, d).select("run_id", "dataset_name", "id", "ordinal")


def _cap(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


_RENDER_SQL = _EXPAND_SQL + f""",
rd AS (
  SELECT run_id, id,
         (lower(dataset_name) LIKE '%eli5%' OR lower(model_name) IN ('gpt3', 'gpt4', 'chatgpt')) AS single,
         {D.strip("coalesce(prompt_before, '') || " + _cap('title') + " || coalesce(prompt_after, '')")} AS p_single,
         'Output the answer only. ' || {_cap('title')} ||
           CASE WHEN lower(dataset_name) LIKE '%nq%' THEN '?' || chr(10) || 'Answer string only:' ELSE chr(10) || 'Answer string only:' END AS p1,
         'Question: ' || title || chr(10) || 'Answer: ANSWER' || chr(10) || chr(10) || chr(10) || chr(10) ||
           'Give a detailed explanation for why this is true.' || coalesce(prompt_after, '') || chr(10) || 'Explanation:' AS p2,
         (length(coalesce(prompt_before, '')) > 0 AND ends_with(coalesce(prompt_before, ''), '"')) AS ends_with_quote
  FROM ex
)"""


@register("prompt_render", _RENDER_SQL + """
SELECT run_id, id, CASE WHEN single THEN 'single' ELSE 'two_step' END AS mode,
       CASE WHEN single THEN p_single ELSE p1 END AS prompt, ends_with_quote
FROM rd""", ("S14", "S17"))
def prompt_render(spark, d):
    r = _rendered(spark, d)
    return r.select("run_id", "id", "mode", "prompt", "ends_with_quote")


@register("prompt_render_two_step", _RENDER_SQL + """
SELECT run_id, id, p1 AS answer_prompt, p2 AS explanation_prompt FROM rd WHERE NOT single""", "S15")
def prompt_render_two_step(spark, d):
    r = _rendered(spark, d).where(F.col("mode") == "two_step")
    return r.select("run_id", "id", F.col("prompt").alias("answer_prompt"), F.col("prompt_2").alias("explanation_prompt"))


_KEY_SQL = GRID_SQL + """,
k AS (
  SELECT config_id, prompt_id,
         replace(prompt_before, chr(10), '\\n') || '{{ QUESTION }}' || replace(prompt_after, chr(10), '\\n') AS prompt_key
  FROM grid
)"""


@register("prompt_key", _KEY_SQL + "\nSELECT config_id, prompt_id, prompt_key FROM k", "B16")
def prompt_key(spark, d):
    g = _grid(spark, d)
    return g.select("config_id", "prompt_id", P.prompt_key("prompt_before", "prompt_after").alias("prompt_key"))


@register("prompt_strip_boilerplate", _KEY_SQL + f"""
SELECT config_id, prompt_id,
       replace(replace(replace(prompt_key, {D.lit(P.BOILERPLATE)}, ''), '}}}}?', '}}}}'), '}}}} ', '}}}}') AS label,
       replace(replace(replace(replace(prompt_key, {D.lit(P.BOILERPLATE)}, ''), '}}}}?', '}}}}'), '}}}} ', '}}}}'), '\\n', '') AS table_label
FROM k""", "B17")
def prompt_strip_boilerplate(spark, d):
    k = prompt_key(spark, d)
    return k.select("config_id", "prompt_id", P.strip_boilerplate("prompt_key").alias("label"),
                    P.strip_boilerplate("prompt_key", True).alias("table_label"))


@register("prompt_label", _KEY_SQL + f""",
lab AS (SELECT config_id, prompt_id, prompt_key,
               replace(replace(replace(prompt_key, {D.lit(P.BOILERPLATE)}, ''), '}}}}?', '}}}}'), '}}}} ', '}}}}') AS stripped
        FROM k)
SELECT config_id, prompt_id,
       CASE WHEN contains(prompt_key, {D.lit(P.ATTRIBUTION_SENTENCE)}) THEN {D.lit(P.ATTRIBUTION_SENTENCE)} ELSE 'null' END AS attribution,
       CASE WHEN stripped = '{{{{ QUESTION }}}}' THEN 'Null' ELSE 'Grounded' END AS null_vs_grounded,
       CASE WHEN contains(prompt_key, {D.lit(P.GROUNDED_MARKER)}) THEN 'Grounded' ELSE 'Null' END AS marker_label,
       CASE WHEN d = '' THEN {D.lit(P.NULL_PROMPT_TEXT)} ELSE {D.strip('d')} END AS display
FROM (SELECT *, replace({D.strip("replace(stripped, '\\n', ' ')")}, '{{{{ QUESTION }}}}', '') AS d FROM lab)""", ("B18", "B19"))
def prompt_label(spark, d):
    k = prompt_key(spark, d).withColumn("stripped", P.strip_boilerplate("prompt_key"))
    return k.select(
        "config_id", "prompt_id",
        P.attribution_label("prompt_key").alias("attribution"),
        P.null_vs_grounded("stripped").alias("null_vs_grounded"),
        P.grounded_marker_label("prompt_key").alias("marker_label"),
        P.display_text("stripped").alias("display"),
    )
