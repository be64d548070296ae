"""Metric and parser queries over the question/answer pairs derived from ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundeval.functions import answers as A
from groundeval.operators import metrics as M
from groundeval.plans import duck as D
from groundeval.plans import fixtures as fx
from groundeval.plans.catalog import register

# Run of a pair for run-level aggregates: conv_id % 7.
def _pairs(spark, d):
    return fx.pairs(spark, d).withColumn("run_id", (F.col("conv_id") % 7).cast("long"))


def _per_gold(spark, d):
    p = _pairs(spark, d)
    return p.select("pair_id", "answer", "explanation", F.posexplode("golds").alias("gold_idx", "gold"))


_PER_GOLD_SQL = "WITH " + fx.PAIRS_SQL + """,
pg AS (
  SELECT pair_id, answer, explanation, unnest(golds) AS gold, (generate_subscripts(golds, 1) - 1)::INT AS gold_idx
  FROM pairs
)"""


@register("metric_em", _PER_GOLD_SQL + f"""
SELECT pair_id, gold_idx, {D.em(D.norm_tokens('answer'), D.norm_tokens('gold'))} AS em FROM pg""", "S6")
def metric_em(spark, d):
    return _per_gold(spark, d).select("pair_id", "gold_idx", M.exact_match("answer", "gold").alias("em"))


@register("metric_f1", _PER_GOLD_SQL + f"""
SELECT pair_id, gold_idx, {D.f1(D.norm_tokens('answer'), D.norm_tokens('gold'))} AS f1 FROM pg""", "S7")
def metric_f1(spark, d):
    return _per_gold(spark, d).select("pair_id", "gold_idx", M.token_f1("answer", "gold").alias("f1"))


@register("metric_rouge_l", _PER_GOLD_SQL + f""",
tk AS (SELECT pair_id, gold_idx, {D.ws_tokens('explanation')} AS p, {D.ws_tokens('gold')} AS g FROM pg)
SELECT pair_id, gold_idx, {D.rougel('p', 'g')} AS rougel FROM tk""", "S8")
def metric_rouge_l(spark, d):
    return _per_gold(spark, d).select("pair_id", "gold_idx", M.rouge_l("explanation", "gold").alias("rougel"))


_MAX_SQL = _PER_GOLD_SQL + f""",
tk AS (SELECT pair_id, gold_idx, {D.norm_tokens('answer')} AS pa, {D.norm_tokens('gold')} AS ga,
              {D.ws_tokens('explanation')} AS pe, {D.ws_tokens('gold')} AS ge FROM pg),
sc AS (SELECT pair_id, max({D.em('pa', 'ga')}) AS em, max({D.f1('pa', 'ga')}) AS f1, max({D.rougel('pe', 'ge')}) AS rougel
       FROM tk GROUP BY pair_id)"""


@register("max_over_golds", _MAX_SQL + "\nSELECT pair_id, em, f1, rougel FROM sc", "E2")
def max_over_golds(spark, d):
    return M.score_pairs(_pairs(spark, d)).select("pair_id", "em", "f1", "rougel")


@register("run_metrics", _MAX_SQL.replace("WITH ", "WITH ", 1) + """,
runs AS (SELECT sc.*, (p.conv_id % 7)::BIGINT AS run_id FROM sc JOIN pairs p USING (pair_id))
SELECT run_id, round(avg(em), 9) AS em, round(avg(f1), 9) AS f1, round(avg(rougel), 9) AS rougel, count(*)::BIGINT AS n
FROM runs GROUP BY run_id""", "E1")
def run_metrics(spark, d):
    r = M.run_metrics(M.score_pairs(_pairs(spark, d)))
    return r.select("run_id", *[F.round(m, 9).alias(m) for m in ("em", "f1", "rougel")], "n")


@register("stored_metrics", _MAX_SQL + """,
runs AS (SELECT sc.*, (p.conv_id % 7)::BIGINT AS run_id FROM sc JOIN pairs p USING (pair_id)),
m AS (SELECT run_id, avg(em) AS em, avg(f1) AS f1, avg(rougel) AS rougel, count(*) AS n FROM runs GROUP BY run_id)
SELECT k.run_id, round_even(coalesce(em, 0.0), 3) AS em, round_even(coalesce(f1, 0.0), 3) AS f1, round_even(coalesce(rougel, 0.0), 3) AS rougel,
       coalesce(n, 0)::BIGINT AS n
FROM (SELECT DISTINCT (conv_id % 9)::BIGINT AS run_id FROM conversations) k LEFT JOIN m USING (run_id)""", "E1")
def stored_metrics(spark, d):
    """Means of runs 0 to 8 as result files hold them; runs 7 and 8 have no predictions."""
    runs = fx.table(spark, d, "conversations").select((F.col("conv_id") % 9).cast("long").alias("run_id"))
    return M.stored_metrics(M.score_pairs(_pairs(spark, d)), runs)


def _bleu_sql() -> str:
    cols = ", ".join(["sys_len", "ref_len"] + [f"correct_{n}" for n in range(1, 5)] + [f"total_{n}" for n in range(1, 5)])
    return "WITH " + fx.PAIRS_SQL + """,
src AS (SELECT pair_id, (conv_id % 7)::BIGINT AS run_id, explanation, golds FROM pairs),
""" + D.bleu_ctes("src", "pair_id", ["run_id"], "explanation", "golds") + f"""
SELECT run_id, round(bleu, 9) AS bleu, {cols} FROM bl_f"""


@register("corpus_bleu", _bleu_sql(), "E3")
def corpus_bleu(spark, d):
    b = M.corpus_bleu(_pairs(spark, d), "pair_id", "explanation", "golds", group=["run_id"])
    return b.withColumn("bleu", F.round("bleu", 9))


def _parse_sql() -> str:
    x = "pred_semicolon"
    sc = f"string_split({x}, ';')"
    nl = "string_split(lower(pred_newline), 'explanation')"
    js_ok = ("(json_valid(pred_json) AND json_extract_string(pred_json, '$.answer') IS NOT NULL "
             "AND json_extract_string(pred_json, '$.explanation') IS NOT NULL)")
    return "WITH " + fx.FORMATTED_SQL + f"""
SELECT pair_id,
       {sc}[1] AS sc_answer,
       CASE WHEN len({sc}) > 1 THEN {D.strip(sc + '[2]')} ELSE {x} END AS sc_explanation,
       upper(substr({sc}[1], 1, 1)) AS mc_answer,
       replace(replace({nl}[1], 'answer:', ''), chr(10), '') AS nl_answer,
       replace(replace(array_to_string({nl}[2:], ' '), 'explanation:', ''), chr(10), '') AS nl_explanation,
       CASE WHEN {js_ok} THEN json_extract_string(pred_json, '$.answer') ELSE pred_json END AS js_answer,
       CASE WHEN {js_ok} THEN json_extract_string(pred_json, '$.explanation') ELSE pred_json END AS js_explanation
FROM formatted"""


@register("parse_answer", _parse_sql(), ("S1", "S2", "S3", "S4", "S5"))
def parse_answer(spark, d):
    f = fx.formatted_preds(spark, d)
    sc_a, sc_e = A.parse_semicolon("pred_semicolon")
    mc_a, _ = A.parse_choice("pred_semicolon")
    nl_a, nl_e = A.parse_newline("pred_newline")
    js_a, js_e = A.parse_json("pred_json")
    return f.select(
        "pair_id",
        sc_a.alias("sc_answer"), sc_e.alias("sc_explanation"), mc_a.alias("mc_answer"),
        nl_a.alias("nl_answer"), nl_e.alias("nl_explanation"), js_a.alias("js_answer"), js_e.alias("js_explanation"),
    )


# Answers as models write them, one form per pair_id % 6: escapes and a comma at the end;
# adjacent strings and no explanation; three quotes and a constant; a number, a code escape and
# a third field; JSON; no literal at all.
def _escaped(c: str) -> str:
    return rf"replace(replace(replace(replace({c}, '\', '\\'), '''', '\'''), chr(10), '\n'), chr(13), '\r')"


_LITERALS_SQL = fx.FORMATTED_SQL + rf""",
forms AS (
  SELECT pair_id, answer, explanation, pred_json,
         CASE pair_id % 6
           WHEN 0 THEN '{{''answer'': ''' || {_escaped('answer')} || ''', ''explanation'': ''' || {_escaped('explanation')} || ''',}}'
           WHEN 1 THEN '{{"answer": ''' || {_escaped('answer')} || ''' "!", ''explanation'': None}}'
           WHEN 2 THEN '{{' || chr(10) || '  ''answer'': True,  # sure' || chr(10) || '  ''explanation'': ''''''' || {_escaped('explanation')} || ''''''' }}'
           WHEN 3 THEN '{{''answer'': -12_3.50, ''explanation'': "\x41" ''' || {_escaped('explanation')} || ''', ''more'': [1, (2, {{}})]}}'
           WHEN 4 THEN pred_json
           ELSE '{{answer: ' || answer || '}}' END AS pred
  FROM formatted
)"""


@register("parse_literals", "WITH " + _LITERALS_SQL + """
SELECT pair_id, pred,
       CASE pair_id % 6 WHEN 1 THEN answer || '!' WHEN 2 THEN 'True' WHEN 3 THEN '-123.5' WHEN 5 THEN pred ELSE answer END AS answer,
       CASE pair_id % 6 WHEN 1 THEN 'None' WHEN 3 THEN 'A' || explanation WHEN 5 THEN pred ELSE explanation END AS explanation
FROM forms""", "S4")
def parse_literals(spark, d):
    def esc(c):
        out = F.col(c)
        for old, new in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r")):
            out = F.replace(out, F.lit(old), F.lit(new))
        return out

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    n = F.col("pair_id") % 6
    pred = (
        F.when(n == 0, text("{'answer': '", esc("answer"), "', 'explanation': '", esc("explanation"), "',}"))
        .when(n == 1, text("{\"answer\": '", esc("answer"), "' \"!\", 'explanation': None}"))
        .when(n == 2, text("{\n  'answer': True,  # sure\n  'explanation': '''", esc("explanation"), "''' }"))
        .when(n == 3, text("{'answer': -12_3.50, 'explanation': \"\\x41\" '", esc("explanation"), "', 'more': [1, (2, {})]}"))
        .when(n == 4, F.col("pred_json"))
        .otherwise(text("{answer: ", F.col("answer"), "}"))
    )
    forms = fx.formatted_preds(spark, d).select("pair_id", pred.alias("pred"))
    answer, explanation = A.parse_json("pred")
    return forms.select("pair_id", "pred", answer.alias("answer"), explanation.alias("explanation"))


@register("parse_by_dataset", "WITH " + fx.FORMATTED_SQL + f""",
n AS (SELECT *, (['nq_open', '{A.RAW_DATASETS[0]}', '{A.CHOICE_DATASET}'])[pair_id % 3 + 1] AS dataset FROM formatted)
SELECT pair_id, dataset,
       CASE pair_id % 3 WHEN 1 THEN pred_semicolon WHEN 2 THEN upper(substr(string_split(pred_semicolon, ';')[1], 1, 1))
            ELSE string_split(pred_semicolon, ';')[1] END AS answer
FROM n""", ("S5", "S2", "S1"))
def parse_by_dataset(spark, d):
    """Dispatch on the dataset: raw, multiple choice and default rows in one table."""
    names = F.array(F.lit("nq_open"), F.lit(A.RAW_DATASETS[0]), F.lit(A.CHOICE_DATASET))
    f = fx.formatted_preds(spark, d).withColumn("dataset", F.element_at(names, (F.col("pair_id") % 3 + 1).cast("int")))
    parsed = A.parse_prediction(F.col("pred_semicolon"), F.lit("semicolon"), F.col("dataset"))
    return f.select("pair_id", "dataset", parsed["answer"].alias("answer"))


@register("quote_extract", f"""
SELECT doc_id,
       array_to_string(list_transform(
         list_filter(regexp_extract_all(text, {D.lit(A.QUOTE_PATTERN)}, 0),
                     lambda s: length(s) >= 2 AND left(s, 1) = right(s, 1)),
         lambda s: substr(s, 2, length(s) - 2)), '<SEP>') AS quotes
FROM documents""", "S9")
def quote_extract(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", A.extract_quotes("text").alias("quotes"))


@register("coerce_refs", "WITH " + fx.PAIRS_SQL + """
SELECT pair_id,
       CASE WHEN r IS NULL OR len(r) = 0 OR r[1] IS NULL THEN ['empty ref'] ELSE r END AS refs
FROM (SELECT pair_id,
             CASE turn % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [NULL, question] WHEN 2 THEN golds ELSE NULL::VARCHAR[] END AS r
      FROM pairs)""", "D5")
def coerce_refs(spark, d):
    p = fx.pairs(spark, d)
    t = F.col("turn") % 4
    raw = (
        F.when(t == 0, F.array().cast("array<string>"))
        .when(t == 1, F.array(F.lit(None).cast("string"), F.col("question")))
        .when(t == 2, F.col("golds"))
        .otherwise(F.lit(None).cast("array<string>"))
    )
    return p.select("pair_id", A.coerce_refs(raw).alias("refs"))

