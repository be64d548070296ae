"""Generation (injected predictor), two-step composition, alignment, evaluation and re-scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundeval.functions import prompts as P
from groundeval.functions.answers import CHOICE_DATASET, RAW_DATASETS
from groundeval.operators import evaluate as EV
from groundeval.operators import generate as GN
from groundeval.operators import grid as G
from groundeval.plans import duck as D
from groundeval.plans import fixtures as fx
from groundeval.plans import queries_grid as QG
from groundeval.plans.catalog import register

ECHO_K = 5
_HOSTED_SQL = "(" + ", ".join(D.lit(m) for m in P.HOSTED_MODELS) + ")"


def _fw(x: str, n: int) -> str:
    return f"array_to_string({D.ws_tokens(x)}[1:{n}], ' ')"


def _echo(x: str) -> str:
    return f"({x} || ' ' || {_fw(x, ECHO_K)})"


_GEN_SQL = QG._RENDER_SQL + f""",
gs AS (SELECT r.run_id, r.id, r.p_single AS prompt, e.model_name FROM rd r JOIN ex e ON r.run_id = e.run_id AND r.id = e.id WHERE r.single)
SELECT run_id, id,
       CASE WHEN lower(model_name) IN {_HOSTED_SQL} THEN {D.strip(_echo('prompt'))}
            ELSE replace({_echo('prompt')}, prompt, '') END AS pred
FROM gs"""


@register("generate", _GEN_SQL, ("G1", "S19"))
def generate(spark, d):
    r = QG._rendered(spark, d).where(F.col("mode") == "single")
    r = r.select("run_id", "id", "prompt", F.lower("model_name").isin(*P.HOSTED_MODELS).alias("hosted"))
    g = GN.generate(r, lambda: GN.EchoPredictor(ECHO_K), batch_size=64, spread=False)
    return g.select("run_id", "id", GN.clean_generation("generation", "prompt", F.col("hosted")).alias("pred"))


class _Failing:
    """Refuses batches that hold a prompt of some length, as a service over its limit would."""

    def __call__(self, prompts: list[str]) -> list[str]:
        if any(len(p) % 509 == 0 for p in prompts):
            raise TimeoutError("over the limit")
        return GN.EchoPredictor(ECHO_K)(prompts)


@register("generate_resumed", "WITH " + fx.PAIRS_SQL + f"""
SELECT (conv_id % 7)::BIGINT AS run_id, pair_id AS idx, {_echo('question')} AS generation, 'ok' AS status FROM pairs""", "G1")
def generate_resumed(spark, d):
    """A first call that answers what it can and records what failed; a second one with the same
    log, and a predictor that works, asks for the rest only."""
    import uuid

    from groundeval.operators.generation_log import generate_logged
    from groundeval.session import checkpoint_dir

    p = fx.pairs(spark, d).select((F.col("conv_id") % 7).cast("long").alias("run_id"), F.col("pair_id").alias("idx"), F.col("question").alias("prompt"))
    log = f"{checkpoint_dir(spark)}/generation-{uuid.uuid4().hex}"
    generate_logged(p, _Failing, log, max_attempts=1)
    g = generate_logged(p, lambda: GN.EchoPredictor(ECHO_K), log, max_attempts=2)
    return g.select("run_id", "idx", "generation", "status")


_TWO_SQL = QG._RENDER_SQL + f""",
t1 AS (SELECT run_id, id, p1, p2, {D.strip(f"replace({_echo('p1')}, p1, '')")} AS a FROM rd WHERE NOT single),
t2 AS (SELECT run_id, id, a, replace(p2, 'ANSWER', a) AS p2f FROM t1)
SELECT run_id, id, a || ';' || {D.strip(f"replace({_echo('p2f')}, p2f, '')")} AS pred FROM t2"""


@register("generate_two_step", _TWO_SQL, "G2")
def generate_two_step(spark, d):
    r = QG._rendered(spark, d).where(F.col("mode") == "two_step").select("run_id", "id", "prompt", "prompt_2")
    g = GN.generate_two_step(r, lambda: GN.EchoPredictor(ECHO_K), batch_size=64, spread=False, cols=["run_id", "id"])
    return g.select("run_id", "id", "pred")


@register("two_step_compose", QG._RENDER_SQL + f""",
o AS (SELECT run_id, id, p1, p2, p1 || ' ' || title AS answer_out, title FROM rd JOIN ex USING (run_id, id) WHERE NOT single),
o2 AS (SELECT *, {D.strip("replace(answer_out, p1, '')")} AS a FROM o)
SELECT run_id, id,
       a || ';' || {D.strip("replace(replace(p2, 'ANSWER', a) || ' because ' || title, replace(p2, 'ANSWER', a), '')")} AS pred
FROM o2""", "S16")
def two_step_compose(spark, d):
    r = QG._rendered(spark, d).where(F.col("mode") == "two_step")
    ans_out = F.concat(F.col("prompt"), F.lit(" "), F.col("title"))
    ans = P.strip_ends(F.replace(ans_out, F.col("prompt"), F.lit("")))
    expl_out = F.concat(P.fill_answer_slot("prompt_2", ans), F.lit(" because "), F.col("title"))
    return r.select("run_id", "id", P.compose_two_step("prompt", ans_out, "prompt_2", expl_out).alias("pred"))


@register("join_candidates", "WITH " + fx.PAIRS_SQL + f"""
SELECT pair_id, array_to_string(list_transform([' ' || answer || ' ', explanation, chr(10) || question], lambda c: {D.strip('c')}), ' ') AS text
FROM pairs""", "S19")
def join_candidates(spark, d):
    p = fx.pairs(spark, d)
    c = F.array(F.concat(F.lit(" "), "answer", F.lit(" ")), F.col("explanation"), F.concat(F.lit("\n"), "question"))
    return p.select("pair_id", P.join_candidates(c).alias("text"))


@register("align_predictions", QG._EXPAND_SQL + """,
q AS (SELECT run_id, ordinal AS idx, id FROM ex),
p AS (SELECT run_id, ordinal AS idx, title AS pred FROM ex WHERE ordinal % 7 <> 3
      UNION ALL SELECT DISTINCT run_id, num_examples AS idx, 'extra' FROM ex WHERE config_id % 5 = 0)
SELECT coalesce(q.run_id, p.run_id) AS run_id, coalesce(q.idx, p.idx)::BIGINT AS idx, q.id, p.pred,
       CASE WHEN q.run_id IS NULL THEN 'missing_question' WHEN p.run_id IS NULL THEN 'missing_pred' ELSE 'ok' END AS status
FROM q FULL OUTER JOIN p ON q.run_id = p.run_id AND q.idx = p.idx""", "C8")
def align_predictions(spark, d):
    """Questions and predictions come from the same tiles of the expansion and are aligned there.  Runs
    that share their id in several datasets have their rows in several tiles: these are joined."""
    sets = F.size(F.collect_set("dataset_name").over(Window.partitionBy("run_id")))
    runs, qa = QG._runs(spark, d).withColumn("_several", sets > 1), fx.qa_table(spark, d)
    parts = []
    for several, within in ((False, ["dataset_name", *G.TILE]), (True, [])):
        own = runs.where(F.col("_several") == several)
        tasks = G.pair_tasks(own, qa)
        if several and not tasks:
            continue
        ex = G.run_expand(own, qa, run_cols=["run_id"], tiles=True, tasks=tasks)
        tile = lambda idx: [F.floor(F.col(idx) / F.col("_wide")).alias(c) if c == "_block" else F.col(c) for c in within]
        q = ex.select("run_id", F.col("ordinal").alias("idx"), "id", *within)
        p1 = ex.where(F.col("ordinal") % 7 != 3).select("run_id", F.col("ordinal").alias("idx"), F.col("title").alias("pred"), *within)
        p2 = ex.where(F.col("config_id") % 5 == 0).select("run_id", F.col("num_examples").alias("idx"), F.lit("extra").alias("pred"), *tile("num_examples")).distinct()
        if within and tasks:  # dealt as the rows of the expansion are
            p2 = p2.repartition(tasks, *within)
        parts.append(G.align_predictions(q, p1.unionByName(p2), within=within))
    a = reduce(DataFrame.unionByName, parts)
    return a.select("run_id", F.col("idx").cast("long").alias("idx"), "id", "pred", "status")


# ------------------------------------------------------------------------------ evaluation

def _eval_source(spark, d):
    """Predictions for evaluation: pairs in 12 runs, dataset and answer format per run.  Every
    question is answered by three runs (run, run + 4, run + 8), by the second with the
    response of the question before it in the conversation and by the third with none, so
    runs share question keys and differ in their scores."""
    f = fx.formatted_preds(spark, d)
    p = fx.pairs(spark, d).select("pair_id", "conv_id", "question", "response")
    j = f.join(p, "pair_id").withColumn("arm", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    run = (F.col("conv_id") % 4 + F.col("arm") * 4).cast("long")
    fmt = F.element_at(F.array(F.lit("semicolon"), F.lit("newline"), F.lit("json")), (run % 3 + 1).cast("int"))
    pred = F.when(fmt == "newline", F.col("pred_newline")).when(fmt == "json", F.col("pred_json")).otherwise(F.col("pred_semicolon"))
    pred = F.when(F.col("arm") == 0, pred).when(F.col("arm") == 1, F.concat(F.lit("No idea; "), "question")).otherwise(F.lit(""))
    return j.select(
        run.alias("run_id"), "pair_id",
        F.element_at(F.array(*[F.lit(n) for n in fx.DATASET_NAMES]), (run % 4 + 1).cast("int")).alias("dataset_name"),
        fmt.alias("output_format"), pred.alias("pred"), "golds",
        F.array(F.concat_ws(" ", "question", "response")).alias("provenance"),
    )


_EVAL_SRC_SQL = fx.FORMATTED_SQL + f""",
arms AS (
  SELECT (p.conv_id % 4 + a.arm * 4)::BIGINT AS run_id, a.arm, f.*, p.question, p.response
  FROM formatted f JOIN pairs p ON f.pair_id = p.pair_id CROSS JOIN (VALUES (0), (1), (2)) a(arm)
),
src AS (
  SELECT run_id, pair_id, ({fx._NAMES_SQL})[run_id % 4 + 1] AS dataset_name,
         (['semicolon', 'newline', 'json'])[run_id % 3 + 1] AS output_format,
         CASE WHEN arm = 1 THEN 'No idea; ' || question WHEN arm = 2 THEN ''
              ELSE CASE (run_id % 3) WHEN 1 THEN pred_newline WHEN 2 THEN pred_json ELSE pred_semicolon END END AS pred,
         golds, [question || ' ' || response] AS provenance
  FROM arms
)"""


def _parse_sql(x: str, fmt: str, ds: str) -> tuple[str, str]:
    sc = f"string_split({x}, ';')"
    nl = f"string_split(lower({x}), 'explanation')"
    ok = f"(json_valid({x}) AND json_extract_string({x}, '$.answer') IS NOT NULL AND json_extract_string({x}, '$.explanation') IS NOT NULL)"
    js_a = f"CASE WHEN {ok} THEN json_extract_string({x}, '$.answer') ELSE {x} END"
    js_e = f"CASE WHEN {ok} THEN json_extract_string({x}, '$.explanation') ELSE {x} END"
    nl_a = f"replace(replace({nl}[1], 'answer:', ''), chr(10), '')"
    nl_e = f"replace(replace(array_to_string({nl}[2:], ' '), 'explanation:', ''), chr(10), '')"
    sc_e = f"CASE WHEN len({sc}) > 1 THEN {D.strip(sc + '[2]')} ELSE {x} END"
    raw = f"{ds} IN ({', '.join(D.lit(r) for r in RAW_DATASETS)})"
    f = f"lower(coalesce({fmt}, 'semicolon'))"
    ans = (f"CASE WHEN {raw} THEN {x} WHEN {f} = 'json' THEN {js_a} WHEN {f} = 'newline' THEN {nl_a} "
           f"WHEN {ds} = {D.lit(CHOICE_DATASET)} THEN upper(substr({sc}[1], 1, 1)) ELSE {sc}[1] END")
    expl = f"CASE WHEN {raw} THEN {x} WHEN {f} = 'json' THEN {js_e} WHEN {f} = 'newline' THEN {nl_e} ELSE {sc_e} END"
    return ans, expl


def _coerce(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL OR len({x}) = 0 OR {x}[1] IS NULL THEN ['empty ref'] ELSE {x} END)"


def _has_prov(ds: str) -> str:
    return f"({ds} NOT IN ({', '.join(D.lit(n) for n in EV.NO_PROVENANCE)}) AND NOT contains(lower({ds}), 'popularity'))"


def _eval_sql(src_ctes: str, with_overlap: bool = True) -> str:
    a, e = _parse_sql("pred", "output_format", "dataset_name")
    ov = ""
    ov_join = ""
    ov_col = ""
    if with_overlap:
        ov = f""",
pgr AS (SELECT run_id, pair_id, pos, substr(pred, pos + 1, 25) AS gram
        FROM (SELECT run_id, pair_id, pred, unnest(range(0, greatest(length(pred) - 24, 0))) AS pos FROM src)),
cgr AS (SELECT DISTINCT gram FROM (SELECT substr(text, pos + 1, 25) AS gram
        FROM (SELECT text, unnest(range(0, greatest(length(text) - 24, 0))) AS pos FROM documents)) WHERE gram IN (SELECT gram FROM pgr)),
ovp AS (SELECT s.run_id, s.pair_id, coalesce(h.hits / h.segs, 0.0) AS overlap FROM src s LEFT JOIN (
          SELECT run_id, pair_id, count(*) AS segs, sum(CASE WHEN c.gram IS NOT NULL THEN 1 ELSE 0 END) AS hits
          FROM pgr LEFT JOIN cgr c ON pgr.gram = c.gram GROUP BY run_id, pair_id) h ON s.pair_id = h.pair_id AND s.run_id = h.run_id),
ovr AS (SELECT run_id, 'answers' AS target, avg(overlap) AS avg_percent_overlap FROM ovp GROUP BY run_id)"""
        ov_join = "LEFT JOIN ovr USING (run_id, target)"
        ov_col = ", round(ovr.avg_percent_overlap, 9) AS avg_percent_overlap"
    return "WITH " + src_ctes + f""",
parsed AS (SELECT *, {a} AS answer, {e} AS explanation FROM src),
tg AS (
  SELECT run_id, pair_id, 'answers' AS target, answer, explanation, {_coerce('golds')} AS golds FROM parsed
  UNION ALL
  SELECT run_id, pair_id, 'provenance', answer, explanation, {_coerce('provenance')} FROM parsed WHERE {_has_prov('dataset_name')}
),
pg AS (SELECT run_id, pair_id, target, answer, explanation, unnest(golds) AS gold FROM tg),
tk AS (SELECT run_id, pair_id, target, {D.norm_tokens('answer')} AS pa, {D.norm_tokens('gold')} AS ga,
              {D.ws_tokens('explanation')} AS pe, {D.ws_tokens('gold')} AS ge FROM pg),
sc AS (SELECT run_id, pair_id, target, max({D.em('pa', 'ga')}) AS em, max({D.f1('pa', 'ga')}) AS f1,
              max({D.rougel('pe', 'ge')}) AS rougel FROM tk GROUP BY run_id, pair_id, target),
means AS (SELECT run_id, target, avg(em) AS em, avg(f1) AS f1, avg(rougel) AS rougel, count(*)::BIGINT AS n
          FROM sc GROUP BY run_id, target),
{D.bleu_ctes('tg', "CAST(run_id AS VARCHAR) || '|' || CAST(pair_id AS VARCHAR) || '|' || target", ['run_id', 'target'], 'explanation', 'golds')}{ov}
SELECT means.run_id, means.target, round(means.em, 9) AS em, round(means.f1, 9) AS f1, round(means.rougel, 9) AS rougel,
       means.n, round(bl_f.bleu, 9) AS bleu{ov_col}
FROM means LEFT JOIN bl_f USING (run_id, target) {ov_join}"""


def _rounded_eval(df, overlap=True):
    cols = ["run_id", "target"] + [F.round(c, 9).alias(c) for c in ("em", "f1", "rougel")] + [F.col("n").cast("long"), F.round("bleu", 9).alias("bleu")]
    if overlap:
        cols.append(F.round("avg_percent_overlap", 9).alias("avg_percent_overlap"))
    return df.select(*cols)


@register("evaluate", _eval_sql(_EVAL_SRC_SQL), ("G5", "E1", "E3", "E4", "D3", "D5"))
def evaluate(spark, d):
    return _rounded_eval(EV.evaluate(_eval_source(spark, d), fx.corpus(spark, d)))


@register("provenance_eval", "WITH " + _EVAL_SRC_SQL + f""",
parsed AS (SELECT *, {_parse_sql('pred', 'output_format', 'dataset_name')[0]} AS answer,
                     {_parse_sql('pred', 'output_format', 'dataset_name')[1]} AS explanation FROM src),
tg AS (
  SELECT run_id, pair_id, 'answers' AS target, answer, explanation, {_coerce('golds')} AS golds FROM parsed
  UNION ALL
  SELECT run_id, pair_id, 'provenance', answer, explanation, {_coerce('provenance')} FROM parsed WHERE {_has_prov('dataset_name')}
),
pg AS (SELECT run_id, pair_id, target, answer, explanation, unnest(golds) AS gold FROM tg),
tk AS (SELECT run_id, pair_id, target, {D.norm_tokens('answer')} AS pa, {D.norm_tokens('gold')} AS ga,
              {D.ws_tokens('explanation')} AS pe, {D.ws_tokens('gold')} AS ge FROM pg)
SELECT run_id, pair_id, target, max({D.em('pa', 'ga')}) AS em, max({D.f1('pa', 'ga')}) AS f1, max({D.rougel('pe', 'ge')}) AS rougel
FROM tk GROUP BY run_id, pair_id, target""", ("G4", "D3"))
def provenance_eval(spark, d):
    s = EV.score_targets(_eval_source(spark, d))
    return s.select("run_id", "pair_id", "target", "em", "f1", "rougel")


def _stored_runs(spark, d):
    """Run records (one per conversation) with parallel arrays, as the result files hold them."""
    f = fx.formatted_preds(spark, d).join(fx.pairs(spark, d).select("pair_id", "conv_id", "turn", "question", "response"), "pair_id")
    rows = f.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "pred_semicolon", "golds", "question", "response"))).alias("r")
    )
    return rows.select(
        F.col("conv_id").cast("long").alias("run_id"),
        F.struct(F.element_at(F.array(*[F.lit(n) for n in fx.DATASET_NAMES]), (F.col("conv_id") % 4 + 1).cast("int")).alias("dataset"),
                 F.lit("semicolon").alias("output_format")).alias("params"),
        F.transform("r", lambda x: x["pred_semicolon"]).alias("pred"),
        F.transform("r", lambda x: x["golds"]).alias("refs"),
        F.transform("r", lambda x: x["question"]).alias("questions"),
        F.transform("r", lambda x: F.array(x["response"])).alias("provenances"),
    )


@register("rescore_runs", _eval_sql(fx.FORMATTED_SQL + f""",
src AS (
  SELECT p.conv_id::BIGINT AS run_id, f.pair_id, ({fx._NAMES_SQL})[p.conv_id % 4 + 1] AS dataset_name,
         'semicolon' AS output_format, f.pred_semicolon AS pred, f.golds, [p.response] AS provenance
  FROM formatted f JOIN pairs p ON f.pair_id = p.pair_id
)"""), "G3")
def rescore_runs(spark, d):
    """Stored run files, written and read back, scored again."""
    from groundeval.plans.queries_sources import stored_run_files

    return _rounded_eval(EV.rescore_runs(stored_run_files(spark, d), fx.corpus(spark, d)))


_RECORD_SQL = _eval_sql(_EVAL_SRC_SQL).partition("SELECT means.run_id")[0].rstrip() + """
SELECT sc.run_id, sc.target, list(sc.em ORDER BY sc.pair_id) AS em_list, list(sc.f1 ORDER BY sc.pair_id) AS f1_list,
       list(sc.rougel ORDER BY sc.pair_id) AS rougel_list, list(ovp.overlap ORDER BY sc.pair_id) AS percent_overlap_list
FROM sc JOIN ovp ON sc.run_id = ovp.run_id AND sc.pair_id = ovp.pair_id GROUP BY sc.run_id, sc.target"""


@register("run_record", _RECORD_SQL, ("A9", "G3"))
def run_record(spark, d):
    """The lists of the result record, written with the runs as files and read back."""
    import uuid

    from groundeval.session import checkpoint_dir
    from groundeval.sources import readers as RD
    from groundeval.sources import writers as W

    src, corpus = _eval_source(spark, d).withColumnRenamed("pair_id", "idx"), fx.corpus(spark, d)
    runs = src.groupBy("run_id").agg(F.struct(F.min("dataset_name").alias("dataset"), F.min("output_format").alias("output_format")).alias("params"))
    preds = src.select("run_id", "idx", F.lit("").alias("question"), "pred", F.col("golds").alias("refs"), F.col("provenance").alias("provenances"))
    path = f"{checkpoint_dir(spark)}/records-{uuid.uuid4().hex}"
    W.write_runs(preds, runs, path, scores=EV.score_rows(src, corpus, key="idx"), summary=EV.evaluate(src, corpus, key="idx"))
    rec = RD.read_runs(spark, path)
    one = lambda t: rec.where(F.col(f"results.{t}").isNotNull()).select(
        "run_id", F.lit(t).alias("target"), *[F.col(f"results.{t}.{m}_list").alias(f"{m}_list") for m in ("em", "f1", "rougel")],
        F.col("results.datasketch.percent_overlap_list").alias("percent_overlap_list"))
    return one("answers").unionByName(one("provenance"))
