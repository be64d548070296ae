"""Stand-in inputs derived from the driver's tables.

Each derivation exists twice: a Spark builder ``fn(spark, sf_dir) -> DataFrame`` and the
same rule as a DuckDB CTE body (``*_SQL``), so the oracle and the engine start from
identical data.  Every derivation reads whole tables; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundeval.registry import TABLE_DATASETS


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------- texts

def probe(spark, d) -> DataFrame:
    """Probe texts for the overlap score: ``benchmark`` items."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")


def corpus(spark, d) -> DataFrame:
    """Reference corpus: ``documents``."""
    return table(spark, d, "documents").select("doc_id", "text")


# --------------------------------------------------------------- question/answer pairs
# A user turn t and the assistant turn t+1 of the same conversation form one pair.
# answer      = the assistant text on one line (line breaks become spaces)
# explanation = the assistant text
# golds       = [user text, assistant text with "an" spelt "un"]; every fourth turn also the answer
# pair_id     = conv_id * 1000 + t

def _respelt():
    return F.replace(F.col("response"), F.lit("an"), F.lit("un"))


def _one_line():
    return F.replace(F.col("response"), F.lit("\n"), F.lit(" "))


def pairs(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    p = u.join(a, ["conv_id", "turn"])
    return p.select(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("pair_id"),
        "conv_id",
        "turn",
        "question",
        "response",
        _one_line().alias("answer"),
        F.col("response").alias("explanation"),
        F.when(F.col("turn") % 4 == 0, F.array("question", _respelt(), _one_line()))
        .otherwise(F.array("question", _respelt())).alias("golds"),
    )


PAIRS_SQL = """
pairs AS (
  SELECT (u.conv_id * 1000 + u.turn)::BIGINT AS pair_id, u.conv_id, u.turn,
         u.text AS question, a.text AS response,
         replace(a.text, chr(10), ' ') AS answer,
         a.text AS explanation,
         CASE WHEN u.turn % 4 = 0 THEN [u.text, replace(a.text, 'an', 'un'), replace(a.text, chr(10), ' ')]
              ELSE [u.text, replace(a.text, 'an', 'un')] END AS golds
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
)"""


def formatted_preds(spark, d) -> DataFrame:
    """The pairs with the prediction rendered in each answer format of the reference."""
    p = pairs(spark, d)
    nl = F.lit("\n")
    return p.select(
        "pair_id",
        "golds",
        "answer",
        "explanation",
        F.concat(F.col("answer"), F.lit("; "), F.col("explanation")).alias("pred_semicolon"),
        F.concat(F.lit("Answer: "), F.col("answer"), nl, F.lit("Explanation: "), F.col("explanation")).alias("pred_newline"),
        F.to_json(F.struct(F.col("answer"), F.col("explanation"))).alias("pred_json"),
        F.concat(F.lit('"'), F.col("answer"), F.lit('" '), F.col("explanation")).alias("pred_quoted"),
    )


FORMATTED_SQL = PAIRS_SQL + """,
formatted AS (
  SELECT pair_id, golds, answer, explanation,
         answer || '; ' || explanation AS pred_semicolon,
         'Answer: ' || answer || chr(10) || 'Explanation: ' || explanation AS pred_newline,
         json_object('answer', answer, 'explanation', explanation)::VARCHAR AS pred_json,
         '"' || answer || '" ' || explanation AS pred_quoted
  FROM pairs
)"""


# ------------------------------------------------------------------------ run metrics
# One lineitem row = one run: model = l_returnflag, dataset = l_linestatus,
# prompt = l_linenumber as text, overlap = l_discount, em = l_tax, f1 = l_quantity / 50.

def run_metrics_table(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("run_id"),
        F.col("l_returnflag").alias("model"),
        F.col("l_linestatus").alias("dataset"),
        F.col("l_linenumber").cast("string").alias("prompt"),
        F.col("l_discount").alias("overlap"),
        F.col("l_tax").alias("em"),
        (F.col("l_quantity") / 50).alias("f1"),
        F.col("l_extendedprice").alias("rougel"),
        F.col("l_quantity").alias("bleu"),
        F.col("l_partkey").alias("total_tokens_used"),
        F.col("l_suppkey").alias("n_answers"),
    )


RUNS_SQL = """
runs AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS run_id,
         l_returnflag AS model, l_linestatus AS dataset, CAST(l_linenumber AS VARCHAR) AS prompt,
         l_discount AS overlap, l_tax AS em, l_quantity / 50 AS f1, l_extendedprice AS rougel,
         l_quantity AS bleu, l_partkey AS total_tokens_used, l_suppkey AS n_answers
  FROM lineitem
)"""


# ------------------------------------------------------------- configs, prompts, QA table
# The four datasets of the prompt table, used as stand-in names.
DATASET_NAMES = TABLE_DATASETS
_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in DATASET_NAMES) + "]"


def configs(spark, d) -> DataFrame:
    """One configuration per supplier; prompt set = s_nationkey % 5 (a region of prompts).
    Most take all questions (9999999), every fifth a first few."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.cast("long").alias("config_id"),
        F.when(k % 3 == 0, F.concat(F.lit("You answer as "), F.col("s_name"), F.lit(".\n"))).when(k % 7 == 0, F.lit('Quote "')).otherwise(F.lit("")).alias("prompt_before"),
        F.when(k % 2 == 0, F.lit("? ")).otherwise(F.lit("")).alias("prompt_after"),
        F.element_at(F.array(F.lit("gpt3"), F.lit("t5"), F.lit("gpt-j")), (F.col("s_nationkey") % 3 + 1).cast("int")).alias("model_name"),
        F.col("s_name").alias("specific_name"),
        F.when(k % 5 == 0, k % 50 + 1).otherwise(9999999).cast("long").alias("num_examples"),
        (F.col("s_acctbal") / 10000).alias("temperature"),
        F.element_at(F.array(*[F.lit(n) for n in DATASET_NAMES]), (F.col("s_nationkey") % 4 + 1).cast("int")).alias("dataset_name"),
        F.element_at(F.array(F.lit("newline"), F.lit("json"), F.lit("semicolon"), F.lit("semicolon"), F.lit("semicolon")),
                     (k % 5 + 1).cast("int")).alias("output_format"),
        (F.col("s_nationkey") % 5).cast("long").alias("prompt_set"),
    )


CONFIGS_SQL = f"""
configs AS (
  SELECT s_suppkey::BIGINT AS config_id,
         CASE WHEN s_suppkey % 3 = 0 THEN 'You answer as ' || s_name || '.' || chr(10) WHEN s_suppkey % 7 = 0 THEN 'Quote "' ELSE '' END AS prompt_before,
         CASE WHEN s_suppkey % 2 = 0 THEN '? ' ELSE '' END AS prompt_after,
         (['gpt3', 't5', 'gpt-j'])[s_nationkey % 3 + 1] AS model_name,
         s_name AS specific_name,
         (CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 50 + 1 ELSE 9999999 END)::BIGINT AS num_examples,
         s_acctbal / 10000 AS temperature,
         ({_NAMES_SQL})[s_nationkey % 4 + 1] AS dataset_name,
         (['newline', 'json', 'semicolon', 'semicolon', 'semicolon'])[s_suppkey % 5 + 1] AS output_format,
         (s_nationkey % 5)::BIGINT AS prompt_set
  FROM supplier
)"""


def prompts(spark, d) -> DataFrame:
    """One prompt per nation, grouped in sets by region."""
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    text = F.when(k % 4 == 3, F.concat(F.lit("\nRespond to this question using the sources of "), F.col("n_name"), F.lit(".")))
    return n.select(
        F.col("n_regionkey").cast("long").alias("prompt_set"),
        k.cast("long").alias("prompt_id"),
        text.otherwise(F.concat(F.lit("\nAnswer according to "), F.col("n_name"), F.lit("."))).alias("prompt"),
        F.element_at(F.array(F.lit("before"), F.lit("after"), F.lit("other")), (k % 3 + 1).cast("int")).alias("location"),
        F.when(k % 2 == 0, F.lit("before")).otherwise(F.lit("after")).alias("location_specific"),
    )


PROMPTS_SQL = """
prompts AS (
  SELECT n_regionkey::BIGINT AS prompt_set, n_nationkey::BIGINT AS prompt_id,
         chr(10) || CASE WHEN n_nationkey % 4 = 3 THEN 'Respond to this question using the sources of ' ELSE 'Answer according to ' END || n_name || '.' AS prompt,
         (['before', 'after', 'other'])[n_nationkey % 3 + 1] AS location,
         CASE WHEN n_nationkey % 2 = 0 THEN 'before' ELSE 'after' END AS location_specific
  FROM nation
)"""


def qa_table(spark, d) -> DataFrame:
    """Canonical QA rows (M1) from the pairs: dataset by conv_id % 4, ordinal by pair_id."""
    from groundeval.operators.ordinal import dense_ordinal

    p = pairs(spark, d)
    qa = p.select(
        F.element_at(F.array(*[F.lit(n) for n in DATASET_NAMES]), (F.col("conv_id") % 4 + 1).cast("int")).alias("dataset_name"),
        F.col("pair_id").cast("string").alias("id"),
        F.col("pair_id"),
        F.col("question").alias("title"),
        F.col("golds").alias("answers"),
        F.array(F.col("response")).alias("provenance"),
    )
    return dense_ordinal(qa, ["dataset_name"], ["pair_id"]).drop("pair_id")


QA_SQL = PAIRS_SQL + f""",
qa AS (
  SELECT ({_NAMES_SQL})[conv_id % 4 + 1] AS dataset_name, CAST(pair_id AS VARCHAR) AS id,
         question AS title, golds AS answers, [response] AS provenance,
         (row_number() OVER (PARTITION BY conv_id % 4 ORDER BY pair_id) - 1)::BIGINT AS ordinal
  FROM pairs
)"""
