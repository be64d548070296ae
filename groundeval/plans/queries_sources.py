"""Round trips through the sinks and readers: each query writes a table derived from the
driver data under the session's checkpoint folder (shared storage on a cluster) and reads
it back with the reader under test; the oracle computes the same table directly."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundeval.operators import evaluate as EV
from groundeval.session import checkpoint_dir
from groundeval.sources import readers as RD
from groundeval.sources import writers as W
from groundeval.plans import fixtures as fx
from groundeval.plans import queries_popularity as QP
from groundeval.plans import queries_reports as QR
from groundeval.plans.catalog import register


def _scratch(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "roundtrip", f"{name}-{uuid.uuid4().hex}")


@register("read_jsonl", "WITH " + fx.PAIRS_SQL + """
SELECT CAST(pair_id AS VARCHAR) AS id, question AS title, golds AS answers, [response] AS provenance, turn::BIGINT AS popularity
FROM pairs""", ("A1", "A8"))
def read_jsonl(spark, d):
    p = fx.pairs(spark, d).select(F.col("pair_id").cast("string").alias("id"), F.col("question").alias("title"),
                                  F.col("golds").alias("answers"), F.array("response").alias("provenance"),
                                  F.col("turn").cast("long").alias("popularity"))
    path = _scratch(spark, "jsonl")
    W.write_jsonl(p, path)
    return RD.read_jsonl(spark, path, RD.QA_SCHEMA)


@register("read_indexed_csv", QP._SAMPLE_SQL + f"""
SELECT CAST((row_number() OVER (ORDER BY bin_id, rn) - 1) AS VARCHAR) AS id, CAST(id AS VARCHAR) AS title,
       [CAST(o_custkey AS VARCHAR)] AS answers, '' AS provenance, CAST(popularity AS VARCHAR) AS popularity
FROM s WHERE rn <= 400""", ("A2", "A12", "Q9"))
def read_indexed_csv(spark, d):
    s = QP.popularity_set(spark, d)
    out = s.select(F.col("id").alias("_c0"), F.col("id").cast("string").alias("id"), "title",
                   F.to_json("answers").alias("answers"), "provenance", "popularity")
    path = _scratch(spark, "csv")
    W.write_table(out, path, fmt="csv")
    back = RD.read_indexed_csv(spark, path, {"answers": T.ArrayType(T.StringType())})
    return back.select("id", "title", "answers", F.coalesce("provenance", F.lit("")).alias("provenance"), "popularity")


@register("read_summaries", QR.SUMMARY_SQL + f"\nSELECT prompt, dataset, model, {QR._SUM_OUT} FROM summary", ("A3", "A5", "A10", "A11"))
def read_summaries(spark, d):
    summary = QR._rounded(QR._summary(spark, d)).drop("n_runs")
    root = _scratch(spark, "summaries")
    W.write_summaries(summary, root)
    W.write_combined(QR._flat(spark, d), os.path.join(root, "results.csv"))
    return RD.read_summaries(spark, root)


def stored_run_files(spark, d):
    """The derived runs, written as result files and read back."""
    from groundeval.plans.queries_generate import _stored_runs

    runs = _stored_runs(spark, d)
    rows = runs.select("run_id", F.posexplode(F.arrays_zip("questions", "pred", "refs", "provenances")).alias("idx", "r")).select(
        "run_id", F.col("idx").cast("long").alias("idx"), F.col("r.questions").alias("question"), F.col("r.pred").alias("pred"),
        F.col("r.refs").alias("refs"), F.col("r.provenances").alias("provenances"))
    path = _scratch(spark, "runs")
    W.write_runs(rows, runs.select("run_id", "params", F.lit(None).cast(RD.RUN_SCHEMA["results"].dataType).alias("results")), path)
    return RD.read_runs(spark, path)


@register("read_runs", "WITH " + fx.PAIRS_SQL + """
SELECT conv_id::BIGINT AS run_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS idx,
       question, answer || '; ' || explanation AS pred, golds, [response] AS provenance
FROM pairs""", ("A4", "A9"))
def read_runs(spark, d):
    back = EV.runs_to_rows(stored_run_files(spark, d))
    return back.select("run_id", "idx", "question", "pred", "golds", "provenance")


@register("read_keyed_json", """
SELECT CAST(doc_id AS VARCHAR) AS id, source AS QUESTION,
       CASE WHEN doc_id % 2 = 1 THEN 'yes' ELSE 'no' END AS final_decision
FROM documents""", ("A6", "M5"))
def read_keyed_json(spark, d):
    doc = fx.table(spark, d, "documents").select(
        "doc_id", F.col("source").alias("QUESTION"),
        F.when(F.col("doc_id") % 2 == 1, F.lit("yes")).otherwise(F.lit("no")).alias("final_decision"))
    path = _scratch(spark, "keyed")
    W.write_keyed_json(doc, path, "doc_id")
    vt = T.StructType([T.StructField("QUESTION", T.StringType()), T.StructField("final_decision", T.StringType())])
    return RD.read_keyed_json(spark, path, vt, per_line=True)


@register("read_tsv", "WITH " + QR.FLAT_SQL + """
SELECT run_id, dataset, model, "ds-25-overlap", em FROM flat""", ("A3", "A11"))
def read_tsv(spark, d):
    """The combined per-run table, written as TSV and read back whole."""
    flat = QR._flat(spark, d).select("run_id", "dataset", "model", "ds-25-overlap", "em")
    path = _scratch(spark, "combined")
    W.write_combined(flat, path)
    return RD.read_tsv(spark, path, flat.schema)


@register("load_datasets", "WITH " + fx.PAIRS_SQL + """
SELECT 'ELI5_dev' AS dataset, CAST(pair_id AS VARCHAR) AS id, question AS title, golds AS answers, [response] AS provenance, NULL::BIGINT AS popularity FROM pairs
UNION ALL SELECT 'nq_popularity', CAST(pair_id AS VARCHAR), question, golds, [response], turn::BIGINT FROM pairs
UNION ALL SELECT 'nq_open', 'n/a', question, golds, ['empty n/a'], NULL FROM pairs
UNION ALL SELECT 'trivia_qa', CAST(pair_id AS VARCHAR), question, golds, ['empty n/a'], NULL FROM pairs
UNION ALL SELECT 'jhu-clsp/SARA', CAST(pair_id AS VARCHAR), 'Premise: ' || response || chr(10) || 'Hypothesis: ' || question, [answer], ['empty n/a'], NULL FROM pairs
UNION ALL SELECT 'aldrinc/medicationqa', CAST(pair_id AS VARCHAR), question, [response], ['empty n/a'], NULL FROM pairs""", ("A7", "M16"))
def load_datasets(spark, d):
    """Six datasets in their stored formats, read and adapted by name through the registry."""
    from groundeval.operators.datasets import load_datasets as load
    from groundeval.registry import BY_NAME

    p, root = fx.pairs(spark, d), _scratch(spark, "registry")
    at = lambda name: f"{root}/{BY_NAME[name].location}"
    pid = F.col("pair_id").cast("string").alias("id")
    W.write_jsonl(p.select(pid, F.col("question").alias("title"), F.col("golds").alias("answers"), F.array("response").alias("provenance")), at("ELI5_dev"))
    W.write_table(p.select(F.col("pair_id").alias("_c0"), pid, F.col("question").alias("title"), F.to_json("golds").alias("answers"),
                           F.to_json(F.array("response")).alias("provenance"), F.col("turn").alias("popularity")), at("nq_popularity"), fmt="csv")
    W.write_table(p.select("question", F.col("golds").alias("answer")), at("nq_open"))
    W.write_table(p.select(F.col("pair_id").alias("question_id"), "question", F.struct(F.col("golds").alias("aliases")).alias("answer")), at("trivia_qa"))
    W.write_table(p.select(pid, F.col("response").alias("text"), "question", "answer"), at("jhu-clsp/SARA"))
    W.write_table(p.select(F.col("pair_id").alias("ordinal"), F.col("question").alias("Question"), F.col("response").alias("Answer")), at("aldrinc/medicationqa"))
    names = ["ELI5_dev", "nq_popularity", "nq_open", "trivia_qa", "jhu-clsp/SARA", "aldrinc/medicationqa"]
    return load(spark, names, root).select("dataset", "id", "title", "answers", "provenance", "popularity")


@register("read_registry", "WITH " + fx.PAIRS_SQL + """
SELECT 'qa' AS dataset, CAST(pair_id AS VARCHAR) AS id, question AS title FROM pairs
UNION ALL SELECT 'dialogue', CAST(pair_id AS VARCHAR), response FROM pairs""", "A7")
def read_registry(spark, d):
    """Two groups of name and path; the second group's path wins for a name in both."""
    p, root = fx.pairs(spark, d), _scratch(spark, "groups")
    pid = F.col("pair_id").cast("string").alias("id")
    W.write_jsonl(p.select(pid, F.col("question").alias("title")), f"{root}/a.jsonl")
    W.write_jsonl(p.select(pid, F.col("response").alias("title")), f"{root}/b.jsonl")
    groups = [{"qa": f"{root}/a.jsonl", "dialogue": f"{root}/a.jsonl"}, {"dialogue": f"{root}/b.jsonl"}]
    return RD.read_registry(spark, groups, "id string, title string").select("dataset", "id", "title")


@register("file_ordinals", """
SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS ordinal, doc_id, 'parquet' AS fmt FROM documents
UNION ALL SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT, doc_id, 'json' FROM documents""", ("W1", "B5"))
def file_ordinals(spark, d):
    """Row numbers of files in path order, for tables written in the order of ``doc_id``."""
    from groundeval.operators.ordinal import file_ordinal

    root = _scratch(spark, "ordinals")
    docs = fx.table(spark, d, "documents").repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id")
    docs.write.parquet(f"{root}/parquet")
    docs.write.json(f"{root}/json")
    read = {"parquet": spark.read.parquet(f"{root}/parquet"), "json": spark.read.schema("doc_id long, text string").json(f"{root}/json")}
    parts = [file_ordinal(df, fmt=fmt).select("ordinal", "doc_id", F.lit(fmt).alias("fmt")) for fmt, df in read.items()]
    return parts[0].unionByName(parts[1])


OBJECT_BYTES = 64_000_000


def object_files(doc) -> int:
    """A file is written by one task: as many files as keep one at about ``OBJECT_BYTES`` of texts, two at least."""
    size = doc.agg(F.sum(F.octet_length("QUESTION"))).first()[0] or 0
    return max(2, -(-size // OBJECT_BYTES))


@register("read_keyed_objects", """
SELECT CAST(doc_id AS VARCHAR) AS id, text AS QUESTION, [source, lang] AS CONTEXTS, 'a, {"b": [' || n_chars || ']}' AS final_decision
FROM documents""", ("A6", "M5"))
def read_keyed_objects(spark, d):
    """Pretty-printed objects, one a file, with whole texts inside; cut into entries by many tasks."""
    decision = F.concat(F.lit('a, {"b": ['), F.col("n_chars").cast("string"), F.lit("]}"))
    doc = fx.table(spark, d, "documents").select("doc_id", F.col("text").alias("QUESTION"), F.array("source", "lang").alias("CONTEXTS"), decision.alias("final_decision"))
    path = _scratch(spark, "objects")
    W.write_keyed_objects(doc, path, "doc_id", files=object_files(doc))
    return RD.read_keyed_json(spark, path, T.StructType(list(doc.schema.fields[1:])))


@register("read_multiline_csv", "WITH " + fx.PAIRS_SQL + """
SELECT CAST(pair_id AS VARCHAR) AS id, question AS title, response AS answer, golds FROM pairs""", ("A2", "A12"))
def read_multiline_csv(spark, d):
    """Whole responses, with their line breaks and quotes, as CSV fields."""
    p = fx.pairs(spark, d).select(F.col("pair_id").alias("_c0"), F.col("pair_id").cast("string").alias("id"), F.col("question").alias("title"),
                                  F.col("response").alias("answer"), F.to_json("golds").alias("golds"))
    path = _scratch(spark, "lines")
    W.write_table(p, path, fmt="csv")
    return RD.read_indexed_csv(spark, path, {"golds": T.ArrayType(T.StringType())})
