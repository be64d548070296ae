"""Dataset adapters onto the canonical QA table (M1):
``id string, title string, answers array<string>, provenance array<string> [, popularity]``.

Each adapter is a projection; nothing here shuffles except the explicit ordinal
assignment and the positional attach (an equi-join on the ordinal).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the canonical schema and its placeholders.
CANONICAL4 = ["id", "title", "answers", "provenance"]
CANONICAL5 = CANONICAL4 + ["popularity"]
CODE_TASK_COLS = ["id", "title", "answers", "meta", "test"]
NO_PROVENANCE = "empty n/a"
CHOICE_LETTERS = ["A", "B", "C", "D"]


def _no_prov() -> Column:
    return F.array(F.lit(NO_PROVENANCE))


def canonical_by_position(df: DataFrame) -> DataFrame:
    """Positional rename: more than four columns → the five canonical names, else four."""
    n = len(df.columns)
    if n > 4:
        if n != 5:
            raise ValueError(f"positional rename expects 4 or 5 columns, got {n}")
        return df.toDF(*CANONICAL5)
    if n != 4:
        raise ValueError(f"positional rename expects 4 or 5 columns, got {n}")
    return df.toDF(*CANONICAL4)


def canonical_by_name(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename by name (``{source: canonical}``) and keep canonical columns in order."""
    out = df.withColumnsRenamed(mapping)
    return out.select(*[c for c in CANONICAL5 if c in out.columns])


def open_qa(df: DataFrame, question="question", answer="answer") -> DataFrame:
    return df.select(
        F.lit("n/a").alias("id"), F.col(question).alias("title"), F.col(answer).alias("answers"), _no_prov().alias("provenance")
    )


def nested_alias_qa(df: DataFrame, qid="question_id", question="question", answer="answer") -> DataFrame:
    return df.select(
        F.col(qid).cast("string").alias("id"), F.col(question).alias("title"),
        F.col(answer)["aliases"].alias("answers"), _no_prov().alias("provenance"),
    )


def multiple_choice_qa(df: DataFrame, question="question", options="options", answer_idx="answer_idx", index="ordinal") -> DataFrame:
    """``question + "\\nOptions:\\n" + "A: ..\\nB: ..\\nC: ..\\nD: ..\\n"``, answers = [letter]."""
    opts = [F.concat(F.lit(f"{k}: "), F.col(options)[k], F.lit("\n")) for k in CHOICE_LETTERS]
    return df.select(
        F.col(index).cast("string").alias("id"),
        F.concat(F.col(question), F.lit("\nOptions:\n"), *opts).alias("title"),
        F.array(F.col(answer_idx)).alias("answers"),
        _no_prov().alias("provenance"),
    )


def long_answer_qa(df: DataFrame, question="Question", answer="Answer", index="ordinal") -> DataFrame:
    return df.select(
        F.col(index).cast("string").alias("id"), F.col(question).alias("title"),
        F.array(F.col(answer)).alias("answers"), _no_prov().alias("provenance"),
    )


def entailment_qa(df: DataFrame, id_col="id", text="text", question="question", answer="answer") -> DataFrame:
    return df.select(
        F.col(id_col).cast("string").alias("id"),
        F.concat(F.lit("Premise: "), F.col(text), F.lit("\nHypothesis: "), F.col(question)).alias("title"),
        F.array(F.col(answer)).alias("answers"), _no_prov().alias("provenance"),
    )


def multihop_provenance(supporting_titles: Column, context_titles: Column, context_sentences: Column) -> Column:
    """Contexts whose title equals or contains a supporting title; sentences joined by a
    space, then contexts joined by a space; none → 'empty n/a'."""
    kept = F.filter(
        F.arrays_zip(context_titles.alias("t"), context_sentences.alias("s")),
        lambda c: F.exists(supporting_titles, lambda t: c["t"].contains(t)),
    )
    joined = F.array_join(F.transform(kept, lambda c: F.array_join(c["s"], " ")), " ")
    return F.when(F.size(kept) == 0, F.lit(NO_PROVENANCE)).otherwise(joined)


def multihop_qa(df: DataFrame, id_col="id", question="question", answer="answer", supporting="supporting_facts", context="context") -> DataFrame:
    prov = multihop_provenance(F.col(supporting)["title"], F.col(context)["title"], F.col(context)["sentences"])
    return df.select(
        F.col(id_col).cast("string").alias("id"), F.col(question).alias("title"),
        F.array(F.col(answer)).alias("answers"), F.array(prov).alias("provenance"),
    )


def code_task_qa(df: DataFrame) -> DataFrame:
    if len(df.columns) != 5:
        raise ValueError("code-task adapter expects five columns")
    return df.toDF(*CODE_TASK_COLS)


def biomedical_qa(df: DataFrame, id_col="id", question="QUESTION", contexts="CONTEXTS", long_answer="LONG_ANSWER",
                  decision="final_decision", label="label") -> DataFrame:
    """Test-set projection: the decision as the answer, the contexts joined as provenance."""
    return df.select(
        F.col(id_col).cast("string").alias("id"), F.col(question).alias("title"), F.array(F.col(decision)).alias("answers"),
        F.array(F.array_join(contexts, " ")).alias("provenance"), F.col(long_answer).alias("long_answer"), F.col(label).alias("label"),
    )


def passthrough_qa(df: DataFrame, id_col="id", title="title", answers="answers", provenance="provenance") -> DataFrame:
    """Keep the split as is, lifting ``answers.text`` when answers is a struct."""
    a = F.col(answers)
    dtype = df.schema[answers].dataType.simpleString()
    ans = a["text"] if dtype.startswith("struct") else a
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(title).alias("title"), ans.alias("answers"),
                     F.col(provenance).alias("provenance"))


def attach_by_position(qa: DataFrame, measure: DataFrame, *, ordinal="ordinal", pos="pos", value="value", name="popularity") -> DataFrame:
    """Attach a measure list aligned by position (``measure(pos, value)``, e.g. from
    ``posexplode`` of the list) as an equi-join on the ordinal.  Rows whose position has
    no partner on either side are kept with ``aligned = false`` so a length mismatch is
    visible instead of silently truncated."""
    m = measure.select(F.col(pos).cast("long").alias(ordinal), F.col(value).alias(name), F.lit(True).alias("_m"))
    j = qa.withColumn("_q", F.lit(True)).join(m, ordinal, "full_outer")
    return j.withColumn("aligned", F.col("_q").isNotNull() & F.col("_m").isNotNull()).drop("_q", "_m")


def ordinal_index(df: DataFrame, id_col="id", ordinal="ordinal") -> DataFrame:
    """``id -> position`` where a repeated id keeps its last position."""
    return df.groupBy(id_col).agg(F.max(ordinal).alias("idx"))


def keyed_union_last_wins(df: DataFrame, key: str, rank: str) -> DataFrame:
    """Dict-merge semantics: per key keep the row of the highest source rank."""
    cols = [c for c in df.columns if c not in (key, rank)]
    agg = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(rank)).alias("_v"), F.max(rank).alias(rank))
    return agg.select(key, rank, "_v.*")
