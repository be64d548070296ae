"""The whole pipeline, and operators on very long texts."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from groundeval.llm import chat_format, exact_dedup, mixing, order_minhash, substring_dedup, toxicity

from .conftest import DOCS, SF001


UPPER = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def test_pipeline_keeps_one_of_each_group_and_all_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    own = {r.doc_id: r for r in docs.collect()}
    marks = order_minhash.near_classes(docs)
    clean = {r.doc_id for r in marks.where("class_size = 1").collect()} & {i for i, r in own.items() if len((r.text or "").split()) > 60}
    first, second = sorted(clean)[:2]
    words = own[second].text.split()
    words[30] = "changed"
    planted = [(900_000 + i, own[first].text.translate(UPPER) if i else own[first].text, "en", "planted", 0) for i in range(4)]  # equal but for case
    planted += [(910_000, " ".join(words), "en", "planted", 0)] if len(words) > 100 else []
    planted += [(920_000 + i, t, "en", "planted", 0) for i, t in enumerate([None, "", "12 345 !!", " \t"])] + [(None, own[first].text, None, None, None)]
    docs.unionByName(spark.createDataFrame(planted, DOCS)).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert len(kept & {first, None, *range(900_000, 900_004)}) == 1
    assert not kept & set(range(920_000, 920_004))  # no letters
    assert second in kept or 910_000 in kept
    assert len(clean - {first, second} - kept) <= 0.02 * len(clean)  # other stages leave them alone
    tokens = {r.doc_id: r for r in out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("one")).collect()}
    assert all(r.n % r.one == 0 for r in tokens.values())  # whole documents, once or repeated


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def long_documents(docs_of):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(5000)]
    long = " ".join(rng.choice(vocabulary) for _ in range(150_000))  # about a megabyte
    rows = [(1, long), (2, long + " end"), (3, long.upper()), (4, "x" * 1_000_000)] + [(10 + i, " ".join(rng.choice(vocabulary) for _ in range(80))) for i in range(30)]
    return rows, docs_of(rows).repartition(3)


def test_very_long_texts(spark, docs_of):
    rows, df = long_documents(docs_of)
    near = {r.doc_id: r for r in order_minhash.near_classes(df).collect()}
    assert near[1].class_id == near[2].class_id == near[3].class_id == 1 and near[4].class_size == 1
    assert {r.doc_id for r in order_minhash.keep_one(df).collect()} == {i for i, _ in rows} - {2, 3}
    assert {r.doc_id for r in exact_dedup.drop_duplicates(df).collect()} == {i for i, _ in rows} - {3}
    left = {r.doc_id: r for r in substring_dedup.remove_repeats(df).collect()}
    assert left[1].n_removed == 0 and left[3].n_removed == 0 and left[2].n_words - left[2].n_removed <= 1
    drawn = mixing.mix(df, max_repetition=1.0).collect()
    assert sorted(r.doc_id for r in drawn) == sorted(i for i, _ in rows)
    assert next(r for r in drawn if r.doc_id == 2).n_tokens == 150_001
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    scores = toxicity.toxicity(df, labels, F.col("doc_id") % 2 == 0).collect()
    assert len(scores) == len(rows) and all(np.isfinite(r.score) and 0 <= r.score <= 1 for r in scores)


def test_very_long_turns(spark):
    text = "a<[\\b" * 200_000
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    back = chat_format.read_back(chat_format.format_chats(df)).collect()
    assert [(r.n_turns, r.loss_chars) for r in back] == [(2, len(text))]
