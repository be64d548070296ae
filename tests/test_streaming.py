"""Streaming scoring equals batch scoring of the same predictions."""

import os

from pyspark.sql import functions as F

from groundeval.plans import fixtures as fx
from groundeval.plans.queries_generate import _eval_source
from groundeval.streaming import scoring as S

from conftest import SF001


def test_stream_scores_equal_batch(spark, tmp_path):
    src = _eval_source(spark, SF001)
    inbox = str(tmp_path / "inbox")
    # two arrival waves of prediction files
    src.where(F.col("run_id") % 2 == 0).write.json(os.path.join(inbox, "w1"))
    src.where(F.col("run_id") % 2 == 1).write.json(os.path.join(inbox, "w2"))
    stream = spark.readStream.schema(S.PREDICTION_SCHEMA).option("recursiveFileLookup", True).json(inbox)
    sink = str(tmp_path / "scores")
    q = S.start_scoring(stream, fx.corpus(spark, SF001), sink, name=f"t{os.getpid()}")
    q.awaitTermination(300)
    got = spark.read.parquet(sink).drop("batch_id")
    want = S.score_batch(src, fx.corpus(spark, SF001))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    runs = S.running_metrics(spark.read.parquet(sink))
    assert runs.count() == want.select("run_id", "target").distinct().count()


def test_running_metrics_stream_matches_batch(spark, tmp_path):
    src = _eval_source(spark, SF001)
    inbox, sink, table = str(tmp_path / "in"), str(tmp_path / "scores"), str(tmp_path / "running")
    src.write.json(inbox)
    q = S.start_scoring(spark.readStream.schema(S.PREDICTION_SCHEMA).json(inbox), fx.corpus(spark, SF001), sink,
                        name=f"s{os.getpid()}")
    q.awaitTermination(300)
    r = S.start_running_metrics(spark, sink, table, name=f"r{os.getpid()}")
    r.awaitTermination(300)
    cols = ["run_id", "target", F.round("em", 9), F.round("f1", 9), F.round("overlap", 9), "n"]
    got = sorted(tuple(x) for x in S.latest_running_metrics(spark, table).select(*cols).collect())
    want = sorted(tuple(x) for x in S.running_metrics(spark.read.parquet(sink)).select(*cols).collect())
    assert got == want and len(got) > 0


def test_stream_with_bloom_sketch(spark, tmp_path):
    from groundeval.operators import sketch as SK

    src = _eval_source(spark, SF001)
    inbox, sink = str(tmp_path / "in"), str(tmp_path / "scores")
    src.write.json(inbox)
    corpus = fx.corpus(spark, SF001)
    m = SK.bits_for(SK.window_total(corpus))
    sketch_path = str(tmp_path / "sketch")
    SK.write_sketch(SK.bloom_sketch(corpus, m_bits=m), sketch_path)  # built once, reused by every batch
    q = S.start_scoring(spark.readStream.schema(S.PREDICTION_SCHEMA).json(inbox), None, sink, name=f"b{os.getpid()}",
                        sketch=spark.read.parquet(sketch_path), m_bits=m)
    q.awaitTermination(300)
    approx = {(r.run_id, r.pair_id, r.target): r.overlap for r in spark.read.parquet(sink).collect()}
    exact = {(r.run_id, r.pair_id, r.target): r.overlap for r in S.score_batch(src, corpus).collect()}
    assert approx.keys() == exact.keys()
    assert all(approx[k] >= exact[k] - 1e-12 for k in exact)
