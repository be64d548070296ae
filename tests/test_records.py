"""Records cut by running totals over byte ranges equal those of a sequential parser."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundeval.sources import readers as RD
from groundeval.sources import records as RC
from groundeval.sources import writers as W


@pytest.fixture(params=[300, 10_000_000])
def split_bytes(spark, request):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def words(rnd, pieces):
    return "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 30)))


VALUE = T.StructType([T.StructField("QUESTION", T.StringType()), T.StructField("CONTEXTS", T.ArrayType(T.StringType()))])


@pytest.mark.parametrize("indent", [None, 2])
def test_keyed_objects_of_any_layout(spark, tmp_path, indent, split_bytes):
    rnd, want = random.Random(indent), {}
    pieces = ["a", ",", ", ", '"', "\\", "{", "}", "[", "]", ":", "\n", "\t", "é", "😀", "\\\"", "x, y"]
    for f in range(3):
        own = {f"{f}-{i},{words(rnd, pieces)}": {"QUESTION": words(rnd, pieces), "CONTEXTS": [words(rnd, pieces) for _ in range(rnd.randint(0, 3))]} for i in range(40)}
        (tmp_path / f"{f}.json").write_text(json.dumps(own, indent=indent, ensure_ascii=f != 1))
        want |= own
    (tmp_path / "empty.json").write_text(" {\n }\n")
    (tmp_path / "one.json").write_text('{"only": {"QUESTION": "q", "CONTEXTS": []}}\n')
    want["only"] = {"QUESTION": "q", "CONTEXTS": []}
    if split_bytes < 1000:
        assert RC.pieces(spark, str(tmp_path), ",").select("_file", "_start").distinct().count() > 30
    got = RD.read_keyed_json(spark, str(tmp_path), VALUE).collect()
    assert len(got) == len(want)
    assert {r.id: {"QUESTION": r.QUESTION, "CONTEXTS": r.CONTEXTS} for r in got} == want


def test_keyed_labels_and_written_objects(spark, tmp_path, split_bytes):
    (tmp_path / "labels.json").write_text(json.dumps({str(i): "yes" if i % 2 else "no, {" for i in range(100)}, indent=1))
    got = {r.id: r.value for r in RD.read_keyed_json(spark, str(tmp_path / "labels.json"), T.StringType()).collect()}
    assert got == {str(i): "yes" if i % 2 else "no, {" for i in range(100)}
    df = spark.createDataFrame([(i, f'q "{i}",\n}}', ["a,", "{b"]) for i in range(50)], "k long, QUESTION string, CONTEXTS array<string>")
    W.write_keyed_objects(df, str(tmp_path / "objects"), "k", 3)
    files = [p for p in (tmp_path / "objects").rglob("part-*")]
    assert len(files) == 3 and sum(len(json.loads(p.read_text())) for p in files) == 50
    back = RD.read_keyed_json(spark, str(tmp_path / "objects"), VALUE)
    assert sorted(map(tuple, back.select(F.col("id").cast("long"), "QUESTION", "CONTEXTS").collect())) == sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("line", ["\n", "\r\n"])
def test_csv_with_line_breaks(spark, tmp_path, line, split_bytes):
    rnd, want = random.Random(len(line)), []
    pieces = ["a", ",", '"', "\n", "\n\n", "é", " b", "\r\n", "'", "\\", '""']
    for f in range(2):
        out = io.StringIO()
        w = csv.writer(out, lineterminator=line)
        w.writerow(["", "id", "na,me", "text"])
        for i in range(120):
            row = [f"{f}-{i}", words(rnd, pieces), words(rnd, pieces)]
            want.append(tuple(x or None for x in row))
            w.writerow([i, *row])
        (tmp_path / f"{f}.csv").write_bytes(out.getvalue().encode())
    df = RD.read_indexed_csv(spark, str(tmp_path))
    assert df.columns == ["id", "na,me", "text"]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_csv_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n")
    df = RD.read_indexed_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["x", "y"] and df.count() == 0


def test_runs_are_written_line_by_line(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(r, i, f"q{i}\n", None if i == 3 else f'p "{i}", {words(rnd, ["a", ",", "é", chr(10)])}', [f"r{i}", None], None if r == 2 else [f"w{i}"]) for r in range(4) for i in range([1, 500, 7, 30][r])]
    rnd.shuffle(rows)
    preds = spark.createDataFrame(rows, "run_id long, idx long, question string, pred string, refs array<string>, provenances array<string>").repartition(5)
    runs = spark.createDataFrame([(r, ("b", "d")) for r in range(5)], "run_id long, params struct<prompt_before: string, dataset: string>")
    runs = runs.withColumn("results", F.lit(None).cast(RD.RUN_SCHEMA["results"].dataType))
    path = tmp_path / "runs"
    W.write_runs(preds, runs, str(path))
    files = {int(p.parent.name.removeprefix("run=")): json.loads(p.read_text()) for p in path.rglob("part-*")}
    assert sorted(files) == [0, 1, 2, 3]  # run 4 has no predictions
    for r, doc in files.items():
        own = sorted(x for x in rows if x[0] == r)
        assert doc["run_id"] == r and doc["params"] == {"prompt_before": "b", "dataset": "d"}
        assert [doc["questions"], doc["pred"], doc["refs"], doc["provenances"]] == [[x[c] for x in own] for c in (2, 3, 4, 5)]


def test_results_are_written_from_the_score_table(spark, tmp_path):
    preds = spark.createDataFrame([(r, i, "q", f"p{i}", ["r"], ["w"]) for r in (1, 2) for i in range(30)],
                                  "run_id long, idx long, question string, pred string, refs array<string>, provenances array<string>")
    rows = [(r, i, t, float(i % 2), i / 7, None if i == 4 else 0.1 * r, i / 30 if t == "answers" else None)
            for r in (1, 2) for i in range(30) for t in ("answers", "provenance") if r == 1 or t == "answers"]
    scores = spark.createDataFrame(rows, "run_id long, idx long, target string, em double, f1 double, rougel double, overlap double")
    means = [(1, "answers", 0.5, 0.25, 0.1, 3.5, 0.75), (1, "provenance", 0.5, 0.25, 0.1, None, None), (2, "answers", 1.0, 1.0, 1.0, 100.0, None)]
    summary = spark.createDataFrame(means, "run_id long, target string, em double, f1 double, rougel double, bleu double, avg_percent_overlap double")
    runs = spark.createDataFrame([(1, ("d",)), (2, ("e",)), (3, ("f",))], "run_id long, params struct<dataset: string>")
    W.write_runs(preds, runs, str(tmp_path / "runs"), scores=scores, summary=summary)
    docs = {d["run_id"]: d for d in (json.loads(p.read_text()) for p in (tmp_path / "runs").rglob("part-*"))}
    assert sorted(docs) == [1, 2] and docs[1]["pred"] == [f"p{i}" for i in range(30)]
    for r, t in ((1, "answers"), (1, "provenance"), (2, "answers")):
        own, got = sorted(x for x in rows if x[0] == r and x[2] == t), docs[r]["results"][t]
        assert [got["em_list"], got["f1_list"], got["rougel_list"]] == [[x[c] for x in own] for c in (3, 4, 5)]
        mean = next(m for m in means if m[:2] == (r, t))
        assert (got["em"], got["f1"], got["rougel"], got.get("bleu")) == mean[2:6]
    assert "provenance" not in docs[2]["results"]
    assert docs[1]["results"]["datasketch"] == {"avg_percent_overlap": 0.75, "percent_overlap_list": [i / 30 for i in range(30)]}
    back = {r.run_id: r for r in RD.read_runs(spark, str(tmp_path / "runs")).collect()}
    assert back[1].results.answers.em_list == [float(i % 2) for i in range(30)] and back[2].results.provenance is None


def test_a_failed_write_leaves_no_run(spark, tmp_path):
    preds = spark.range(50).select((F.col("id") % 5).alias("run_id"), "id", F.lit("q").alias("question"),
                                   F.when(F.col("id") == 48, F.raise_error(F.lit("lost"))).otherwise(F.lit("p")).cast("string").alias("pred"),
                                   F.array(F.lit("r")).alias("refs"), F.array(F.lit("w")).alias("provenances")).withColumnRenamed("id", "idx")
    runs = spark.range(5).select(F.col("id").alias("run_id"), F.struct(F.lit("d").alias("dataset")).alias("params"))
    with pytest.raises(Exception):
        W.write_runs(preds, runs, str(tmp_path / "runs"))
    assert not [p for p in (tmp_path / "runs").rglob("part-*") if "_temporary" not in str(p)]


def test_objects_are_written_to_more_files_as_texts_grow(spark, monkeypatch):
    from groundeval.plans import queries_sources as Q

    docs = spark.createDataFrame([(i, "é" * 500) for i in range(20)], "doc_id bigint, QUESTION string")
    assert Q.object_files(docs) == 2 and Q.object_files(docs.limit(0)) == 2
    monkeypatch.setattr(Q, "OBJECT_BYTES", 3000)
    assert Q.object_files(docs) == 7


def test_tasks_that_write_runs_rise_with_the_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "RUNS_PER_TASK", 5, raising=False)
    preds = spark.range(120).select(F.col("id").alias("run_id"), F.lit(0).cast("long").alias("idx"), F.lit("q").alias("question"),
                                    F.lit("p").alias("pred"), F.array(F.lit("g")).alias("refs"), F.array(F.lit("s")).alias("provenances"))
    runs = preds.select("run_id", F.struct(F.lit("nq_open").alias("dataset")).alias("params"))
    W.write_runs(preds, runs, str(tmp_path / "runs"))
    tasks = {f.name[:10] for f in (tmp_path / "runs").glob("run=*/part-*.txt")}
    assert len(tasks) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert RD.read_runs(spark, str(tmp_path / "runs")).where("size(pred) = 1").count() == 120
