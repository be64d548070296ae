"""Every prompt is answered once, whatever stops the job."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from groundeval.operators import generation_log as GL

ROWS = [(i % 3, i, None if i == 7 else f"prompt {i}") for i in range(100)]
SCHEMA = "run_id long, idx long, prompt string"


def counting(folder, die_at=None, fail=None, log=None):
    """A predictor that leaves a mark per prompt; takes its worker down at one prompt (once, when
    the log has something) or raises for some."""

    def factory():
        def predict(prompts):
            if die_at in prompts and not os.path.exists(f"{folder}/died"):
                for _ in range(600):
                    if glob.glob(f"{log}/part-*"):
                        break
                    time.sleep(0.1)
                open(f"{folder}/died", "w").close()
                os._exit(1)
            if fail and any(fail(p) for p in prompts):
                raise RuntimeError("no answer")
            for p in prompts:
                with open(f"{folder}/{p or 'empty'}", "a") as f:
                    f.write("x")
            return [p.upper() for p in prompts]

        return predict

    return factory


def calls(folder):
    return {f: os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f != "died"}


def test_killed_half_way_and_resumed(spark, tmp_path):
    folder, log = str(tmp_path / "calls"), str(tmp_path / "log")
    os.mkdir(folder)
    df = spark.createDataFrame(ROWS, SCHEMA)
    with pytest.raises(Exception):  # local mode gives a task one try
        GL.generate_logged(df, counting(folder, die_at="prompt 50", log=log), log, batch_size=5)
    answered = {r.prompt or "empty" for r in GL.read_log(df, ["run_id", "idx"], log).join(df, ["run_id", "idx"]).collect()}
    assert 0 < len(answered) < 100  # tasks that had ended are kept
    before = calls(folder)
    out = GL.generate_logged(df, counting(folder), log, batch_size=5)
    after = calls(folder)
    assert all(after[p] == before[p] == 1 for p in answered)  # nothing answered is asked again
    assert len(after) == 100 and all(n == 1 or p in before for p, n in after.items())
    got = {r.idx: (r.generation, r.status, r.attempt) for r in out.collect()}
    assert got == {i: ((p or "").upper(), "ok", 1) for _, i, p in ROWS}
    assert out.collect() and calls(folder) == after  # the result reads the log
    again = GL.generate_logged(df, counting(folder), log, batch_size=5)
    assert again.count() == 100 and calls(folder) == after


def test_failing_batches_are_tried_again_and_marked(spark, tmp_path):
    folder, log = str(tmp_path / "calls"), str(tmp_path / "log")
    os.mkdir(folder)
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = GL.generate_logged(df, counting(folder, fail=lambda p: p.endswith("13")), log, batch_size=1, max_attempts=3)
    rows = {r.idx: r for r in out.collect()}
    assert len(rows) == 100 and all(r.status == "ok" and r.attempt == 1 for i, r in rows.items() if i != 13)
    assert (rows[13].status, rows[13].attempt, rows[13].generation, rows[13].error) == ("failed", 3, None, "RuntimeError: no answer")
    assert GL.read_log(df, ["run_id", "idx"], log).count() == 102
    rows = {r.idx: r for r in GL.generate_logged(df, counting(folder), log, batch_size=1, max_attempts=4).collect()}
    assert (rows[13].status, rows[13].attempt, rows[13].generation, rows[13].error) == ("ok", 4, "PROMPT 13", None)
    assert set(calls(folder).values()) == {1}


def test_rounds_and_wrong_counts(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = GL.generate_logged(df, lambda: lambda prompts: prompts, str(tmp_path / "a"), batch_size=4, round_batches=3)
    assert out.where("status = 'ok'").count() == 100  # nine jobs or so
    out = GL.generate_logged(df, lambda: lambda prompts: prompts[1:], str(tmp_path / "b"), batch_size=10, max_attempts=1)
    assert out.where("status = 'failed' and error like 'ValueError%'").count() == 100
    none = GL.generate_logged(df.where("false"), lambda: None, str(tmp_path / "c"))
    assert none.count() == 0 and none.columns[-4:] == ["generation", "status", "attempt", "error"]


def test_null_keys(spark, tmp_path):
    df = spark.createDataFrame([(None, 1, "a"), (1, None, "b")], SCHEMA).withColumn("status_", F.lit(1))
    out = GL.generate_logged(df, lambda: lambda prompts: prompts, str(tmp_path / "log"))
    assert sorted(r.generation for r in out.collect()) == ["a", "b"]
