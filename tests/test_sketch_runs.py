"""Runs that a sketch is built from: as small as the bits they stand for, and nothing lost."""

import random

import numpy as np
import pyarrow as pa
import pytest

from groundeval.functions.rolling import Powers, many_window_hashes, pack_run, pack_set, spread, unpack_set
from groundeval.operators import sketch as sk


def texts(n, size):
    rnd = random.Random(5)
    return ["".join(rnd.choices("abcdefghij ", k=size)) for _ in range(n)]


def runs(docs, m_bits, k, parts=24):
    shift = sk._word_bits(m_bits) - sk._range_bits(m_bits, parts)
    batch = pa.RecordBatch.from_arrays([pa.array(docs)], ["text"])
    return list(sk._build_runs(25, 1, m_bits, k, shift)(iter([batch]))), shift


def test_a_window_takes_seven_bytes_in_few_rows():
    docs = texts(200, 1000)
    out, _ = runs(docs, 1 << 36, 5)
    size = sum(len(v.as_py()) for b in out for name in ("run", "more") if name in b.schema.names for v in b.column(name))
    assert size <= 7 * 200 * 976
    assert sum(b.num_rows for b in out) <= 1 << 10


@pytest.mark.parametrize("m_bits,k", [(64, 5), (1 << 12, 5), (1 << 20, 3), (1 << 22, 10)])
def test_ranges_hold_every_bit(m_bits, k):
    docs = [*texts(6, 300), None, "", "short", "x" * 90]
    out, shift = runs(docs, m_bits, k)
    rows = sorted(((r, v) for b in out for r, v in zip(b.column("range").to_pylist(), b.column("run").to_pylist())), key=lambda x: x[0])
    ordered = pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows]), pa.array([v for _, v in rows], pa.binary())], ["range", "run"])
    got = {w: b for x in sk._or_ranges(m_bits, k, shift)(iter([ordered])) for w, b in zip(x.column("word").to_pylist(), x.column("bits").to_pylist())}
    h = spread(many_window_hashes([t for t in docs if t], 25, Powers())[0])
    want = {}
    for w, m in zip(sk._words(h, m_bits).tolist(), sk._masks(h, k).tolist()):
        want[w] = want.get(w, 0) | m
    assert got == {w: int(np.array(m, dtype=np.uint64).view(np.int64)) for w, m in want.items()}


def test_words_that_nobody_asks_for_do_not_travel(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = texts(300, 400)
    corpus = spark.createDataFrame([(t,) for t in docs], "text string")
    probe = spark.createDataFrame([(1, docs[0][:100]), (2, "z" * 60), (3, None), (4, "")], "id long, text string")
    sketch = sk.bloom_sketch(corpus)
    m_bits = sk.sketch_params(sketch)["m_bits"]
    sent = []

    def runs_of(found):
        """Rows of the sketch that reach the lookup."""
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        sent.append("strategy=broadcast" in plan)
        return sorted((r.key, sorted(r.places)) for r in found.collect())

    few = runs_of(sk._members(probe, sketch, "text", 25, m_bits, sk.HASHES, 1))
    monkeypatch.setattr(sk, "BROADCAST_WORDS", 0)
    every = runs_of(sk._members(probe, sketch, "text", 25, m_bits, sk.HASHES, 1))
    assert few == every and few and sent == [True, False]
    monkeypatch.setattr(sk, "BROADCAST_WORDS", 1 << 20)
    nothing = spark.createDataFrame([(1, "z" * 60)], "id long, text string")  # no word of its own in the sketch
    with pytest.raises(Exception, match="other parameters"):
        sk.bloom_overlap(nothing, sketch.withColumn("width", F.lit(7).cast("long")), m_bits=m_bits).collect()
    stored = spark.createDataFrame(sketch.withColumn("width", F.lit(7).cast("long")).collect())
    with pytest.raises(Exception, match="other parameters"):
        sk.bloom_overlap(nothing, stored, m_bits=m_bits).collect()
    with pytest.raises(Exception, match="other parameters"):
        sk.bloom_overlap(probe, sketch.withColumn("k", F.lit(4).cast("long")), m_bits=m_bits).collect()


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
@pytest.mark.parametrize("top", [1, 1 << 12, 1 << 30, 1 << 51, (1 << 64) - 1])
def test_a_set_is_packed_near_its_mean_difference(n, top):
    rnd = random.Random(n)
    want = np.array(sorted({rnd.randint(0, top) for _ in range(n)} | ({0, top} if n > 1 else set())), dtype=np.uint64)
    data = pack_set(want)
    assert np.array_equal(unpack_set(data), want) and np.array_equal(unpack_set(memoryview(data)), want)
    if n == 1000 and top == 1 << 51:  # what 6 GB of text send a piece and range: six bytes an entry as differences
        assert len(data) < 5.5 * n < len(pack_run(want))


def test_neighbours_are_packed_too():
    for want in (np.arange(5000, dtype=np.uint64), np.array([7], dtype=np.uint64), np.array([0, (1 << 64) - 1], dtype=np.uint64)):
        assert np.array_equal(unpack_set(pack_set(want)), want)
