"""Periodic runs, hard negatives and sharding against brute force, with their edge rows."""

import glob
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundeval.llm import hard_negatives, periodic_runs, sharding
from groundeval.llm.queries import tiled_words

from .conftest import DOCS, rows_of


def brute_runs(words, min_words=24, min_periods=3):
    n, out = len(words), []
    for q in range(1, n // min_periods + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j > i and j - i + q >= max(min_words, min_periods * q):
                out.append((i - q, j - i + q, q))
            i = max(j, i + 1)
    inside = lambda a, b: b[2] < a[2] and b[0] <= a[0] and b[0] + b[1] >= a[0] + a[1]
    return sorted((a for a in out if not any(inside(a, b) for b in out)), key=lambda r: (r[0], r[2]))


def periodic_words(rnd):
    words = []
    while len(words) < rnd.choice([0, 30, 80, 200, 400]):
        letters = rnd.choice([1, 2, 3, 5])
        block = [bytes([97 + rnd.randrange(letters)]) for _ in range(rnd.randint(1, 40))]
        if rnd.random() < 0.3:
            block = block * rnd.randint(1, 4) + block[: rnd.randint(0, len(block))]
        words += (block * rnd.randint(1, 9))[: rnd.randint(1, 9 * len(block))]
    return words


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    rnd = random.Random(seed)
    found = 0
    for _ in range(150):
        texts = [periodic_words(rnd) for _ in range(rnd.randint(1, 4))]
        least, periods = rnd.choice([(24, 3), (24, 3), (1, 3), (5, 4), (50, 3)])
        want = [brute_runs(t, least, periods) for t in texts]
        assert periodic_runs.text_runs(texts, least, periods) == want
        found += sum(map(len, want))
    assert found > 300


def test_runs_of_long_texts_take_no_quadratic_time():
    assert periodic_runs.text_runs([[b"x"] * 300_000]) == [[(0, 300_000, 1)]]
    line = [b"%d" % i for i in range(17)]
    assert periodic_runs.text_runs([line * 20_000 + [b"end"]]) == [[(0, 340_000, 17)]]


def test_runs_columns_and_edges(spark, docs_of):
    rnd = random.Random(3)
    texts = [(i, b" ".join(periodic_words(rnd)).decode()) for i in range(60)]
    tie = "a b c " * 8 + "| " + "d e f " * 8
    texts += [(100, None), (101, ""), (102, " \t\n\x0b "), (103, tie), (103, tie), (None, "z " * 30), (104, "u v\x1c " * 40), (105, "w " * 200_000)]
    df = docs_of(texts).selectExpr("*", "1 AS start", "2 AS runs", "3 AS collapsed")
    got = periodic_runs.find_runs(df).collect()
    by = dict(texts)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in texts)
    for r in got:
        words = (by[r.doc_id] or "").encode().split()
        runs = [tuple(x) for x in r.runs]
        assert r.n_words == len(words) and r.n_runs == len(runs)
        if r.doc_id != 105:
            assert runs == brute_runs(words)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r.collapsed == b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
    assert next(r for r in got if r.doc_id == 103).start == 0
    assert next(r for r in got if r.doc_id == 105).collapsed == "w"
    assert rows_of(periodic_runs.find_runs(spark.createDataFrame([], DOCS))) == []
    with pytest.raises(ValueError):
        periodic_runs.find_runs(df, min_periods=2)


def test_tiled_words_follow_the_rule():
    words = [b"%d" % i for i in range(50)]
    tiled = 0
    for doc_id in range(500):
        h = zlib.crc32(str(doc_id).encode())
        g, want = h // 10, list(words)
        if h % 10 == 0:
            a = g % 50
            p = 1 + (50 - a) // (3 + g % 8)
            want = [words[a + (i - a) % p] if i >= a else words[i] for i in range(50)]
            tiled += 1
        assert tiled_words(doc_id, list(words)) == want
    assert tiled > 20 and tiled_words(None, words) == words and tiled_words(1, []) == []


def brute_negatives(rows, is_anchor, n_positives=5, k=5):
    good = {}
    for i, v, label in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[2], [int(np.floor(256 * x)) if x == x and x is not None and abs(x) != np.inf else 0 for x in r[1] if x is not None])):
        if len(v) and all(x is not None and np.isfinite(x) for x in v) and i not in good:
            good[i] = ([int(np.floor(256 * float(np.float32(x)))) for x in v], label)
    out = []
    for a, (v, label) in good.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (w, other) in good.items() if i != a and len(w) == len(v))
        for minus, p, _ in [s for s in scored if s[2] == label][:n_positives]:
            window = [s for s in scored if s[2] != label and 80 * -minus <= 100 * -s[0] <= 100 * -minus][:k]
            out += [(a, p, n, i, -minus, -s) for n, (s, i, _) in enumerate(window, 1)]
    return sorted(out)


def mined(df, is_anchor, **kw):
    return sorted(rows_of(hard_negatives.hard_negatives(df, is_anchor, **kw)))


VECTORS = "vec_id bigint, embedding array<float>, label int"


def test_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) + 0.7], int(rng.integers(0, 3)) if i % 3 else 0) for i in range(400)]
    rows += [(400 + i, [1.0] * 6, i % 2) for i in range(60)]  # one vector many times: ties
    rows += [(480 + i, [float(i % 4)] * 2, i % 2) for i in range(30)]  # another length
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 200
    for values in (1 << 20, 256 * 6):  # one block, and blocks of the smallest size
        assert mined(df, F.col("id") % 10 == 0, block_values=values) == want


def test_negatives_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [1.0, float(i)], i % 2) for i in range(8)]
    bad = [(20, None, 0), (21, [None, 1.0], 0), (22, [nan, 1.0], 0), (23, [inf, 1.0], 1), (24, [1.0, 1.0], None), (None, [9.0, 9.0], 1), (25, [], 1)]
    again = [(2, [1.0, 2.0], 0), (3, [1.0, 50.0], 1)]  # the smaller (label, vector) of an identifier counts
    clash = ["1 AS id", "2 AS v", "3 AS dim", "4 AS anchor", "5 AS kind", "6 AS limits"]
    df = spark.createDataFrame(rows + bad + again, VECTORS).selectExpr("*", *clash)
    assert mined(df, F.col("id") >= 0) == brute_negatives(rows, lambda i: True)
    assert mined(df, F.col("id") < 0) == []
    assert mined(df.where("false"), F.col("id") >= 0) == []
    below = [(0, [1.0], 0), (1, [-1.0], 0), (2, [-1.0], 1), (3, [-0.9], 1)]  # a window below zero is empty
    assert mined(spark.createDataFrame(below, VECTORS), F.col("id") == 0) == []
    zero = [(0, [0.0], 0), (1, [5.0], 0), (2, [7.0], 1), (3, [-7.0], 1)]  # every score is zero
    assert mined(spark.createDataFrame(zero, VECTORS), F.col("id") == 0) == [(0, 1, 1, 2, 0, 0), (0, 1, 2, 3, 0, 0)]


def test_products_are_exact():
    big = np.array([[(1 << 27) + 1, 3]], dtype=np.int64)
    assert hard_negatives.products(big, big)[0, 0] == ((1 << 27) + 1) ** 2 + 9
    with pytest.raises(ValueError):
        hard_negatives.products(big << 30, big << 30)


def brute_shards(rows, n_shards):
    """Counts the law by itself: shard sizes, gapless slots, shares of sources."""
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts[s] for s in range(n_shards)) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    sources = Counter(r.source for r in rows)
    slack = 2 + 2 * len(sources) / len(rows) * max(sources.values())
    for source, n in sources.items():
        per = Counter(r.shard for r in rows if r.source == source)
        assert all(abs(per[s] - n / n_shards) <= slack for s in range(n_shards))


def test_shards_hold_the_mixture(spark, docs_of):
    rows = [(i, f"text {i}", "en", "big" if i % 3 == 0 else f"s{i % 11}", 1) for i in range(3000)]
    rows += [(7000, "same", "en", "big", 1)] * 500 + [(None, None, None, None, None)] * 40 + [(8000 + i, f"{i}", "en", f"rare{i}", 1) for i in range(60)]
    df = docs_of(rows).selectExpr("*", "1 AS slot", "2 AS row", "3 AS key", "4 AS part")
    out = sharding.assign_shards(df.repartition(7), 24).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    brute_shards(out, 24)
    other = sharding.assign_shards(df.coalesce(1), 24).collect()  # no matter how the rows are dealt
    assert sorted(map(str, out)) == sorted(map(str, other))
    assert sharding.assign_shards(df, 24, seed=5).collect() != out
    null = next(r for r in out if r.doc_id is None)
    assert (null.size, null.text_crc32, null.source) == (8, 0, None)


def test_shards_edges(spark, docs_of):
    few = sharding.assign_shards(docs_of([(1, "é"), (2, "b " * 500_000)]), 24).collect()
    assert sorted((r.doc_id, r.size, r.slot) for r in few) == [(1, 10, 0), (2, 1_000_008, 0)]
    assert next(r for r in few if r.doc_id == 1).text_crc32 == zlib.crc32("é".encode())
    assert len({r.shard for r in few}) == 2
    assert rows_of(sharding.assign_shards(spark.createDataFrame([], DOCS))) == []
    with pytest.raises(ValueError):
        sharding.assign_shards(docs_of([(1, "a")]), 0)


def test_written_shards_read_back(spark, sample, tmp_path):
    df = sample.selectExpr("*", "doc_id AS row", "7 AS shard")
    path = str(tmp_path / "shards")
    sharding.write_shards(df, path, 5)
    want = {(r.doc_id, r.shard, r.slot) for r in sharding.assign_shards(df, 5).collect()}
    back = spark.read.parquet(path)
    assert {c for c in back.columns} == {*df.columns, "shard_", "slot"}
    assert {(r.doc_id, r.shard_, r.slot) for r in back.collect()} == want
    assert back.select(*df.columns).exceptAll(df).count() == 0 and back.count() == df.count()
    for s in range(5):
        slots = []
        for f in sorted(glob.glob(f"{path}/shard_={s}/*.parquet")):
            slots += [r.slot for r in spark.read.parquet(f).collect()]
        assert slots == list(range(len(slots)))
