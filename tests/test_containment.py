"""The hash-first semi-join and the Bloom sketch against plain set membership."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundeval.functions import rolling as R
from groundeval.operators import containment as C
from groundeval.operators import overlap as OV
from groundeval.operators import sketch as SK

ID_TEXT = "id long, text string"


def brute(probe, corpus, width, stride=1):
    grams = {t[i : i + width] for t in corpus if t for i in range(0, len(t) - width + 1, stride)}
    return {(k, i, t[i : i + width]) for k, t in probe if t for i in range(len(t) - width + 1) if t[i : i + width] in grams}


def random_texts(rnd, n, letters, longest=300):
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("width,stride", [(25, 1), (25, 4), (7, 1), (2, 1), (1, 1), (60, 3)])
def test_contained_windows_equal_sets(spark, width, stride):
    rnd = random.Random(width + stride)
    corpus = random_texts(rnd, 40, "ab") + random_texts(rnd, 20, "aé😀 ") + [None, "", "short", "a" * 4000]
    probe = [t[rnd.randint(0, 20) :][: rnd.randint(1, 200)] + rnd.choice(["", "zz", t[:30]]) for t in corpus if t]
    probe = list(enumerate(probe + random_texts(rnd, 20, "abc") + [None, "", "a" * 300, "a" * 300]))
    p = spark.createDataFrame(probe, ID_TEXT).repartition(5)
    c = spark.createDataFrame([(t,) for t in corpus * 2], "body string").repartition(3)
    got = C.contained_windows(p, c, corpus_text_col="body", width=width, stride=stride).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute(probe, corpus, width, stride)


def test_empty_sides(spark):
    texts = spark.createDataFrame([(1, "a" * 100)], ID_TEXT)
    for p, c in ((texts, texts.where("false")), (texts.where("false"), texts), (texts, texts.select("id", F.lit("b" * 100).alias("text")))):
        assert C.contained_windows(p, c).count() == 0
        assert [r.hits for r in OV.quip_overlap(p, c).collect()] == [0] * p.count()


def test_candidates_grow_with_matches_not_with_the_probe(spark):
    rnd = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz      "
    corpus = random_texts(rnd, 200, letters, 2000)
    shared = [(i, corpus[i][10:210]) for i in range(20)]
    strange = [(100 + i, t) for i, t in enumerate(random_texts(rnd, 2000, letters, 400))]
    c = spark.createDataFrame(list(enumerate(corpus)), ID_TEXT)
    counts = []
    for more in (20, 2000):  # the probe grows a hundredfold, what it shares does not
        p = spark.createDataFrame(shared + strange[:more], ID_TEXT)
        common = C.common_prefixes(p, c, "text", "text", 25)
        counts.append((C.corpus_candidates(c, common, "text", 25).count(), C.probe_candidates(p, common, "id", "text", 25).count()))
    matches = len(brute(shared, corpus, 25))
    assert counts[0] == counts[1]
    assert matches <= counts[0][1] <= 1.2 * matches and counts[0][0] <= 1.2 * matches


def test_chance_prefixes_are_no_results(spark, monkeypatch):
    """With prefixes of a few bits nearly every anchor is common; strings still decide."""
    monkeypatch.setattr(C, "prefix", lambda h: R.spread(h) >> np.uint64(64 - C.PREFIX_BITS) & np.uint64(0xFFF0000000))
    rnd = random.Random(8)
    corpus, probe = random_texts(rnd, 30, "abcd"), list(enumerate(random_texts(rnd, 30, "abcd")))
    probe[0] = (0, corpus[0][:60])
    p, c = spark.createDataFrame(probe, ID_TEXT), spark.createDataFrame(list(enumerate(corpus)), ID_TEXT)
    got = {tuple(r) for r in C.contained_windows(p, c).collect()}
    assert got == brute(probe, corpus, 25)


def test_packed_runs_round_trip():
    rng = np.random.default_rng(2)
    for size, top in ((0, 1), (1, 1 << 63), (5, 3), (1000, 1 << 20), (1000, 1 << 44), (50, 1 << 63)):
        run = np.sort(rng.integers(0, top, size, dtype=np.uint64))
        assert (R.unpack_run(R.pack_run(run)) == run).all()
    ends = np.array([0, (1 << 64) - 1], dtype=np.uint64)
    assert (R.unpack_run(R.pack_run(ends)) == ends).all()
    assert len(R.pack_run(np.arange(1000, dtype=np.uint64))) < 1100  # a byte an entry where gaps allow


def test_many_window_hashes_equal_one_by_one():
    rnd, powers = random.Random(5), R.Powers()
    texts = [t for t in random_texts(rnd, 50, "aé😀b", 60) if t]
    for width, step in ((25, 8), (18, 1), (3, 2)):
        h, owner, pos = R.many_window_hashes(texts, width, powers, step)
        want = [(i, p, int(x)) for i, t in enumerate(texts) for p, x in enumerate(R.window_hashes(t, width, powers)) if p % step == 0]
        assert list(zip(owner.tolist(), pos.tolist(), h.tolist())) == want


def test_sketches_merge_like_their_corpora(spark, tmp_path):
    rnd = random.Random(4)
    texts = spark.createDataFrame(list(enumerate(random_texts(rnd, 300, "abcdef"))), ID_TEXT)
    whole = SK.bloom_sketch(texts, m_bits=1 << 20, width=10)
    halves = [SK.bloom_sketch(texts.where(F.col("id") % 3 == i), m_bits=1 << 20, width=10) for i in range(3)]
    for i, h in enumerate(halves):
        SK.write_sketch(h, str(tmp_path / str(i)))
    merged = SK.merge_sketches(*[spark.read.parquet(str(tmp_path / str(i))) for i in range(3)])
    rows = lambda df: sorted(map(tuple, df.select("word", "bits", *SK.PARAMS).collect()))
    assert rows(merged) == rows(whole) and merged.count() > 1000
    assert SK.sketch_params(merged) == {"m_bits": 1 << 20, "k": 5, "width": 10, "stride": 1}
    hits = {r.id: r.hits for r in SK.bloom_overlap(texts, merged, width=10).collect()}
    assert all(hits[r.id] == max(len(r.text) - 9, 0) for r in texts.collect())  # the corpus itself is all members


def test_sketches_of_other_parameters_do_not_merge(spark):
    texts = spark.createDataFrame([(1, "a" * 50 + "bcd" * 20)], ID_TEXT)
    one, other = SK.bloom_sketch(texts, m_bits=1 << 12), SK.bloom_sketch(texts, m_bits=1 << 13)
    with pytest.raises(ValueError):
        SK.merge_sketches(one, other)
    with pytest.raises(ValueError):
        SK.sketch_params(one.unionByName(other))
    with pytest.raises(Exception, match="other parameters"):
        SK.bloom_overlap(texts, one, m_bits=1 << 13).collect()
    empty = SK.bloom_sketch(texts.where("false"), m_bits=1 << 12)
    assert SK.sketch_params(empty) is None
    assert SK.merge_sketches(empty, one).count() == one.count()
    assert [r.hits for r in SK.bloom_overlap(texts, empty).collect()] == [0]


def test_copies_in_the_probe_count_each(spark):
    texts = spark.createDataFrame([(1, "abcdefghij" * 5), (2, "abcdefghij" * 5), (3, None)], ID_TEXT)
    sketch = SK.bloom_sketch(texts, width=10)
    assert {r.id: r.hits for r in SK.bloom_overlap(texts, sketch, width=10).collect()} == {1: 41, 2: 41, 3: 0}
    assert SK.bloom_members(texts, sketch, width=10).count() == 82
