"""Exact, near and passage de-duplication against brute force, and their edge cases."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundeval.llm import components, exact_dedup, order_minhash, substring_dedup

from .conftest import DOCS, rows_of

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact_brute(rows, pick):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(ASCII)].append(i)
    out = []
    for i, t in rows:
        key = (t or "").translate(ASCII)
        out.append((i, pick(groups[key]), len(groups[key]), i == pick(groups[key]), hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("parts", [1, 7, 40])
def test_exact_equals_brute_force(spark, docs_of, keep, parts):
    rng = random.Random(parts)
    texts = ["", "A b", "a B", "É", "é", "x" * 50_000, None, "z\n"] + [f"t{i}" for i in range(20)]
    rows = [(i, rng.choice(texts)) for i in range(300)] + [(300 + i, "hot copy") for i in range(200)]
    df = exact_dedup.exact_dedup(docs_of(rows).repartition(parts), keep=keep, fan_in=4)
    assert sorted(rows_of(df)) == exact_brute(rows, min if keep == "min" else max)


def test_exact_repeats_nulls_and_empty_table(spark, docs_of):
    df = docs_of([(5, "a"), (5, "a"), (None, "a"), (None, "b"), (7, "A"), (5, "c")])
    got = exact_dedup.exact_dedup(df, keep="max").collect()
    assert sum(r.kept for r in got) == 3 and len(got) == 6
    assert {(r.keep_id, r.group_size) for r in got} == {(7, 4), (None, 1), (5, 1)}
    kept = exact_dedup.drop_duplicates(df, keep="min")
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text.lower()) for r in kept.collect()) == [("5", "a"), ("5", "c"), ("None", "b")]
    assert rows_of(exact_dedup.exact_dedup(spark.createDataFrame([], DOCS))) == []
    assert rows_of(exact_dedup.drop_duplicates(spark.createDataFrame([], DOCS))) == []


def test_exact_clashing_columns(spark, docs_of):
    df = docs_of([(1, "a"), (2, "a")]).selectExpr(
        "*", "1 AS kept", "2 AS digest", "3 AS run", "4 AS f_id", "5 AS text_digest", "6 AS f_kept", "7 AS keep_id", "8 AS n"
    )
    kept = exact_dedup.drop_duplicates(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [1]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def shingle_list(text):
    w = (text or "").translate(ASCII).split()
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def alike(a, b):
    if not a or not b:
        return float(a == b)
    m = lcs(a, b)
    return m / (len(a) + len(b) - m)


def near_brute(rows, threshold=0.8):
    sh = [shingle_list(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if min(len(sh[i]), len(sh[j])) >= threshold * max(len(sh[i]), len(sh[j])) and alike(sh[i], sh[j]) >= threshold:
                label[root(i)] = root(j)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[root(k)].append(i)
    return sorted((i, min(groups[root(k)]), len(groups[root(k)])) for k, (i, _) in enumerate(rows))


def near_texts(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for size in (3, 5, 8, 12, 30, 60, 120, 300):
        for _ in range(3):
            base = [rng.choice(words) for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, size // 40, size // 20, size // 8):
                text = list(base)
                for _ in range(edits):
                    at = rng.randrange(len(text))
                    change = rng.random()
                    if change < 0.5:
                        text[at] = rng.choice(words)
                    elif change < 0.75:
                        text.insert(at, rng.choice(words))
                    elif len(text) > 1:
                        del text[at]
                rows.append((i, " ".join(text)))
                i += 1
    rows += [(i, ""), (i + 1, None), (i + 2, " \n"), (i + 3, "one"), (i + 4, "ONE")]
    rows += [(i + 5, "the line again\n" * 40), (i + 6, "the line again\n" * 41), (i + 7, "the line again\n" * 80)]
    return rows


def test_near_equals_brute_force(docs_of):
    rows = near_texts()
    got = order_minhash.near_classes(docs_of(rows))
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got.collect()) == near_brute(rows)
    assert sorted(r.doc_id for r in got.where("kept").collect()) == sorted({c for _, c, _ in near_brute(rows)})


def test_near_finds_all_links_of_a_large_group(docs_of):
    """A chain and a crowd in common buckets, with few hash functions left to chance."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(80):
        text = list(base)
        text[i * 2] = f"edit{i}"
        rows.append((i, " ".join(text)))
    far = [(1000 + i, " ".join(base[:60] + [f"o{rng.randrange(9000)}" for _ in range(60)])) for i in range(40)]
    got = {r.doc_id: r.class_id for r in order_minhash.near_classes(docs_of(rows + far)).collect()}
    assert {got[i] for i, _ in rows} == {0}
    assert all(got[i] == i for i, _ in far)


def test_near_stage_and_edges(spark, docs_of):
    df = docs_of([(1, "a b c d e f g"), (2, "A B C D E F G"), (None, "q r s t u v"), (4, None)]).selectExpr("*", "1 AS gone_id", "2 AS node")
    kept = order_minhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "None"]
    assert rows_of(order_minhash.near_classes(spark.createDataFrame([], DOCS))) == []


def test_near_stage_keeps_rows_that_share_an_identifier(spark, docs_of):
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    a, b, c, d, e = (text(200) for _ in range(5))
    near = lambda words: " ".join([*words[:-1], "changed"])
    a, b, c, d, e = (" ".join(x) for x in (a, b, c, d, e))
    rows = [
        (1, a), (None, near(a.split())), (None, b),  # a near copy without identifier, and a clean row
        (None, c), (None, near(c.split())),  # a class of null identifiers only
        (7, near(a.split())), (7, d),  # one identifier, two texts
        (9, e), (9, e), (9, e),  # rows equal in both
    ]
    df = docs_of(rows).selectExpr("*", "1 AS f_id", "2 AS near_text_digest")
    got = [(r.doc_id, r.text) for r in order_minhash.keep_one(df.repartition(3)).collect()]
    assert sorted(t for i, t in got if i is None and t not in (c, near(c.split()))) == [b]
    assert sum(t in (c, near(c.split())) for _, t in got) == 1
    assert [x for x in got if x[0] == 1] == [(1, a)] and [x for x in got if x[0] == 7] == [(7, d)]
    assert [x for x in got if x[0] == 9] == [(9, e)] and len(got) == 5


def test_alignment_similarity():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(12) for _ in range(rng.randrange(1, 30))]
        b = list(a) if rng.random() < 0.7 else [rng.randrange(12) for _ in range(rng.randrange(1, 30))]
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(12))
        got = order_minhash.similarity(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64), 0.8)
        want = alike(a, b)
        assert (got >= 0.8) == (want >= 0.8)
        if want >= 0.8:
            assert got == pytest.approx(want)


def test_order_matters_to_sketches():
    sh = np.random.default_rng(0).integers(0, 1 << 63, 200).astype(np.uint64)
    same = order_minhash.order_keys(sh, 4, 50, 1)
    assert (order_minhash.order_keys(sh.copy(), 4, 50, 1) == same).all()
    assert (order_minhash.order_keys(sh[::-1].copy(), 4, 50, 1) == same).mean() < 0.3


def test_connected(spark):
    links = [(1, 2), (2, 3), (10, 11), (5, 5), (7, 6), (6, 8), (8, 9), (9, 20), (20, 21)] + [(100, 100 + i) for i in range(1, 50)]
    got = dict(rows_of(components.connected(spark.createDataFrame(links, "a bigint, b bigint"))))
    want = {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 7: 6, 6: 6, 8: 6, 9: 6, 20: 6, 21: 6} | {100 + i: 100 for i in range(50)}
    assert got == want


def repeats_brute(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize("window", [4, 12, 50])
def test_repeats_equal_brute_force(docs_of, window):
    rng = random.Random(window)
    vocab = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(vocab) for _ in range(n)] for n in (window - 1, window, window + 1, 2 * window, 3 * window, 200)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(4)):
            text += [rng.choice(vocab) for _ in range(rng.randrange(2 * window))]
            p = rng.choice(passages)
            lo = rng.randrange(len(p))
            text += p if rng.random() < 0.6 else p[lo:]
        rows.append((i, "\t ".join(text)))
    rows += [(60, rows[3][1]), (61, rows[3][1].replace("\t", "\n")), (62, None), (63, ""), (64, " ".join(passages[5] * 3))]
    got = substring_dedup.remove_repeats(docs_of(rows), window=window)
    assert sorted(rows_of(got)) == repeats_brute(rows, window)


def test_difference_covers():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    for width in (1, 2, 3, 20, 50, 299, 300):
        h = substring_dedup.window_hashes(words, width, substring_dedup.BASES[0])
        assert len(h) == 301 - width
        for at in (0, (300 - width) // 2, 300 - width):
            want = 0
            for x in words[at : at + width].tolist():
                want = (want * substring_dedup.BASES[0] + x) % (1 << 64)
            assert int(h[at]) == want


def test_repeats_edges(spark, docs_of):
    long = " ".join(f"w{i}" for i in range(60))
    df = docs_of([(3, long), (3, long), (None, long), (9, long + " tail")]).withColumn("row", F.lit(1)).withColumn("kept", F.lit("x"))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept[:4]) for r in substring_dedup.remove_repeats(df).collect())
    assert got == [("3", 60, 0, "w0 w"), ("3", 60, 0, "w0 w"), ("9", 61, 60, "tail"), ("None", 60, 60, "")]
    assert rows_of(substring_dedup.remove_repeats(spark.createDataFrame([], DOCS))) == []


def test_overlaps_equal_set_intersections():
    rng = np.random.default_rng(3)
    xs = [np.unique(rng.integers(0, 9000, rng.integers(0, 400))).astype(np.uint64) for _ in range(20)] + [np.zeros(0, np.uint64)]
    ys = [np.unique(rng.integers(0, 9000, rng.integers(1, 400))).astype(np.uint64) for _ in range(30)]
    got = order_minhash.overlaps(xs, ys)
    assert (got == [[len(set(x.tolist()) & set(y.tolist())) for y in ys] for x in xs]).all()


def test_near_links_around_a_poor_centre(docs_of):
    """A family of edited copies with few links to its centre, in several blocks."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(80)]
    rows = []
    for i in range(120):
        text = list(base)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(80)] = f"e{rng.randrange(30)}"
        rows.append((i, " ".join(text)))
    got = order_minhash.near_classes(docs_of(rows))
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got.collect()) == near_brute(rows)


def test_block_links_finds_every_component_link(spark):
    """All links that join two labels of a centre, however nodes fall into blocks."""
    rng = random.Random(2)
    base = [rng.randrange(1 << 32) for _ in range(60)]
    texts = {}
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(60)] = rng.randrange(50)
        texts[i] = np.array(words, dtype=np.uint32)
    words = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in texts.items()], "node bigint, words binary")
    label = {i: 0 if i < 25 else i for i in texts}
    stars = spark.createDataFrame([(0, i, 56, label[i]) for i in texts], "at bigint, node bigint, n int, label bigint")
    want, seqs = set(), {i: order_minhash.shingles(t, 5).tolist() for i, t in texts.items()}
    for i in texts:
        for j in texts:
            if i < j and label[i] != label[j] and alike(seqs[i], seqs[j]) >= 0.8:
                want.add(frozenset((label[i], label[j])))
    got = order_minhash.block_links(stars, words, 5, 0.8, block=7).collect()
    assert want and {frozenset((label[r.a], label[r.b])) for r in got} == want
