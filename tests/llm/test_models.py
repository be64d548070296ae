"""Language identification, language-model scores and toxicity against plain versions."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundeval.llm import lang_id, lm_score, toxicity
from groundeval.llm.common import in_fold
from groundeval.llm.queries import QUERIES

from .conftest import DOCS, SF01, rows_of


def fold(i, modulus, remainder):
    return zlib.crc32(str(i).encode()) % modulus == remainder


def plain_grams(text):
    grams, run = Counter(), ""
    for ch in text.lower() + " ":
        if ch.isalpha():
            run += ch
        elif run:
            padded = f"_{run}_"
            for n in (1, 2, 3):
                for i in range(len(padded) - n + 1):
                    if padded[i : i + n] != "_":
                        grams[padded[i : i + n]] += 1
            run = ""
    return grams


def plain_profile(grams, size):
    return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], x[0]))[:size]]


def plain_predict(text, profiles, size):
    grams = plain_grams(text or "")
    if text is None or not grams:
        return "und", 0.0
    top = plain_profile(grams, size)
    best = None
    for lang in sorted(profiles):
        rank = {g: i for i, g in enumerate(profiles[lang])}
        d = sum(abs(i - rank[g]) if g in rank else size for i, g in enumerate(top))
        if best is None or d < best[0]:
            best = (d, lang)
    return best[1], 1 - best[0] / (size * len(top))


def test_profiles_equal_plain_version(sample):
    size = 60
    rows = sample.select("doc_id", "text", "lang").collect()
    sums = {}
    for r in rows:
        if not fold(r.doc_id, 4, 2):
            sums.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    profiles = {x: plain_profile(c, size) for x, c in sums.items()}
    got = lang_id.identify(sample.repartition(5), ~in_fold("doc_id", 4, 2), profile_size=size)
    got = {r.doc_id: (r.lang_pred, r.score) for r in got.collect()}
    for r in rows:
        lang, score = plain_predict(r.text, profiles, size)
        assert got[r.doc_id][0] == lang and got[r.doc_id][1] == pytest.approx(score)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = QUERIES["op7_lang_id"](spark, SF01).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    assert got.agg(F.min("score") >= 0, F.max("score") <= 1).first() == (True, True)


def test_language_edges(spark, docs_of):
    rows = [
        (1, "the cat and the dog", "en", "s", 1), (2, "der Hund und die Katze", "de", "s", 1), (3, None, "en", "s", 0),
        (4, "", None, "s", 0), (5, "12 34 !!", None, "s", 0), (6, "the cat", None, "s", 1), (6, "the cat", None, "s", 1),
        (None, "die Katze", None, None, 1), (8, "日本 的 the " * 30_000, None, "s", 1),
    ]
    df = docs_of(rows).selectExpr("*", "1 AS lang_pred", "2 AS score", "3 AS id", "4 AS gram")
    got = [(r.doc_id, r.lang_pred) for r in lang_id.identify(df).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (6, "en"), (None, "de"), (8, "en")], key=str
    )
    kept = lang_id.keep_identified(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "6", "6", "8", "None"]
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in lang_id.identify(unlabelled).collect()} == {"und"}
    assert lang_id.keep_identified(unlabelled, min_score=0.5).count() == 6
    empty = spark.createDataFrame([], DOCS)
    assert rows_of(lang_id.identify(empty)) == [] and rows_of(lang_id.keep_identified(empty)) == []
    with pytest.raises(ValueError):
        lang_id.train_profiles(docs_of(rows), max_languages=1)


def test_toxicity_held_out(spark):
    got = QUERIES["op9_toxicity"](spark, SF01)
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    held = got.where("held_out").join(labels, "doc_id").toPandas()
    clean, toxic = held[held.toxic == 0], held[held.toxic == 1]
    assert (clean.predicted == 0).mean() > 0.95
    assert toxic.score.mean() > clean.score.mean() + 0.2
    everything = got.toPandas()
    assert everything.score.between(0, 1).all() and ((everything.score >= 0.7) == (everything.predicted == 1)).all()
    assert everything.held_out.tolist() == [fold(i, 3, 1) for i in everything.doc_id]


def test_toxicity_recall_in_each_language(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    got = QUERIES["op9_toxicity"](spark, sf).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    recall = got[got.toxic == 1].groupby("lang").predicted.mean()
    assert set(recall.index) == {"de", "en", "es", "fr"} and (recall >= 0.5).all()
    assert (got[got.toxic == 0].groupby("lang").predicted.mean() < 0.05).all()


def test_toxicity_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    held = in_fold("doc_id", 3, 1)
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(docs, x, train=~held) for x in (labels, flipped))
    assert (a == b).all()


def test_toxicity_edges(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "!! ??"), (None, "awful words"), (5, "fine words"), (5, "fine words")]).selectExpr("*", "1 AS pos", "2 AS feats", "3 AS score")
    labels = spark.createDataFrame([(1, 0, None), (4, 1, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(docs, labels)
    assert got.count() == 6 and got.select("score").distinct().count() >= 1
    nothing = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, nothing).collect()} == {0.5}
    assert rows_of(toxicity.toxicity(spark.createDataFrame([], DOCS), nothing)) == []


def test_nnpu_separates_without_negative_labels():
    rng = np.random.default_rng(0)
    noise = lambda: rng.choice(np.arange(100, 4000), 30, replace=False)
    bad = lambda: np.unique(np.concatenate([noise(), rng.choice(50, 4, replace=False)]))
    pos, unl = [bad() for _ in range(200)], [bad() if i % 10 == 0 else noise() for i in range(1000)]
    w = toxicity.train_nnpu(pos, unl, 0.1, 12, 300, 0.05, 3e-5, 0.02, 4.0)
    score = np.array([toxicity.sigmoid(w[-1] + w[d].sum()) for d in unl])
    assert (score[::10] >= 0.7).mean() > 0.9 and (np.delete(score, np.arange(0, 1000, 10)) < 0.7).mean() > 0.99


def plain_unigram(rows, train):
    c = Counter()
    for i, t in rows:
        if train(i):
            c.update(lm_score.tokens(t) + [None])
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in rows:
        words = lm_score.tokens(t) + [None]
        out[i] = (len(words), sum(c[w] > 0 for w in words), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words))
    return out


def test_lm_counts_and_base_score(sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    want = plain_unigram(rows, lambda i: not fold(i, 7, 2))
    got = lm_score.lm_score(sample.repartition(4), ~in_fold("doc_id", 7, 2)).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, train, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train)
        assert r.base_score == pytest.approx(base)
        assert r.score < 0


def test_tokens():
    assert lm_score.tokens("A\tb\x0bC\x0c d\r\né É x") == [b"a", b"b", b"c", b"d", "é".encode(), "É x".encode()]
    assert lm_score.tokens(None) == [] and lm_score.tokens(" \n") == []


def plain_trie(counts, ends, order):
    nodes = {}
    for word, c in counts.items():
        seq = b" " + word + b" "
        for i in range(1, len(seq)):
            for k in range(min(order, i) + 1):
                nodes.setdefault(seq[i - k : i], Counter())[seq[i]] += c
    for k in range(min(order, 1) + 1):
        if ends:
            nodes.setdefault(b" "[:k], Counter())[lm_score.END] += ends
    return nodes


def plain_byte(nodes, history, byte, order):
    """log10 probability by walking down the orders; also usable for any other byte."""
    p, out = 0.0, set()
    for k in range(min(order, len(history)), -1, -1):
        node = nodes.get(history[len(history) - k :])
        if not node:
            continue
        total, kept = sum(node.values()), {s: c - 0.5 for s, c in node.items()}
        escape = total - sum(kept.values())
        z = escape + sum(w for s, w in kept.items() if s not in out)
        if byte in node and byte not in out:
            return p + math.log10(kept[byte] / z)
        p += math.log10(escape / z)
        out |= set(node)
    return p - math.log10(max(lm_score.ALPHABET - len(out), 1))


def build_trie(spark, counts, ends, order, min_share=0.0):
    rows = spark.createDataFrame([(bytearray(w), c) for w, c in counts.items()], "word binary, c bigint")
    return lm_score.train_trie(rows, ends, order, min_share)


@pytest.mark.parametrize("order", [0, 2, 5, 6])
def test_byte_model_equals_plain_ppm(spark, order):
    counts = {b"the": 40, b"then": 7, b"hen": 3, "né".encode(): 2, b"a": 9, b"banana": 5, b"zzzzzzzz": 1, b"unseen": 0}
    trie = build_trie(spark, counts, 4, order)
    nodes = plain_trie({w: c for w, c in counts.items() if c}, 4, order)
    words = [*counts, b"thenthe", b"x", b"\xff", b"bananas"]
    got = trie.words(words)
    for w, g in zip(words, got, strict=True):
        seq = b" " + w + b" "
        assert g == pytest.approx(sum(plain_byte(nodes, seq[:i], seq[i], order) for i in range(1, len(seq))))
    assert trie.end() == pytest.approx(plain_byte(nodes, b" ", lm_score.END, order))


def test_byte_model_sums_to_one_even_when_pruned(spark):
    counts = {bytes([97 + i % 5, 98 + i % 7, 99 + i % 3]): 1 + i for i in range(60)}
    for share in (0.0, 0.003, 0.02):
        trie = build_trie(spark, counts, 2, 4, share)
        symbols = [s for s in range(256) if s not in (9, 11, 12, 13)]
        for history in (b" ", b" a", b" ab", b" zz"):
            keys = []
            for k in range(5):
                key = 0
                for x in history[len(history) - k :] if k <= len(history) else b"":
                    key = key << 8 | x
                keys.append(np.full(len(symbols), k << 56 | key, dtype=np.uint64))
            logp = trie.log10(keys, np.full(len(symbols), min(4, len(history))), np.array(symbols))
            assert (10.0**logp).sum() == pytest.approx(1.0)


def test_byte_model_keeps_what_is_rare_among_many_bytes(docs_of):
    rare = ["qzx", "qzxq", "tuvwxyz", "né"]
    rows = [(i, "common " * 200_000) for i in range(2)] + [(10 + i, w) for i, w in enumerate(rare)]
    asked = ["qzx", "qzy", "tuvwxyzz", "né", "common", "x"]
    rows += [(100 + i, w) for i, w in enumerate(asked)] + [(99, "")]
    got = {r.doc_id: r.score for r in lm_score.lm_score(docs_of(rows), F.col("doc_id") < 50, token_order=0).collect()}
    nodes = plain_trie(Counter({b"common": 400_000, **{w.encode(): 1 for w in rare}}), 6, 6)
    for i, w in enumerate(asked):
        seq = b" " + w.encode() + b" "
        want = sum(plain_byte(nodes, seq[:j], seq[j], 6) for j in range(1, len(seq)))
        assert got[100 + i] - got[99] == pytest.approx(want)


def test_packed_runs_and_numbers_round_trip():
    rng = np.random.default_rng(3)
    for top in (1, 200, 1 << 20, 1 << 43, (1 << 64) - 1):
        run = np.sort(rng.integers(0, top, 500, dtype=np.uint64, endpoint=True))
        for some in (run, run[:1], run[:0]):
            assert (lm_score.unpack_run(lm_score.pack_run(some)) == some).all()
            if len(some):
                assert (lm_score.unpack_keys(lm_score.pack_keys(some)) == some & lm_score.KEY_BITS).all()
        numbers = rng.integers(-5, 1 << 40, 77)
        assert (lm_score.unpack_numbers(lm_score.pack_numbers(numbers)) == numbers).all()


def test_numbers_take_the_byte_places_they_need():
    rng = np.random.default_rng(8)
    for top, most in ((3, 0.5), (1 << 8, 1.1), (1 << 16, 2.2)):
        x = rng.integers(0, top, 1000)
        packed = lm_score.pack_numbers(x)
        assert packed[0] == max(1, (top - 1).bit_length() // 8) and len(packed) <= most * len(x)
    for x in ([], [0], [255], [256], [1 << 62, 0], [-1, 5]):
        assert lm_score.unpack_numbers(lm_score.pack_numbers(np.array(x, dtype=np.int64))).tolist() == x


def test_code_lengths_travel_whole_in_fewer_bytes():
    rng = np.random.default_rng(8)
    logs = -40 * rng.random(400) - 1
    assert len(lm_score.pack_logs(logs)) <= 7.2 * len(logs)
    for x in (logs, np.zeros(0), np.array([0.0, -0.0, -np.inf, -1e-300, 3.5])):
        assert lm_score.unpack_logs(lm_score.pack_logs(x)).tobytes() == x.tobytes()
    table = lm_score.ask_rows(-1, lm_score.TOKEN, np.sort(rng.integers(0, 1 << 63, 400).astype(np.uint64)), 3, np.ones(400), logs)
    assert np.concatenate([lm_score.unpack_logs(x) for x in table["logs"].to_pylist()]).tobytes() == logs.tobytes()


def test_ranked_counts_inside_documents():
    keys = np.random.default_rng(4).integers(0, 1 << 63, 9).astype(np.uint64)[np.random.default_rng(5).integers(0, 9, 60)]
    doc = np.repeat(np.arange(6), 10)
    place, own = lm_score.ranked(keys, doc)
    assert (np.unique(keys)[place] == keys).all()
    assert own.tolist() == [sum((keys == k) & (doc == d)) for k, d in zip(keys, doc, strict=True)]
    assert [len(x) for x in lm_score.ranked(keys[:0], doc[:0])] == [0, 0]
    for text in (b"", b"x", b"some words " * 99):
        assert lm_score.unpack_text(lm_score.pack_text(text)) == text


def test_token_contexts_equal_plain_version():
    rng = random.Random(0)
    docs = [[rng.randrange(6) for _ in range(rng.randrange(40))] for _ in range(30)]
    docs += [list(d) for d in docs[:5]]
    train = [i % 4 != 1 for i in range(len(docs))]
    order = 3
    table = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 6).astype(np.uint64))
    words = np.concatenate([table[d] if d else np.zeros(0, np.uint64) for d in docs])
    doc = np.repeat(np.arange(len(docs), dtype=np.int32), [len(d) for d in docs])
    flags = np.array(train)[doc]
    base = -np.arange(1.0, len(words) + 1)
    got = lm_score.with_token_contexts(words, doc, flags, base.copy(), order)
    spots = [(i, j) for i, d in enumerate(docs) for j in range(len(d))]
    seen = {}
    for i, j in spots:
        if j < order:
            continue
        ctx, w = tuple(docs[i][j - order : j]), docs[i][j]
        others = [(a, b) for a, b in spots if b >= order and a != i and train[a] and tuple(docs[a][b - order : b]) == ctx]
        seen[i, j] = (len(others), sum(docs[a][b] == w for a, b in others))
    rate = {}
    for k in range(1, 7):
        mine = [c for (i, _), (t, c) in seen.items() if train[i] and min(t, 6) == k]
        rate[k] = (sum(c > 0 for c in mine) + 1) / (len(mine) + 2)
    for at, spot in enumerate(spots):
        total, same = seen.get(spot, (0, 0))
        if not total:
            want = base[at]
        elif same:
            want = math.log10(rate[min(total, 6)] * same / total)
        else:
            want = base[at] + math.log10(1 - rate[min(total, 6)])
        assert got[at] == pytest.approx(want)


def test_lm_beats_the_unigram_on_held_out_texts(spark):
    got = QUERIES["op3_lm_score"](spark, SF01)
    total = got.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert total.s > 0.95 * total.b and total.s < 0


def test_lm_blocks_and_lookup(spark, docs_of):
    hot = "the same text again and again " * 20
    df = docs_of([(i, hot if i % 3 == 0 else f"text number {i} of many") for i in range(300)])
    flat = df.select(F.col("doc_id").alias("id"), "text", F.lit(True).alias("train"))
    blocks, n = lm_score.block_table(flat, 20_000)
    sizes = [r["count"] for r in blocks.groupBy("block").count().collect()]
    assert n > 3 and sum(sizes) == 300 and max(sizes) < 150
    table = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    asked = np.random.default_rng(2).permutation(table)
    assert (table[lm_score.Lookup(table)(asked)] == asked).all()


def test_lm_scores_do_not_depend_on_blocks(sample):
    train = ~in_fold("doc_id", 7, 2)
    docs = sample.unionByName(sample.limit(20))  # copies, so that token contexts are found
    one, many = (sorted((r.doc_id, r.score) for r in lm_score.lm_score(docs, train, block_bytes=n).collect()) for n in (10**9, 40_000))
    assert [i for i, _ in one] == [i for i, _ in many]
    assert [s for _, s in one] == pytest.approx([s for _, s in many], rel=1e-9)


def test_lm_token_contexts_equal_one_piece(spark, docs_of):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(40))) for _ in range(60)]
    rows = list(enumerate([*texts, *texts[:9]]))
    got = {r.doc_id: r.score for r in lm_score.lm_score(docs_of(rows), F.col("doc_id") % 4 != 1, block_bytes=2000).collect()}
    plain = {r.doc_id: r.score for r in lm_score.lm_score(docs_of(rows), F.col("doc_id") % 4 != 1, token_order=0).collect()}
    words, doc, _ = lm_score.text_tokens([t for _, t in rows], lm_score.WordHasher())
    # code lengths of the six tokens and the end, from single-token texts
    ones = {r.doc_id: r for r in lm_score.lm_score(docs_of(rows + [(1001 + 4 * i, x) for i, x in enumerate(["", *"abcdef"])]), (F.col("doc_id") % 4 != 1) & (F.col("doc_id") < 1000), token_order=0).collect()}
    end = ones[1001].score
    code = {lm_score.WordHasher()(x.encode())[0]: ones[1005 + 4 * i].score - end for i, x in enumerate("abcdef")} | {lm_score.END_HASH: end}
    logp = np.array([code[w] for w in words])
    assert np.bincount(doc, weights=logp) == pytest.approx([plain[i] for i, _ in rows])
    want = lm_score.with_token_contexts(words, doc, (np.arange(len(rows)) % 4 != 1)[doc], logp, 3)
    assert np.bincount(doc, weights=want) == pytest.approx([got[i] for i, _ in rows])


def test_lm_uses_contexts_of_six_bytes(docs_of):
    df = docs_of([(i, "abcdefx ybcdefz") for i in range(30)])
    got, five, six = (lm_score.lm_score(df, token_order=0, **p).first().score for p in ({}, {"max_order": 5}, {"max_order": 6}))
    assert got == pytest.approx(six) and six > five


def test_lm_edges(spark, docs_of):
    df = docs_of([(1, None), (2, " \n"), (None, "a b"), (4, "a b"), (4, "a b"), (5, "x" * 70_000)]).selectExpr("*", "1 AS c", "2 AS word", "3 AS block", "4 AS train")
    got = {(r.doc_id, r.n_tokens): r for r in lm_score.lm_score(df, F.col("doc_id") != 5).collect()}
    assert sum(1 for _ in lm_score.lm_score(df).collect()) == 6
    assert got[1, 1].score == got[2, 1].score and got[1, 1].n_known == 1
    assert got[5, 2].n_known == 1 and got[5, 2].score < -1000
    assert {r.train_tokens for r in got.values()} == {2 * 1 + 2 * 3}
    nothing = lm_score.lm_score(df, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0.0 for r in nothing)
    assert rows_of(lm_score.lm_score(spark.createDataFrame([], DOCS))) == []
