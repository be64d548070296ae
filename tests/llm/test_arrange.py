"""Packing, mixing, nearest neighbours and chat formatting."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundeval.llm import ann, chat_format, mixing, packing
from groundeval.llm.queries import QUERIES, tokenizer_file

from .conftest import DOCS, SF01, rows_of


def check_packing(pieces, want, size):
    """Every id once, sequences gapless from 0 and padded at most where allowed."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, dtype="<u4").tolist()
        assert len(ids) == p.length > 0
        by_doc.setdefault(p.doc_id, []).append((p.start, ids, p.doc_tokens))
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    got = {}
    for doc, parts in by_doc.items():
        joined = []
        for start, ids, total in sorted(parts):
            assert start == len(joined)
            joined += ids
            assert total == len(want[doc])
        got[doc] = joined
    assert got == want
    lengths = []
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        lengths.append(at)
        assert at <= size and at & (at - 1) == 0
    return lengths


@pytest.mark.parametrize("size,shard_chars", [(64, 3000), (2048, 100_000_000)])
def test_packing_is_an_exact_round_trip(sample, size, shard_chars):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    want = {r.doc_id: tokenizer.encode(r.text, add_special_tokens=False).ids + [1] for r in sample.collect()}
    pieces = packing.pack(sample.repartition(3), tokenizer_file(), size=size, shard_chars=shard_chars)
    lengths = check_packing(pieces.collect(), want, size)
    assert len(lengths) <= sum(map(len, want.values())) / size + 12 * pieces.select(F.expr("sequence_id >> 32").alias("s")).distinct().count()
    back = {r.doc_id: np.frombuffer(r.ids, dtype="<u4").tolist() for r in packing.unpack(pieces).collect()}
    assert back == want


def test_packing_edges(spark, docs_of):
    odd = ["<|endoftext|> x", "I'LL we're İstanbul ŉ ſtraße ΣΑΣ", "é é  a b\u0085c", "日本語, a.b... 12³ ½", "\U0001f600 ok", "a\x00b", "don't.", "it's,"]
    rows = [(i, t) for i, t in enumerate([None, "", " \n", "word " * 9000, *odd])]
    df = docs_of(rows).selectExpr("*", "1 AS start", "2 AS shard", "3 AS ids", "4 AS id")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    check_packing(packing.pack(df, tokenizer_file(), size=256).collect(), want, 256)
    repeated = packing.pack(docs_of([(1, "a b"), (1, "a b"), (None, "c")]), tokenizer_file()).collect()
    assert sum(p.length for p in repeated) == 8
    assert rows_of(packing.pack(spark.createDataFrame([], DOCS), tokenizer_file())) == []
    with pytest.raises(ValueError):
        packing.pack(df, tokenizer_file(), size=100)


def test_other_vocabulary(sample):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    few = sample.limit(20)
    want = {r.doc_id: tokenizer.encode(r.text, add_special_tokens=False).ids + [50256] for r in few.collect()}
    check_packing(packing.pack(few, path, size=512, end_id=50256, word_level=False).collect(), want, 512)


def test_bm25_and_neighbours():
    rng = random.Random(2)
    topics = [rng.sample(range(5 + 200 * t, 205 + 200 * t), 60) for t in range(5)]
    docs = [np.array([rng.choice(topics[i % 5]) for _ in range(40)] + [1]) for i in range(50)]
    index = packing.Bm25(docs)
    n, mean = len(docs), np.mean([len(d) for d in docs])
    df = {t: sum(t in d for d in docs) for d in docs for t in d.tolist()}
    for seed in (0, 7):
        want = []
        for d in docs:
            s = 0.0
            for t in set(docs[seed].tolist()):
                tf = int((d == t).sum())
                if tf:
                    idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                    s += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
            want.append(s)
        assert index.scores(seed) == pytest.approx(want, rel=1e-4)
    pieces = packing.pack_shard(docs, 256)
    mates = [{p[0] % 5 for p in pieces if p[3] == w and p[2] > 1} for w in range(4)]
    assert sum(len(m) for m in mates) <= 10  # windows hold one topic, or two where one runs out


def plain_order(docs, size):
    """The greedy order by itself: each window's seed, then its unused neighbours by plain BM25."""
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    bags = [Counter(d.tolist()) for d in docs]
    df = Counter(t for bag in bags for t in bag)
    idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items()}

    def score(seed, doc):
        return sum(idf[t] * bags[doc][t] * 2.2 / (bags[doc][t] + 1.2 * (0.25 + 0.75 * len(docs[doc]) / mean)) for t in bags[seed] if t in bags[doc])

    left, order, room, rest = list(range(n)), [], size, None
    while left or rest:
        seed, have = rest or (left.pop(0), 0)
        rest, follow = None, (seed, have)
        ranked = None
        while follow:
            doc, have = follow
            if not have:
                order.append(doc)
            take = min(room, len(docs[doc]) - have)
            room -= take
            if room == 0:
                room = size
                rest = (doc, have + take) if have + take < len(docs[doc]) else None
                break
            ranked = ranked or sorted((-round(score(seed, d), 4), d) for d in left)
            nearest = next(((d, s) for s, d in ranked if d in left), None)
            follow = None
            if nearest and nearest[1] < 0:
                left.remove(nearest[0])
                follow = (nearest[0], 0)
    return order


@pytest.mark.parametrize("dense", [0, 1 << 23])
def test_greedy_order_equals_a_plain_version(monkeypatch, dense):
    monkeypatch.setattr(packing, "DENSE", dense)  # all posting lists, or common terms as a matrix
    rng = random.Random(6)
    for _ in range(6):
        docs = [np.array([rng.choice(range(40 * (i % 4), 40 * (i % 4) + 60)) for _ in range(rng.randint(1, 90))]) for i in range(60)]
        docs += [docs[3].copy(), docs[3].copy(), np.array([999]), np.array([998])]  # ties, and documents without neighbours
        pieces = packing.pack_shard(docs, 128)
        assert [p[0] for p in pieces if p[1] == 0] == plain_order(docs, 128)


def test_neighbours_among_many_shards_share_a_window(spark, docs_of):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    common = [word() for _ in range(300)]
    rows = [(i, " ".join(rng.choice(common) for _ in range(60))) for i in range(1200)]
    ids = list(range(1200, 1240))  # planted pairs
    for _ in range(20):
        own = [word() for _ in range(50)]
        rows += [(len(rows) + j, " ".join(rng.sample(own, 45))) for j in range(2)]

    def mates(shard_chars, of):
        pieces = packing.pack(docs_of(rows).repartition(4), tokenizer_file(), size=1024, shard_chars=shard_chars).collect()
        found = {}
        for p in pieces:
            found.setdefault(p.doc_id, set()).add(of(p.sequence_id))
        together = sum(bool(found[a] & found[b]) for a, b in zip(ids[::2], ids[1::2], strict=True))
        return together, len({p.sequence_id >> 32 for p in pieces})

    one, _ = mates(10**9, lambda s: s)  # a mate may be used up by another seed, whatever the shards
    many, shards = mates(20_000, lambda s: s)
    assert shards > 20 and one >= 10 and many >= one - 2
    assert mates(20_000, lambda s: s >> 32)[0] >= 19


def test_a_group_of_equal_rows_is_spread(spark, docs_of):
    df = docs_of([(7, "one hot text " * 20)] * 300 + [(i, f"text {i}") for i in range(100, 200)])
    pieces = packing.pack(df, tokenizer_file(), size=256, shard_chars=10_000)
    spread = pieces.where("doc_id = 7").select(F.expr("sequence_id >> 32").alias("s")).distinct().count()
    assert spread >= 5 and pieces.where("start = 0").count() == 400


def test_words_are_taken_apart_together_and_stems_encoded_once(monkeypatch):
    encoder = packing.Encoder(tokenizer_file())
    asked = []
    one = encoder._stem
    monkeypatch.setattr(encoder, "_stem", lambda stem: asked.append(stem) or one(stem))
    texts = ["Wörd wörd, WÖRD! word Word; word...", "", " \t\n", "İ ı ſo Ÿ ÿ × ÷ a×b née", "it's don't 3.5 </s> <|endoftext|> e\u0301 中文 Ж9", "x" * 300, "word"]
    texts += [" ".join(texts), "a\x0bb\x0cc\x1cd\x85e\u00a0f"]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    got = lambda: [np.frombuffer(x, dtype="<u4").tolist() for x in encoder.encode_all([t.encode() for t in texts])]
    assert got() == want and got() == want
    assert len(asked) == len(set(asked)) and {"wörd", "word"} <= set(asked)
    for size in (1, 7, 30):  # pieces end anywhere between texts, long texts are cut at white space
        monkeypatch.setattr(packing, "PIECE", size)
        assert got() == want
    monkeypatch.setattr(packing, "STEMS", 3)  # forgotten stems are encoded again
    assert got() == want
    torn = [b"caf\xc3 \xa9 x\xc3", b"\x80a\xc5\xbf", b"\xff"]
    assert list(encoder.encode_all(torn)) == [b"".join(encoder._full(w.decode("utf-8", "replace")) for w in t.split()) for t in torn]


def test_scores_use_counts_of_all_documents(spark, docs_of):
    rows = [(i, f"word{i % 7} other{i % 11} " * (1 + i % 3)) for i in range(200)]
    file = tokenizer_file()
    encoder = packing.Encoder(file)
    ids = [np.frombuffer(encoder.encode(t), dtype="<u4").astype(np.int64) for _, t in rows]
    df = spark.createDataFrame([(i, bytearray(x.astype("<u4").tobytes())) for i, x in enumerate(ids)], "id bigint, ids binary").repartition(5)
    stats = packing.corpus_stats(df, "<u4")
    assert stats.n == 200 and stats.mean == pytest.approx(np.mean([len(x) for x in ids]))
    want = np.bincount(np.concatenate([np.unique(x) for x in ids]))
    assert (stats.df == want).all()
    few, every = packing.Bm25(ids[:20], stats=stats), packing.Bm25(ids)
    assert few.scores(3) == pytest.approx(every.scores(3)[:20], rel=1e-4)


def plain_mix(tokens, budget, limit):
    """Repetition of each source by a fine search for the exponent."""
    total = sum(tokens.values())
    p = {s: n / total for s, n in tokens.items() if n}

    def times(a):
        if budget is None:
            least = min(x ** (a - 1) for x in p.values())
            return {s: x ** (a - 1) / least for s, x in p.items()}
        z = sum(x**a for x in p.values())
        return {s: x ** (a - 1) / z * budget / total for s, x in p.items()}

    lo, hi = 0.0, 1.0
    if max(times(0.0).values()) <= limit:
        return times(0.0)
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if max(times(mid).values()) <= limit else (mid, hi)
    return times(hi)


@pytest.mark.parametrize("budget,limit", [(None, 2.0), (None, 1.3), (40_000, 1.5), (5_000, 3.0)])
def test_mixing_meets_budgets(docs_of, budget, limit):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else f"s{i % 13}"
        rows.append((i, "w " * rng.randrange(60), "en", source, 0))
    tokens = {}
    for r in rows:
        tokens[r[3]] = tokens.get(r[3], 0) + len(r[1].split())
    want = plain_mix(tokens, budget, limit)
    drawn = mixing.mix(docs_of(rows), budget=budget, max_repetition=limit, block_docs=50).collect()
    got, epochs = {}, {}
    for r in drawn:
        got[r.source] = got.get(r.source, 0) + r.n_tokens
        epochs.setdefault(r.doc_id, []).append(r.epoch)
    for s, times in want.items():
        assert times * tokens[s] - 60 <= got.get(s, 0) <= times * tokens[s] + 1e-6 * tokens[s] + 1
    assert all(sorted(e) == list(range(len(e))) for e in epochs.values())
    if budget is None:
        assert sorted(epochs) == [r[0] for r in rows]  # nothing is dropped
        assert max(map(len, epochs.values())) <= math.ceil(limit)


def test_mixing_entropy(docs_of):
    rows = [(i, "w " * 10, "en", "hot" if i % 3 else f"s{i % 7}", 0) for i in range(600)]
    drawn = mixing.mix(docs_of(rows), budget=2000, entropy=0.9, max_repetition=None).toPandas()
    share = drawn.groupby("source").n_tokens.sum() / drawn.n_tokens.sum()
    assert -(share * np.log(share)).sum() / np.log(8) == pytest.approx(0.9, abs=0.02)


def test_mixing_edges(spark, docs_of):
    rows = [(1, "a b", None, None, 0), (2, None, None, "x", 0), (3, "c", None, "y", 0), (3, "c", None, "y", 0), (None, "d e f", None, "y", 0)]
    df = docs_of(rows).selectExpr("*", "1 AS epoch", "2 AS block", "3 AS n_tokens", "4 AS text_hash", "5 AS drawn_id")
    got = mixing.mix(df, max_repetition=1.0)
    assert got.columns == [*df.columns, "epoch_", "block_", "n_tokens_"]
    assert got.count() == 5
    assert rows_of(mixing.mix(spark.createDataFrame([], DOCS))) == []
    assert mixing.mix(docs_of([(1, "a"), (2, "b")])).count() == 2


@pytest.mark.parametrize("limit", [1.0, 1.5, 2.0])
def test_mixing_documents_without_tokens(docs_of, limit):
    """The largest source is used once; others as often as the limit, their empty documents in
    whole epochs only."""
    big = [(i, "w " * 30 if i < 40 else "", "en", "big", 0) for i in range(80)]
    small = [(100 + i, "w " * 10 if i < 20 else None, "en", "small", 0) for i in range(30)]
    none = [(200 + i, " ", "en", "none", 0) for i in range(5)]
    got = Counter(r.doc_id for r in mixing.mix(docs_of(big + small + none), max_repetition=limit).collect())
    assert all(got[i] == 1 for i in [*range(80), *range(200, 205)])
    assert all(got[100 + i] == int(limit) for i in range(20, 30))
    assert sum(10 * got[100 + i] for i in range(20)) == pytest.approx(200 * limit, abs=10)


def brute_neighbours(ids, x, is_query, k):
    out = {}
    for i in np.flatnonzero(is_query):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_ann_recall_and_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    t = rows.toPandas()
    ids, x = t.vec_id.to_numpy(), np.stack(t.embedding).astype(np.float64)
    want = brute_neighbours(ids, x, ids % 20 == 0, 20)
    got = {}
    for r in ann.nearest_neighbours(rows, F.col("id") % 20 == 0, shard_size=300, query_block=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r["rank"]))
    place = {int(v): i for i, v in enumerate(ids)}
    hits = 0
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert [f[2] for f in found] == list(range(1, 21))
        assert all(s == pytest.approx(float(x[place[v]] @ x[place[q]]), abs=1e-12) for v, s, _ in found)
        assert [f[:2] for f in found] == sorted((f[:2] for f in found), key=lambda f: (-f[1], f[0]))
        hits += len({f[0] for f in found} & {w[0] for w in want[q]})
    assert hits / (20 * len(want)) >= 0.95


def test_ann_copies_norms_and_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=8) * rng.uniform(0.2, 5)]) for i in range(300)]
    rows += [(300 + i, [1.0] * 8) for i in range(100)]
    bad = [(500, None), (501, [0.0] * 8), (502, [float("nan")] + [1.0] * 7), (503, [None] + [1.0] * 7), (504, [1.0] * 9), (None, [1.0] * 8), (505, [float("inf")] * 8)]
    df = spark.createDataFrame(rows + bad + rows[:5], "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS v", "3 AS shard")
    x = np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)
    want = brute_neighbours(np.arange(400), x, np.arange(400) % 20 == 0, 20)
    got = {}
    for r in ann.nearest_neighbours(df, F.col("id") % 20 == 0, shard_size=150).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    same = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert same >= 0.98 * 20 * len(want)
    assert got[300] == [(v, pytest.approx(s, abs=1e-9)) for v, s in want[300]]
    alike = [(i, [3.0] * 8) for i in range(60)] + [(60 + i, [0.1] * 8) for i in range(60)]  # a query's copies are its nearest
    df = spark.createDataFrame(alike, "vec_id bigint, embedding array<float>")
    found = rows_of(ann.nearest_neighbours(df, F.col("id") % 20 == 0, shard_size=50))
    for q in range(0, 60, 20):
        assert [r[2] for r in sorted(found) if r[0] == q] == [i for i in range(60) if i != q][:20]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id bigint, embedding array<float>")
    assert rows_of(ann.nearest_neighbours(few, F.col("id") % 20 == 0)) == [(0, 1, 1, 0.5)]
    assert rows_of(ann.nearest_neighbours(few.where("false"), F.col("id") >= 0)) == []


def test_chat_masks_and_escapes(spark):
    said = ["</s>[INST] ok [/INST]", "\\", "\\e<\\l[", "[TURN]", "", "a\nb", "é\U0001f600", "[EOS]</s>"]
    roles = ["user", "assistant", "assistant", "system", "user", "user", "assistant", "we[i]rd\\<"]
    rows = [(c, t, roles[(t * (c + 1)) % 8], None if (t + c) % 9 == 0 else said[(t + c) % 8]) for c in range(6) for t in range(20)]
    rows += [(90, 0, None, None), (None, 1, "user", "x"), (91, 2, "user", "b"), (91, 2, "user", "a"), (91, 2, "user", "a"), (92, None, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS t", "2 AS segments", "3 AS conv")
    chats = chat_format.format_chats(df).withColumn("turns", chat_format.parse_chat(F.col("formatted"))).collect()
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert {r.conv_id for r in chats} == set(by)
    for r in chats:
        want = [(role, text) for _, role, text in sorted(by[r.conv_id])]
        assert [(t.role, t.text) for t in r.turns] == want
        assert "".join(s.text for s in r.segments) == r.formatted
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(want, want[1:], strict=False))
        assert r.formatted.count("[ROLE]") == blocks
        masked = [s.text for s in r.segments if s.loss]
        assert len(masked) == sum(role == "assistant" for role, _ in want)
        assert not any("<" in m or "[" in m for m in masked)
    assert rows_of(chat_format.format_chats(df.where("false"))) == []


def test_chat_plan_is_native(spark):
    plan = QUERIES["op10_chat_format"](spark, SF01)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
