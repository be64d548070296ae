"""Language-model scoring by prediction by partial matching (PPM) over bytes.

A text is its white-space tokens, A-Z lower-cased, each followed by one space, then an end
symbol.  The model has two layers of contexts, tried from the longest down:

* Whole tokens: the ``token_order`` tokens before.  After ``T`` training occurrences of a
  context a token seen ``c`` times there has probability ``c / T`` of the part that does not
  escape; how often contexts with so many occurrences escape is estimated from training
  texts.  Contexts and what follows them are counted over all training texts, and a
  document's own occurrences are left out.
* Bytes: a trie of byte contexts of order 0 .. ``max_order``, reaching back to the space
  before the current token, over all training texts.  A byte not seen in a context costs an
  escape and is looked up one order lower, where the bytes that the longer context offered
  are excluded; below order 0 the remaining alphabet is uniform.  In a context with total
  ``T`` a byte with count ``c`` weighs ``c - 1/2`` and the escape the rest (method D).

A token's byte code length does not depend on its neighbours, so it is computed once per
distinct token of the corpus, and a document's log-probability is a sum over its tokens.

Counts come from all training texts and none is left out.  The trie is never in one place: a
token's longest contexts, each with its byte, determine all shorter ones, and contexts of three
bytes and more that end alike share their last three bytes.  So the distinct (longest context,
byte) pairs of chunks of tokens are dealt by those three bytes; whoever gets them counts,
builds that part of the trie, and answers with code lengths.  Contexts of two bytes or fewer
(65,793 at most) go to everyone.

Tokens and token contexts are never collected either.  Blocks of documents ask for what they
hold: their distinct token contexts, with their own counts, travel as packed sorted runs by hash
range; a range adds up the counts of all blocks and answers in the order of the run, so no key
goes back.  Only tokens after a context that another document has too are asked for in
a second round.  Blocks have about ``block_bytes`` and gather documents that resemble each
other (equal smallest shingle hash), so that they ask for fewer contexts; a group of resembling
documents above that is spread over several.  Scores do not depend on how blocks are cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundeval.functions.rolling import pack_run, unpack_run
from groundeval.llm.common import WordHasher, as_bytes, cut_lineage, mix, shuffle_partitions

SPACE, END = 0x20, 0x0A
ALPHABET = 252  # bytes but the six white-space ones, then the space after a token and the end
LOG10 = float(np.log(10.0))
END_HASH = np.uint64(0x2545F4914F6CDD1D)  # stands for the end among token hashes
LOW_ORDER = 2  # byte contexts up to here are sent to every task
CHUNK_WORDS = 200_000
PART_PAIRS = 2_000_000
KEY_BITS = np.uint64(((1 << 56) - 1) << 8)  # of a token context's hash
END_KEY = END_HASH & KEY_BITS
LOW48, ORDER_BITS = np.uint64((1 << 48) - 1), np.uint64(0xFF << 56)
TOKEN, CONTEXT, PAIR = 0, 1, 2  # what a block asks for
RATES = 6  # contexts with so many occurrences or more escape alike
BROADCAST_ROWS = 100_000  # resembling groups above a block's size; beyond, they are joined by shuffle


def tokens(text: str | None) -> list[bytes]:
    """Runs of ``[^\\x20\\x09-\\x0D]`` of the text with A-Z lower-cased, as UTF-8."""
    return as_bytes(text).lower().split()


def contexts(words: list[bytes], max_order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """For every coded byte of the tokens: the token's number, the byte, how far back the
    token's own history goes, and its context of each order packed into an integer whose
    top byte is the order."""
    buf = np.frombuffer(b"".join(b" " + w + b" " for w in words), dtype=np.uint8).astype(np.uint64)
    lens = np.array([len(w) + 2 for w in words], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), lens)
    offset = np.arange(len(buf)) - np.repeat(np.cumsum(lens) - lens, lens)
    at = np.flatnonzero(offset > 0)
    keys, hist = [], np.zeros(len(at), dtype=np.uint64)
    for k in range(max_order + 1):
        if k:
            hist = hist | (buf[np.maximum(at - k, 0)] << np.uint64(8 * (k - 1)))
        keys.append(hist | np.uint64(k << 56))
    return owner[at], buf[at].astype(np.int64), offset[at], keys


class Trie:
    """Flat arrays: sorted context keys, where each one's bytes begin, bytes, weights, and
    the escape weight of each context.  ``arrays`` is what is sent to tasks."""

    def __init__(self, max_order: int, arrays: tuple[np.ndarray, ...]):
        self.max_order, self.arrays = max_order, arrays
        self.keys, self.start, self.syms, self.weights, self.escape = arrays

    @classmethod
    def build(cls, keys: np.ndarray, totals: np.ndarray, syms: list[bytes], counts: list[np.ndarray], max_order: int) -> Trie:
        order = np.argsort(keys)
        lens = np.array([len(syms[i]) for i in order], dtype=np.int64)
        start = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        kept = np.concatenate([counts[i] for i in order]) if len(order) else np.zeros(0)
        weights = kept.astype(np.float64) - 0.5
        inside = np.add.reduceat(weights, start[:-1]) if len(order) else np.zeros(0)
        flat = np.frombuffer(b"".join(syms[i] for i in order), dtype=np.uint8)
        return cls(max_order, (keys[order], start, flat, weights, totals[order].astype(np.float64) - inside))

    def log10(self, keys: list[np.ndarray], depth: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """log10 probability of ``byte`` after each context; ``depth`` limits the order."""
        n = len(byte)
        logp = np.zeros(n)
        out = np.zeros((n, 256), dtype=bool)  # excluded bytes
        open_ = np.ones(n, dtype=bool)
        for k in range(self.max_order, -1, -1):
            if not len(self.keys):
                break
            rows = np.flatnonzero(open_ & (depth >= k))
            at = np.searchsorted(self.keys, keys[k][rows])
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == keys[k][rows]
            rows, at = rows[hit], at[hit]
            lens = self.start[at + 1] - self.start[at]
            flat = np.repeat(self.start[at] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
            who = np.repeat(np.arange(len(rows)), lens)
            sym, weight = self.syms[flat], self.weights[flat]
            fresh = ~out[rows[who], sym]
            total = self.escape[at] + np.bincount(who[fresh], weights=weight[fresh], minlength=len(rows))
            mine = (sym == byte[rows][who]) & fresh
            won = np.zeros(len(rows))
            won[who[mine]] = weight[mine]
            coded = won > 0
            some = total > 0
            logp[rows[coded]] += np.log(won[coded] / total[coded])
            esc = ~coded & some
            logp[rows[esc]] += np.log(self.escape[at[esc]] / total[esc])
            open_[rows[coded]] = False
            out[rows[who], sym] = True
        rest = np.flatnonzero(open_)
        logp[rest] -= np.log(np.maximum(ALPHABET - out[rest].sum(axis=1), 1))
        return logp / LOG10

    def words(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each token with the space that ends it."""
        result = np.zeros(len(words))
        for lo in range(0, len(words), 2000):
            part = words[lo : lo + 2000]
            owner, byte, depth, keys = contexts(part, self.max_order)
            depth = np.minimum(depth, self.max_order)
            # equal histories give equal probabilities: each is worked out once
            last = np.choose(depth, keys) if len(depth) else np.zeros(0, np.uint64)
            _, first, back = np.unique(last * np.uint64(256) + byte.astype(np.uint64) + (last >> np.uint64(56)), return_index=True, return_inverse=True)
            logp = self.log10([k[first] for k in keys], depth[first], byte[first])
            result[lo : lo + len(part)] = np.bincount(owner, weights=logp[back], minlength=len(part))
        return result

    def with_longer(self, pairs: np.ndarray, counts: np.ndarray, max_order: int) -> Trie:
        """This trie with the contexts above its order that the packed ``pairs`` hold."""
        parts = [self.arrays]
        for k in range(self.max_order + 1, max_order + 1):
            own = (counts > 0) & (pairs >> np.uint64(56) >= k)
            if not own.any():
                continue
            pair, at = np.unique(pairs[own] & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            ctx = (pair >> np.uint64(8)) | np.uint64(k << 56)
            start = np.append(np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])), len(ctx))
            weights = np.bincount(at, weights=counts[own]) - 0.5
            parts.append((ctx[start[:-1]], start, (pair & np.uint64(255)).astype(np.uint8), weights, np.diff(start) / 2))
        keys, start, syms, weights, escape = zip(*parts, strict=True)
        first = np.cumsum([0] + [len(x) for x in syms])
        start = [x[:-1] + f for x, f in zip(start, first[:-1].tolist(), strict=True)] + [first[-1:]]
        return Trie(max_order, tuple(map(np.concatenate, (keys, start, syms, weights, escape))))

    def pairs(self, pairs: np.ndarray) -> np.ndarray:
        """log10 probability of each packed pair's byte after its context."""
        out = np.empty(len(pairs))
        for lo in range(0, len(pairs), 20_000):
            part = pairs[lo : lo + 20_000]
            ctx = (part >> np.uint64(8)) & LOW48
            keys = [(ctx & np.uint64((1 << 8 * k) - 1)) | np.uint64(k << 56) for k in range(self.max_order + 1)]
            out[lo : lo + len(part)] = self.log10(keys, (part >> np.uint64(56)).astype(np.int64), (part & np.uint64(255)).astype(np.int64))
        return out

    def end(self) -> float:
        """log10 probability of the end symbol, which is coded where a token would begin."""
        keys = [np.array([k << 56 | (SPACE if k else 0)], dtype=np.uint64) for k in range(self.max_order + 1)]
        return float(self.log10(keys, np.array([1]), np.array([END]))[0])


def lower(text: str | None) -> bytes:
    return as_bytes(text).lower()


def pieces(texts: list, size: int) -> Iterator[slice]:
    """Slices of about ``size`` characters, to work on."""
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total > size:
            yield slice(lo, i + 1)
            lo, total = i + 1, 0
    if lo < len(texts):
        yield slice(lo, len(texts))


def token_counts(docs: DataFrame) -> DataFrame:
    """``(word, c)`` over all texts of ``docs(train, text)``: c counts training texts only and
    is 0 for tokens met elsewhere."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            flags, texts = np.array(b.column(0).to_pylist(), dtype=np.int64), b.column(1).to_pylist()
            for part in pieces(texts, 2_000_000):
                low = [lower(t) for t in texts[part]]
                data = b"\n".join(low)
                h, start, stop = hasher.spans(data)
                owner = np.searchsorted(np.cumsum([len(t) + 1 for t in low]), start, side="right")
                order = np.argsort(h)
                s = h[order]
                new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, int)
                sums = np.add.reduceat(flags[part][owner][order], new) if len(new) else np.zeros(0, np.int64)
                at = order[new]
                words = [data[x:y] for x, y in zip(start[at].tolist(), stop[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(sums, pa.int64())], names=["word", "c"])

    return docs.select("train", "text").mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def train_trie(counts: DataFrame, ends: int, max_order: int, min_share: float = 0.0) -> Trie:
    """The context trie of the tokens with ``c > 0``, in one place; ``ends`` training texts end.
    ``lm_score`` asks for orders up to ``LOW_ORDER`` whole; pairs below ``min_share`` of the
    training bytes can be left to the escape."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, c = b.column(0).to_pylist(), b.column(1).to_numpy()
            for lo in range(0, len(words), 50_000):
                owner, byte, depth, keys = contexts(words[lo : lo + 50_000], max_order)
                weight = c[lo : lo + 50_000][owner]
                for k in range(max_order + 1):
                    ok = depth >= k
                    # a context has at most 48 bits below its order, so byte and context sort as one
                    pair = (keys[k][ok] << np.uint64(8)) | byte[ok].astype(np.uint64)
                    order = np.argsort(pair)
                    pair, w = pair[order], weight[ok][order]
                    new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(w) else np.zeros(0, int)
                    sums = np.add.reduceat(w, new) if len(new) else np.zeros(0, np.int64)
                    pair = pair[new]
                    ctx = ((pair >> np.uint64(8)) & np.uint64((1 << 48) - 1)) | np.uint64(k << 56)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ctx.astype(np.int64)), pa.array((pair & np.uint64(255)).astype(np.int32)), pa.array(sums.astype(np.int64))],
                        names=["ctx", "sym", "c"],
                    )

    spark = counts.sparkSession
    # a few large tasks: byte contexts are few, and repeat from task to task
    few = max(1, counts.rdd.getNumPartitions() // 4)
    pairs = counts.where("c > 0").coalesce(few).mapInArrow(count, "ctx bigint, sym int, c bigint")
    if ends:
        rows = [(0, END, ends)] + ([((1 << 56) | SPACE, END, ends)] if max_order else [])
        pairs = pairs.unionByName(spark.createDataFrame(rows, "ctx bigint, sym int, c bigint"))
    pairs = pairs.groupBy("ctx", "sym").agg(F.sum("c").alias("c"))
    nodes = pairs.groupBy("ctx").agg(F.sum("c").alias("total"), F.sort_array(F.collect_list(F.struct("sym", "c"))).alias("next"))
    nodes = cut_lineage(nodes)
    n_bytes = nodes.where("ctx = 0").agg(F.max("total")).first()[0] or 0
    floor = min_share * n_bytes
    kept = nodes.withColumn("next", F.filter("next", lambda x: x["c"] >= floor)).where(F.size("next") > 0)
    got = kept.select("ctx", "total", F.col("next.sym").alias("syms"), F.col("next.c").alias("counts")).toArrow()
    syms = [bytes(x) for x in got["syms"].to_pylist()]
    counts_ = [np.array(x, dtype=np.int64) for x in got["counts"].to_pylist()]
    keys = np.array(got["ctx"].to_pylist(), dtype=np.int64).astype(np.uint64)
    return Trie.build(keys, np.array(got["total"].to_pylist(), dtype=np.int64), syms, counts_, max_order)


def pack_text(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True) if data else b""


def unpack_text(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True) if data else b""


def pack_keys(keys: np.ndarray) -> bytes:
    """A sorted run of hashes (``KEY_BITS``): the first, then differences, whose top byte says little."""
    gaps = np.diff(keys >> np.uint64(8)).astype("<u8")
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    places = gaps.view(np.uint8).reshape(-1, 8)
    top = zlib.compress(places[:, width - 1].tobytes(), 1)
    return bytes([width]) + len(top).to_bytes(8, "little") + keys[:1].astype("<u8").tobytes() + top + places[:, : width - 1].tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    top = np.frombuffer(zlib.decompress(data[17 : 17 + n]), dtype=np.uint8)
    gaps = np.zeros((len(top), 8), dtype=np.uint8)
    gaps[:, width - 1] = top
    gaps[:, : width - 1] = np.frombuffer(data, dtype=np.uint8, offset=17 + n).reshape(len(top), width - 1)
    first = np.frombuffer(data, dtype="<u8", count=1, offset=9)
    return np.cumsum(np.concatenate([first >> np.uint64(8), gaps.view("<u8").ravel()]), dtype=np.uint64) << np.uint64(8)


def pack_numbers(x: np.ndarray) -> bytes:
    """Integers, mostly small, byte place by byte place, as many as the largest needs."""
    x = np.ascontiguousarray(x, dtype="<i8")
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    width = 8 if low < 0 else max(1, (high.bit_length() + 7) // 8)
    places = x.astype(np.uint8) if width == 1 else x.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zlib.compress(places.tobytes(), 1)


def unpack_numbers(data: bytes) -> np.ndarray:
    places = np.frombuffer(zlib.decompress(data[1:]), dtype=np.uint8)
    if data[0] == 1:
        return places.astype(np.int64)
    out = np.zeros((len(places) // data[0], 8), dtype=np.uint8)
    out[:, : data[0]] = places.reshape(data[0], -1).T
    return out.view("<i8").ravel()


def pack_logs(x: np.ndarray) -> bytes:
    """Code lengths, nothing rounded: sign, exponent and first bits say little and are compressed."""
    places = np.ascontiguousarray(x, dtype="<f8").view(np.uint8).reshape(-1, 8)
    top = zlib.compress(places[:, 6:].T.tobytes(), 1)
    return len(top).to_bytes(8, "little") + top + places[:, :6].tobytes()


def unpack_logs(data: bytes) -> np.ndarray:
    n = 8 + int.from_bytes(data[:8], "little")
    top = np.frombuffer(zlib.decompress(data[8:n]), dtype=np.uint8).reshape(2, -1)
    places = np.empty((top.shape[1], 8), dtype=np.uint8)
    places[:, 6:] = top.T
    places[:, :6] = np.frombuffer(data, dtype=np.uint8, offset=n).reshape(-1, 6)
    return places.view("<f8").ravel()


def word_chunks(counts: DataFrame) -> DataFrame:
    """The distinct tokens in chunks, ``(chunk, words, c, n, known, coded)``: words and their counts
    packed, the sum of the counts, how many are above 0, and the bytes that are coded."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, words, c = TaskContext.get().partitionId() << 32, [], []

        def row(words: list[bytes], c: list[int]) -> pa.RecordBatch:
            order = sorted(range(len(words)), key=words.__getitem__)
            data, numbers = b"\n".join(words[i] for i in order), np.array(c, dtype=np.int64)[order]
            sums = [int(numbers.sum()), int((numbers > 0).sum()), len(data) + 1]
            columns = [[seq], [zlib.compress(data, 1)], [pack_numbers(numbers)], *[[x] for x in sums]]
            types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["chunk", "words", "c", "n", "known", "coded"])

        for b in batches:
            words += b.column(0).to_pylist()
            c += b.column(1).to_pylist()
            while len(words) >= CHUNK_WORDS:
                yield row(words[:CHUNK_WORDS], c[:CHUNK_WORDS])
                words, c, seq = words[CHUNK_WORDS:], c[CHUNK_WORDS:], seq + 1
        if words:
            yield row(words, c)

    return counts.mapInArrow(pack, "chunk bigint, words binary, c binary, n bigint, known bigint, coded bigint")


def unpack_words(words: bytes, c: bytes) -> tuple[list[bytes], np.ndarray]:
    return zlib.decompress(words).split(b"\n"), unpack_numbers(c)


def words_of(chunks: DataFrame) -> DataFrame:
    """``(word, c)`` again."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words, numbers = unpack_words(data, c)
                for lo in range(0, len(words), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(words[lo : lo + 50_000], pa.binary()), pa.array(numbers[lo : lo + 50_000])], names=["word", "c"])

    return chunks.select("words", "c").mapInArrow(unpack, "word binary, c bigint")


def longest_pairs(words: list[bytes], max_order: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (longest context, byte) pairs of the words, packed, in order of the part that
    counts them; those parts; and for every coded byte its word's number and its pair's place."""
    owners, keys = [], []
    for lo in range(0, len(words), 50_000):
        owner, byte, depth, ctx = contexts(words[lo : lo + 50_000], max_order)
        last = np.choose(np.minimum(depth, max_order), ctx)
        owners.append(owner + lo)
        keys.append((last & ORDER_BITS) | ((last & LOW48) << np.uint64(8)) | byte.astype(np.uint64))
    pairs, place = np.unique(np.concatenate(keys), return_inverse=True)
    part = (mix((pairs >> np.uint64(8)) & np.uint64(0xFFFFFF)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    moved = np.empty(len(order), dtype=np.int64)
    moved[order] = np.arange(len(order))
    return pairs[order], part[order], np.concatenate(owners), moved[place]


def cut_at(labels: np.ndarray) -> list[tuple[int, int]]:
    """Where each stretch of equal labels begins and ends."""
    cuts = [*np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1]])).tolist(), len(labels)] if len(labels) else []
    return list(zip(cuts, cuts[1:]))


def coded_words(chunks: DataFrame, low: Trie, max_order: int, parts: int, bits: int) -> DataFrame:
    """Counts and code lengths of all tokens, by hash range (rows of ``ASKS`` with block -1)."""
    spark = chunks.sparkSession
    sent, low_order = spark.sparkContext.broadcast(low.arrays), low.max_order

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, data, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words, numbers = unpack_words(data, c)
                pairs, part, owner, place = longest_pairs(words, max_order, parts)
                sums = np.bincount(place, weights=numbers[owner], minlength=len(pairs))
                cuts = cut_at(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(part[x]) for x, _ in cuts], pa.int64()),
                        pa.array([chunk] * len(cuts), pa.int64()),
                        pa.array([pack_run(pairs[x:y]) for x, y in cuts], pa.binary()),
                        pa.array([pack_numbers(sums[x:y]) for x, y in cuts], pa.binary()),
                    ],
                    ["part", "chunk", "pairs", "c"],
                )

    def code(rows: pa.Table) -> pa.Table:
        runs = [unpack_run(x) for x in rows["pairs"].to_pylist()]
        pairs, place = np.unique(np.concatenate(runs), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([unpack_numbers(x) for x in rows["c"].to_pylist()]))
        logp = Trie(low_order, sent.value).with_longer(pairs, counts, max_order).pairs(pairs)[place]
        ends = np.cumsum([len(x) for x in runs])
        return pa.table({"part": rows["part"], "chunk": rows["chunk"], "logp": pa.array([pack_logs(logp[e - len(x) : e]) for e, x in zip(ends.tolist(), runs, strict=True)], pa.binary())})

    def join(words: pa.Table, answers: pa.Table) -> pa.Table:
        words, numbers = unpack_words(words["words"][0].as_py(), words["c"][0].as_py())
        pairs, _, owner, place = longest_pairs(words, max_order, parts)
        logp = np.concatenate([np.zeros(0), *map(unpack_logs, answers.sort_by("part")["logp"].to_pylist())])
        total = np.bincount(owner, weights=logp[place], minlength=len(words))
        h = WordHasher()(b"\n".join(words)) & KEY_BITS
        order = np.argsort(h)
        return ask_rows(-1, TOKEN, h[order], bits, numbers[order], total[order])

    asked = chunks.select("chunk", "words", "c").mapInArrow(ask, "part bigint, chunk bigint, pairs binary, c binary")
    answers = asked.groupBy("part").applyInArrow(code, "part bigint, chunk bigint, logp binary")
    return chunks.select("chunk", "words", "c").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(join, ASKS)


ASKS = "block int, kind int, range int, keys binary, numbers binary, logs binary"
ANSWERS = "block int, kind int, range int, numbers binary, logs binary"


def ask_rows(block: int, kind: int, keys: np.ndarray, bits: int, numbers: np.ndarray, logs: np.ndarray | None = None) -> pa.Table:
    """Sorted keys in packed runs by their leading ``bits``, with (rows of) numbers for each."""
    ranges = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = cut_at(ranges)
    return pa.table(
        {
            "block": pa.array([block] * len(cuts), pa.int32()),
            "kind": pa.array([kind] * len(cuts), pa.int32()),
            "range": pa.array([int(ranges[x]) for x, _ in cuts], pa.int32()),
            "keys": pa.array([pack_keys(keys[x:y]) for x, y in cuts], pa.binary()),
            "numbers": pa.array([pack_numbers(numbers[..., x:y].ravel()) for x, y in cuts], pa.binary()),
            "logs": pa.array([None if logs is None else pack_logs(logs[x:y]) for x, y in cuts], pa.binary()),
        }
    )


def answer(rows: pa.Table) -> pa.Table:
    """What the blocks asked of one range, in the order of their runs: a token's count and code
    length; of contexts, and of contexts with a token, the sums of what the blocks sent."""
    blocks, kind = rows["block"].to_pylist(), rows["kind"][0].as_py()
    runs, numbers = [unpack_keys(x) for x in rows["keys"].to_pylist()], [unpack_numbers(x) for x in rows["numbers"].to_pylist()]
    if kind == TOKEN:
        known = [i for i, b in enumerate(blocks) if b < 0]
        table = np.concatenate([runs[i] for i in known])
        order = np.argsort(table)
        table, c = table[order], np.concatenate([numbers[i] for i in known])[order]
        logp = np.concatenate([unpack_logs(rows["logs"][i].as_py()) for i in known])[order]
        asking = [i for i, b in enumerate(blocks) if b >= 0]
        at = [np.searchsorted(table, runs[i]) for i in asking]
        sums, logs = [c[x] for x in at], [pack_logs(logp[x]) for x in at]
    else:
        asking = range(len(blocks))
        keys, place = np.unique(np.concatenate(runs), return_inverse=True)
        parts = zip(*(x.reshape(-1, len(r)) for x, r in zip(numbers, runs, strict=True)), strict=True)
        total = [np.bincount(place, weights=np.concatenate(x), minlength=len(keys))[place] for x in parts]
        ends = np.cumsum([len(x) for x in runs]).tolist()
        sums = [np.concatenate([t[e - len(x) : e] for t in total]) for e, x in zip(ends, runs, strict=True)]
        logs = [None] * len(blocks)
    return pa.table(
        {
            "block": pa.array([blocks[i] for i in asking], pa.int32()),
            "kind": pa.array([kind] * len(asking), pa.int32()),
            "range": pa.array([rows["range"][0].as_py()] * len(asking), pa.int32()),
            "numbers": pa.array([pack_numbers(x) for x in sums], pa.binary()),
            "logs": pa.array(logs, pa.binary()),
        }
    )


def answered(rows: pa.Table, kind: int, columns: int) -> np.ndarray:
    """The numbers that a block was told about its sorted distinct keys of one kind."""
    mine = rows.filter(pa.compute.equal(rows["kind"], kind)).sort_by("range")
    parts = [unpack_numbers(x).reshape(columns, -1) for x in mine["numbers"].to_pylist()]
    return np.concatenate(parts, axis=1) if parts else np.zeros((columns, 0), dtype=np.int64)


def block_table(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """``docs(id, text, train)`` with ``block``, shuffled by it, and the number of blocks; texts are
    lower-cased and packed (``pack_text``)."""

    def key_of(texts: list, hasher: WordHasher) -> np.ndarray:
        """Each text's smallest hash of five words (of all, if fewer; 0: none)."""
        out = np.zeros(len(texts), dtype=np.uint64)
        for part in pieces(texts, 2_000_000):
            h, n = hasher.many([lower(t) for t in texts[part]])
            some = np.flatnonzero(n)
            if not len(some):
                continue
            left = np.repeat(np.cumsum(n), n) - np.arange(len(h))  # words from here to the end of the text
            first = (np.cumsum(n) - n)[some]
            key = h.copy()
            for k in range(1, 5):
                key[:-k] = np.where(left[:-k] > k, mix(key[:-k] + h[k:] * np.uint64(2 * k + 1)), key[:-k])
            short = left < 5
            short[first] = False
            key[short] = ~np.uint64(0)
            out[part][some] = np.minimum.reduceat(key, first)
        return out.view(np.int64)

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            texts = b.column(0).to_pylist()
            n = [len(as_bytes(t)) + 100 for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(key_of(texts, hasher)), pa.array(n, pa.int64())], names=["key", "n"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = b.column(at).to_pylist()
            packed = pa.array([pack_text(lower(t)) for t in texts], pa.binary())
            yield b.set_column(at, "text", packed).append_column("key", pa.array(key_of(texts, hasher)))

    groups = cut_lineage(docs.select("text").mapInArrow(sized, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")))
    total = groups.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    heavy = groups.where(F.col("n") > block_bytes).select("key", F.ceil(F.col("n") / block_bytes).alias("spread"))
    if heavy.count() <= BROADCAST_ROWS:
        heavy = F.broadcast(heavy)
    kind = docs.schema["id"].dataType.simpleString()
    marked = docs.mapInArrow(keyed, f"id {kind}, text binary, train boolean, key bigint").join(heavy, "key", "left")
    salt = F.pmod(F.xxhash64("id", "text"), F.coalesce("spread", F.lit(1)))
    block = F.pmod(F.xxhash64("key", salt), F.lit(blocks)).cast("int")
    return marked.select("id", "text", "train", block.alias("block")).repartition(max(blocks, shuffle_partitions(docs.sparkSession)), "block"), blocks


class Lookup:
    """Places of 64-bit hashes in a sorted table, by their top bits and a short scan."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.shift = np.uint64(64 - max(1, len(table).bit_length()))
        slots = 1 << int(64 - self.shift)
        self.start = np.searchsorted(table >> self.shift, np.arange(slots, dtype=np.uint64)).astype(np.int32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Each hash must be in the table."""
        at = self.start[(h >> self.shift).astype(np.int64)]
        left = np.flatnonzero(self.table[at] != h)
        while len(left):
            at[left] += 1
            left = left[self.table[at[left]] != h[left]]
        return at


def other_counts(keys: np.ndarray, doc: np.ndarray, train: np.ndarray) -> np.ndarray:
    """For each position, how often its key occurs in training texts of other documents."""
    out = np.zeros(len(keys), dtype=np.int32)
    some = np.arange(len(keys), dtype=np.int32)
    for shift in (0, 23):  # most keys occur once: a small table rules them out before sorting
        slot = ((keys[some] >> np.uint64(shift)) & np.uint64((1 << 22) - 1)).astype(np.int32)
        some = some[np.bincount(slot, minlength=1 << 22)[slot] > 1]
    if not len(some):
        return out
    order = some[np.argsort(keys[some], kind="stable")]  # positions, and so documents, stay in order
    k, d, t = keys[order], doc[order], train[order].astype(np.int32)
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    new_doc = new_key | np.concatenate([[True], d[1:] != d[:-1]])
    all_, own = (np.add.reduceat(t, np.flatnonzero(x))[np.cumsum(x) - 1] for x in (new_key, new_doc))
    out[order] = all_ - own
    return out


def context_keys(words: np.ndarray, doc: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The positions that have ``order`` tokens before them in their document, hashes of those
    tokens, and hashes of them with the token that follows."""
    if not order or len(words) <= order:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    ctx = np.zeros(len(words), dtype=np.uint64)
    inside = np.ones(len(words), dtype=bool)
    for k in range(1, order + 1):
        ctx[k:] = mix(ctx[k:] + words[:-k] * np.uint64(2 * k + 1))
        inside[:k] = False
        inside[k:] &= doc[k:] == doc[:-k]
    at = np.flatnonzero(inside).astype(np.int32)
    return at, ctx[at], mix(ctx[at] + words[at] * np.uint64(31))


def sorted_distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in order, by sorting alone, many times faster here than ``np.unique``."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes in order, and each one's place among them."""
    table = sorted_distinct(keys)
    return table, Lookup(table)(keys).astype(np.int64) if len(keys) else np.zeros(0, dtype=np.int64)


def ranked(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position its hash's place among the distinct ones, and how often its document has it."""
    table, place = distinct(keys)
    own = np.ones(len(keys), dtype=np.int64)
    some = np.flatnonzero(np.bincount(place, minlength=len(table))[place] > 1)
    if len(some):
        _, back, n = np.unique(place[some] * (int(doc.max()) + 1) + doc[some], return_inverse=True, return_counts=True)
        own[some] = n[back]
    return place, own


def with_token_contexts(words: np.ndarray, doc: np.ndarray, train: np.ndarray, logp: np.ndarray, order: int) -> np.ndarray:
    """``logp`` of each token after trying the ``order`` tokens before it, all documents at hand;
    works in place.  ``lm_score`` does the same with counts joined from all documents."""
    at, ctx, pair = context_keys(words, doc, order)
    d, t = doc[at], train[at]
    total, same = other_counts(ctx, d, t), other_counts(pair, d, t)
    at, t, total, same = (x[total > 0] for x in (at, t, total, same))
    rate = np.minimum(total, RATES)
    for k in range(1, RATES + 1):
        own = rate == k
        learn = own & t
        stays = ((same[learn] > 0).sum() + 1) / (learn.sum() + 2)
        hit, miss = at[own & (same > 0)], at[own & (same == 0)]
        logp[hit] = np.log10(stays * same[own & (same > 0)] / total[own & (same > 0)])
        logp[miss] += np.log10(1 - stays)
    return logp


def text_tokens(texts: list, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of the texts in a row, each text closed by ``END_HASH``; the number of each
    one's text; and how many each text has before the end."""
    h, n = hasher.many([t if isinstance(t, bytes) else lower(t) for t in texts])
    doc = np.repeat(np.arange(len(n), dtype=np.int32), n + 1)
    words = np.full(len(doc), END_HASH)
    inner = np.ones(len(doc), dtype=bool)
    inner[np.cumsum(n + 1) - 1] = False
    words[inner] = h
    return words, doc, n


def lm_score(
    docs: DataFrame,
    train: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_order: int = 6,
    token_order: int = 3,
    block_bytes: int = 4_000_000,
) -> DataFrame:
    """One row per document: ``(<id_col>, n_tokens, n_known, train_tokens, base_score, score)``.

    ``score`` is the log10 probability of the whole text (its tokens, then the end) under the
    PPM model; ``base_score`` the one of a unigram model with add-one smoothing; both learn
    from the rows where ``train`` holds (default: all; null is no).  A null text counts as
    empty: one end token.  With nothing to learn from, bytes are uniform.  Repeated rows are
    each scored and each counted in training; an empty table gives an empty result; columns
    not named are not read.  Orders over 6 do not fit the packed context.
    """
    if not 0 <= max_order <= 6:
        raise ValueError("max_order must be 0 .. 6")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    flag = F.lit(True) if train is None else F.coalesce(train, F.lit(False))
    flat = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), flag.alias("train"))
    chunks = cut_lineage(word_chunks(token_counts(flat)))
    ends = flat.where("train").count()
    seen = chunks.agg(F.sum("n").alias("n"), F.sum("known").alias("v"), F.sum("coded").alias("b")).first()
    n_train, vocab = (seen.n or 0) + ends, (seen.v or 0) + (1 if ends else 0)
    low = train_trie(words_of(chunks), ends, min(LOW_ORDER, max_order))
    end_log, denominator = low.end(), float(n_train + vocab + 1)
    blocks, n_blocks = block_table(flat, block_bytes)
    bits = max(1, (2 * n_blocks - 1).bit_length())
    parts = max(shuffle_partitions(spark), -(-(seen.b or 0) // PART_PAIRS))
    coded = coded_words(chunks, low, max_order, parts, bits)

    def contexts_of(texts: pa.Table):
        """Tokens, their documents, tokens a document; positions with a context, these contexts, them
        with the next token, their documents, and whether each is trained on."""
        words, doc, n = text_tokens([unpack_text(t) for t in texts["text"].to_pylist()], WordHasher())
        words &= KEY_BITS
        at, ctx, pair = context_keys(words, doc, token_order)
        ctx, pair = ctx & KEY_BITS, pair & KEY_BITS
        return words, doc, n, at, ctx, pair, doc[at], np.array(texts["train"].to_pylist(), dtype=bool)[doc[at]]

    def ask(texts: pa.Table) -> pa.Table:
        words, _, _, _, ctx, _, _, trained = contexts_of(texts)
        block = texts["block"][0].as_py()
        tokens_ = sorted_distinct(words[words != END_KEY])
        asked = [ask_rows(block, TOKEN, tokens_, bits, np.zeros((0, len(tokens_))))]
        keys, place = distinct(ctx)
        if len(keys):
            sums = np.stack([np.bincount(place[x], minlength=len(keys)) for x in (trained, ~trained)])
            asked.append(ask_rows(block, CONTEXT, keys, bits, sums))
        return pa.concat_tables(asked)

    def ask_pairs(texts: pa.Table, answers: pa.Table) -> pa.Table:
        _, _, _, _, ctx, pair, d, trained = contexts_of(texts)
        place, own = ranked(ctx, d)
        shared = answered(answers, CONTEXT, 2).sum(axis=0)[place] > own  # another document has the context too
        keys, place = distinct(pair[shared])
        return ask_rows(texts["block"][0].as_py(), PAIR, keys, bits, np.bincount(place[trained[shared]], minlength=len(keys)))

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        words, doc, n, at, ctx, pair, d, trained = contexts_of(texts)
        mine = answers.filter(pa.compute.equal(answers["kind"], TOKEN)).sort_by("range")
        known = [unpack_numbers(x) for x in mine["numbers"].to_pylist()] + [np.array([ends])]
        coded_ = [unpack_logs(x) for x in mine["logs"].to_pylist()] + [np.array([end_log])]
        table = np.append(sorted_distinct(words[words != END_KEY]), END_KEY)
        order = np.argsort(table, kind="stable")
        table, c, logp = table[order], np.concatenate(known)[order], np.concatenate(coded_)[order]
        base = np.log10((c + 1.0) / denominator)
        slot = Lookup(table)(words)
        total = lambda x: np.bincount(doc, weights=x, minlength=len(n))
        known, base_score = total(c[slot] > 0), total(base[slot])
        scores = logp[slot]
        del slot
        place, own = ranked(ctx, d)
        sums = answered(answers, CONTEXT, 2)
        seen, shared = sums[0][place] - own * trained, sums.sum(axis=0)[place] > own
        at, pair, d, trained, seen = (x[shared] for x in (at, pair, d, trained, seen))
        del ctx, sums, shared
        place, own = ranked(pair, d)
        same = answered(answers, PAIR, 1)[0][place] - own * trained
        at, d, seen, same = (x[seen > 0] for x in (at, d, seen, same))
        hit = same > 0
        scores[at[hit]] = np.log10(same[hit] / seen[hit])
        # how often contexts stay is known once all blocks are through: numbers by rate
        slot = d * RATES + np.minimum(seen, RATES) - 1
        hits, misses = (np.bincount(slot[x], minlength=len(n) * RATES).reshape(-1, RATES).tolist() for x in (hit, ~hit))
        return pa.table(
            {
                "id": texts["id"],
                "n_tokens": pa.array(n + 1, pa.int64()),
                "n_known": pa.array(known.astype(np.int64)),
                "train_tokens": pa.array(np.full(len(n), n_train), pa.int64()),
                "base_score": pa.array(base_score),
                "rest": pa.array(total(scores)),
                "train": texts["train"],
                "hits": pa.array(hits, pa.list_(pa.int64())),
                "misses": pa.array(misses, pa.list_(pa.int64())),
            }
        )

    by_block = blocks.groupBy("block")
    asked = by_block.applyInArrow(ask, ASKS).unionByName(coded)
    told = asked.groupBy("kind", "range").applyInArrow(answer, ANSWERS)
    if token_order:
        first = told.where(F.col("kind") == CONTEXT)
        pairs = by_block.cogroup(first.groupBy("block")).applyInArrow(ask_pairs, ASKS)
        told = told.unionByName(pairs.groupBy("kind", "range").applyInArrow(answer, ANSWERS))
    schema = f"id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, rest double, train boolean, hits array<bigint>, misses array<bigint>"
    scored = cut_lineage(by_block.cogroup(told.groupBy("block")).applyInArrow(score, schema))
    names = [(x, k, f"{x}{k}") for x in ("hits", "misses") for k in range(RATES)]
    sums = scored.where("train").agg(*[F.sum(F.col(x)[k]).alias(name) for x, k, name in names]).first()
    total_score = F.col("rest")
    for k in range(RATES):
        hits, misses = sums[f"hits{k}"] or 0, sums[f"misses{k}"] or 0
        stays = (hits + 1) / (hits + misses + 2)
        total_score = total_score + F.col("hits")[k] * float(np.log10(stays)) + F.col("misses")[k] * float(np.log10(1 - stays))
    return scored.select(F.col("id").alias(id_col), "n_tokens", "n_known", "train_tokens", "base_score", total_score.alias("score"))
