"""Packing documents into fixed-length sequences by lexical retrieval.

Texts become token ids.  Document frequencies, the number of documents and their mean length
are counted once, over all documents.  Documents are dealt into shards of about ``shard_chars``
bytes by similarity (``Dealer``): random projections of their BM25 weights are clustered, and
clusters that resemble each other fill neighbouring shards; a group of documents too alike to
tell apart is spread by row number.  A shard builds a BM25 inverted index over token ids
(postings sorted by term, each posting's weight precomputed from the corpus-wide counts), and
packs:

* the next unused document opens a window; if it is longer than the room left it is cut and
  goes on in the following windows;
* while there is room, the unused documents nearest to the seed by BM25 (the query is all the
  seed's terms; ties by position) are appended, cut where the
  window ends; the rest of a cut document opens the next window and is its seed;
* a seed without unused neighbours is followed by the next unused document.

So every window but a shard's last is full.  The last one is cut into sequences whose
lengths are the powers of two that add up to it, which need no padding.  Shards are
independent, bounded by their bytes, and their number grows with the corpus; sequence numbers
are ``shard * 2^32 + n``.  A seed meets the documents of its shard only: dealing by similarity
brings its neighbours there, but one that falls just across a border is not found.
"""

from __future__ import annotations

import re
import sys
import types
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundeval.llm.common import WordTable, as_bytes, cut_lineage, mix

#: A run of these after a word is a pre-token of its own.
MARKS = ".,;:!?#$%&*()-+=/|~"
IS_MARK, IS_LETTER, IS_SPACE = np.zeros((3, 256), dtype=bool)  # by byte; letters here are those of ASCII
IS_MARK[list(MARKS.encode())], IS_SPACE[[32, *range(9, 14)]] = True, True
IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: By the two bytes of a character: precomposed Latin letters, U+00C0 to U+017F, but the dotted capital I.
IS_LATIN = np.zeros(1 << 16, dtype=bool)
IS_LATIN[[int.from_bytes(chr(c).encode(), "big") for c in range(0xC0, 0x180) if c not in (0xD7, 0xF7, 0x130)]] = True
SPACE = re.compile(rb"[ \t-\r]")
PIECE, STEMS = 1 << 22, 600_000  # bytes of text that are encoded at a time; stems a task remembers
K1, B = 1.2, 0.75
#: Numbers a document's BM25 weights are projected to, and how many of them a term is added to
#: (a sparse random projection); most clusters (above, they are split by ``SLOTS`` ranges of one
#: more projection each); documents a cluster is learned from.
DIMS, SPREAD, MAX_CELLS, SLOTS, PER_CELL = 128, 8, 4096, 64, 32
DENSE = 1 << 23  # weights of common terms that an index holds as a matrix


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others are numbered from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def id_width(tokenizer_file: str, end_id: int) -> str:
    """The narrowest unsigned integers that hold all ids of a tokenizer: 16 or 32 bits."""
    from tokenizers import Tokenizer

    top = max([end_id, *Tokenizer.from_file(tokenizer_file).get_vocab(with_added_tokens=True).values()])
    return "<u2" if top < 1 << 16 else "<u4"


def binary_rows(raw: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Bytes in a row as an array of values so many bytes long."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def letters(raw: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The bytes that belong to letters which the tokenizer's normaliser and pre-tokeniser leave
    alone but for case, in UTF-8 words that begin at ``first``."""
    out = IS_LETTER[raw]
    lead = np.flatnonzero(IS_LATIN[(raw[:-1].astype(np.uint16) << 8) | raw[1:]])
    opens = np.zeros(len(raw), dtype=bool)
    opens[first] = True
    lead = lead[~opens[lead + 1]]
    out[lead], out[lead + 1] = True, True
    return out


def distinct(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct values, and the number of each row's value among them."""
    coded = values.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def gather(flat: np.ndarray, length: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The entries ``which``, in a row, of a list of entries so long that lie in ``flat``."""
    start, n = np.cumsum(length) - length, length[which]
    ends = np.cumsum(n)
    return flat[np.repeat(start[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Token ids of texts with ``tokenizer_file``, as little-endian unsigned integers of type ``width``.

    The tokenizer drops white space and never joins across it, so a text's ids are its
    words' ids in a row.  Texts go through in pieces of a few megabytes: a piece's distinct
    words are found and taken apart as arrays, and only their distinct stems, lower-cased,
    are encoded one by one, once per task.  ``word_level=False`` encodes whole texts instead,
    for vocabularies that do not drop white space."""

    def __init__(self, tokenizer_file: str, word_level: bool = True, width: str = "<u4"):
        from tokenizers import Tokenizer

        self.width, self.code = width, {"<u2": "H", "<u4": "I"}[width]

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.model, self.symbols = self.tokenizer.model, byte_symbols()
        self.word_level = word_level
        self.marks = WordTable(self._full, 10_000)
        self.stems: dict[str, bytes] = {}
        self.words = WordTable(self._word, 100_000)  # those that are not letters and marks

    def _full(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.width).tobytes()

    def _word(self, word: bytes) -> bytes:
        return self._full(word.decode("utf-8", "replace"))

    def _stem(self, stem: str) -> bytes:
        inner = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.symbols)
        return array(self.code, [t.id for t in self.model.tokenize(inner)]).tobytes()

    def _stems(self, stems: list[str]) -> list[bytes]:
        """Ids of distinct stems; those met for the first time are encoded together."""
        ids = list(map(self.stems.get, stems))
        new = [i for i, x in enumerate(ids) if x is None]
        for i in new:
            ids[i] = self._stem(stems[i])
        if len(self.stems) + len(new) > STEMS:
            self.stems = dict(zip(stems, ids, strict=True))
        else:
            self.stems.update((stems[i], ids[i]) for i in new)
        return ids

    def _vocabulary(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (none empty), in a row, and how many each has."""
        cut = np.frombuffer(words.buffers()[1], dtype=np.int32, count=len(words) + 1)
        raw = np.frombuffer(words.buffers()[2], dtype=np.uint8, count=cut[-1])
        at = np.arange(len(raw), dtype=np.int32)
        stop = np.maximum(np.maximum.reduceat(np.where(IS_MARK[raw], np.int32(-1), at), cut[:-1]) + 1, cut[:-1])
        odd = np.concatenate([[0], np.cumsum(~letters(raw, cut[:-1]))])
        plain = (odd[stop] == odd[cut[:-1]]) & (stop > cut[:-1])
        sizes = np.diff(cut)
        inside, used = at < np.repeat(stop, sizes), np.repeat(plain, sizes)
        stems, stem = distinct(pc.utf8_lower(binary_rows(raw[inside & used], (stop - cut[:-1])[plain], pa.string())))
        marks, mark = distinct(binary_rows(raw[~inside & used], (cut[1:] - stop)[plain], pa.string()))
        others = words.filter(pa.array(~plain))
        ids = [b"", *self._stems(stems.to_numpy(zero_copy_only=False).tolist())]
        for table, keys in ((self.marks, marks), (self.words, others)):
            ids.extend(map(table.__getitem__, keys.to_numpy(zero_copy_only=False).tolist()))
        length = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // np.dtype(self.width).itemsize
        halves = np.zeros((len(words), 2), dtype=np.int64)  # entries of ids that make each word
        halves[plain, 0], halves[plain, 1] = stem + 1, mark + (1 + len(stems))
        halves[~plain, 0] = np.arange(len(others)) + (1 + len(stems) + len(marks))
        return gather(np.frombuffer(b"".join(ids), dtype=self.width), length, halves.ravel()), length[halves].sum(axis=1)

    def _piece(self, texts: list[bytes]) -> list[bytes]:
        raw = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        space = IS_SPACE[raw]
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            return [b""] * len(texts)
        words, word = distinct(binary_rows(raw[~space], end - start, pa.binary()))
        flat, length = self._vocabulary(words)
        first = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in texts]))
        cuts = np.concatenate([[0], np.cumsum(length[word])])[first] * np.dtype(self.width).itemsize
        ids = gather(flat, length, word).tobytes()
        return [ids[a:z] for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _long(self, data: bytes) -> bytes:
        """A text in pieces cut at white space."""
        out, at = [], 0
        while at < len(data):
            space = SPACE.search(data, at + PIECE)
            end = space.end() if space else len(data)
            out += self._piece([data[at:end]])
            at = end
        return b"".join(out)

    def encode(self, text: str | bytes | None) -> bytes:
        """The ids of a text, given as such or in UTF-8."""
        return next(self.encode_all([text if isinstance(text, bytes) else as_bytes(text)]))

    def encode_all(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text, given in UTF-8."""
        if not self.word_level:
            yield from (self._full(t.decode("utf-8", "replace")) for t in texts)
            return
        held, size = [], 0
        for t in texts:
            if size + len(t) > PIECE and held:
                yield from self._piece(held)
                held, size = [], 0
            if len(t) > PIECE:
                yield self._long(t)
            else:
                held.append(t)
                size += len(t)
        if held:
            yield from self._piece(held)


def worker_encoder(tokenizer_file: str, word_level: bool, width: str) -> Encoder:
    """One encoder for all tasks of a Python worker, so that a word met in one shard need not
    be encoded again in the next; its table is bounded.  Functions are sent to workers by
    value, so the worker-wide place is a module made there."""
    shared = sys.modules.setdefault("groundeval_worker_encoders", types.ModuleType("groundeval_worker_encoders"))
    key = f"{tokenizer_file}|{word_level}|{width}"
    if not hasattr(shared, key):
        setattr(shared, key, Encoder(tokenizer_file, word_level, width))
    return getattr(shared, key)


class Stats(NamedTuple):
    """Counts over all documents: their number, mean length and each term's documents."""

    n: int
    mean: float
    df: np.ndarray

    def idf(self) -> np.ndarray:
        return np.log(1.0 + (self.n - self.df + 0.5) / (self.df + 0.5)).astype(np.float32)


def term_counts(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, term, tf)`` of all documents' distinct terms, by document and term."""
    lens = [len(d) for d in docs]
    flat = np.repeat(np.arange(len(docs), dtype=np.int64), lens) << 32 | np.concatenate(docs) if docs else np.zeros(0, np.int64)
    pair, tf = np.unique(flat, return_counts=True)
    return (pair >> 32).astype(np.int32), pair & 0xFFFFFFFF, tf


def id_batches(blobs: pa.Array, width: str, most: int = 200_000) -> Iterator[list[np.ndarray]]:
    """The id arrays of binary values, about ``most`` ids at a time."""
    part, total = [], 0
    for x in blobs:
        part.append(np.frombuffer(x.as_buffer(), dtype=width).astype(np.int64))
        total += len(part[-1])
        if total >= most:
            yield part
            part, total = [], 0
    if part:
        yield part


def corpus_stats(encoded: DataFrame, width: str) -> Stats:
    """``Stats`` of the column ``ids``; as many rows as the vocabulary has come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(1, dtype=np.int64), 0, 0
        for b in batches:
            for docs in id_batches(b.column(0), width):
                got = np.bincount(term_counts(docs)[1])
                if len(got) > len(df):
                    df = np.pad(df, (0, len(got) - len(df)))
                df[: len(got)] += got
                n, total = n + len(docs), total + sum(map(len, docs))
        seen = np.flatnonzero(df)
        terms, sums = np.concatenate([seen, [-1, -2]]), np.concatenate([df[seen], [n, total]])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(sums, pa.int64())], names=["term", "c"])

    sums = encoded.select("ids").mapInArrow(count, "term bigint, c bigint").groupBy("term").agg(F.sum("c").alias("c")).toArrow()
    terms, c = sums["term"].to_numpy(), sums["c"].to_numpy()
    n, total = (int(c[terms == t].sum()) for t in (-1, -2))
    df = np.zeros(int(terms.max(initial=0)) + 1, dtype=np.int64)
    df[terms[terms >= 0]] = c[terms >= 0]
    return Stats(n, max(total / max(n, 1), 1.0), df)


class Dealer:
    """Deals documents to shards by similarity.  ``learn`` finds clusters of the projected BM25
    weights (spherical k-means) and puts them in an order in which neighbours are alike;
    ``place`` gives a document's cluster and range of one more projection."""

    def __init__(self, stats: Stats, width: str = "<u4", seed: int = 1):
        self.stats, self.width, self.seed = stats, width, seed
        self.centres = np.zeros((1, DIMS), dtype=np.float32)

    def prepare(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.idf = self.stats.idf()
        self.dims = rng.integers(0, DIMS, (len(self.idf), SPREAD))
        self.signs = rng.choice(np.array([-1.0, 1.0], dtype=np.float32), (len(self.idf), SPREAD))
        self.across = rng.standard_normal(DIMS, dtype=np.float32)

    def vectors(self, docs: list[np.ndarray]) -> np.ndarray:
        doc, term, tf = term_counts(docs)
        length = np.array([len(d) for d in docs], dtype=np.float32)
        weight = (self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / self.stats.mean))).astype(np.float32)
        at = (doc.astype(np.int64) * DIMS)[:, None] + self.dims[term]
        out = np.bincount(at.ravel(), weights=(weight[:, None] * self.signs[term]).ravel(), minlength=len(docs) * DIMS)
        out = out.reshape(len(docs), DIMS).astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def learn(self, x: np.ndarray, cells: int, rounds: int = 8) -> None:
        cells = max(1, min(cells, len(x)))
        rng = np.random.default_rng(self.seed)
        centres = x[np.sort(rng.choice(len(x), cells, replace=False))]
        for _ in range(rounds):
            own = np.concatenate([(x[lo : lo + 4096] @ centres.T).argmax(axis=1) for lo in range(0, len(x), 4096)])
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres).astype(np.float32)
        order, left = [0], np.ones(cells, dtype=bool)
        left[0] = False
        while len(order) < cells:
            order.append(int(np.where(left, centres @ centres[order[-1]], -2.0).argmax()))
            left[order[-1]] = False
        self.centres = centres[order]

    def place(self, blobs: pa.Array) -> np.ndarray:
        """``cluster * SLOTS + range`` of each document."""
        out = [np.zeros(0, dtype=np.int64)]
        for docs in id_batches(blobs, self.width):
            x = self.vectors(docs)
            slot = np.clip(np.floor((x @ self.across) * (SLOTS / 8)) + SLOTS // 2, 0, SLOTS - 1)
            out.append((x @ self.centres.T).argmax(axis=1) * SLOTS + slot.astype(np.int64))
        return np.concatenate(out)


def fill_shards(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First shard of each place and over how many it is spread, and the number of shards.
    Clusters (``SLOTS`` places each) are put whole and in order into shards of ``limit``; one
    above it is put place by place, and a place above it is spread over shards of its own."""
    first, spread = np.zeros(len(sizes), dtype=np.int64), np.ones(len(sizes), dtype=np.int64)
    shard, room = 0, limit
    for lo in range(0, len(sizes), SLOTS):
        whole = int(sizes[lo : lo + SLOTS].sum())
        step = SLOTS if whole <= limit else 1
        for i in range(lo, lo + SLOTS, step):
            n = int(sizes[i : i + step].sum())
            if n > room and room < limit:
                shard, room = shard + 1, limit
            first[i : i + step] = shard
            if n > limit:
                spread[i] = -(-n // limit)
                shard += int(spread[i])
            else:
                room -= n
    return first, spread, shard + (room < limit)


def deal(encoded: DataFrame, stats: Stats, shard_chars: int, width: str) -> DataFrame:
    """``(shard, id, ids)`` of ``encoded(id, ids, size)``."""
    kind = encoded.schema["id"].dataType.simpleString()
    total = encoded.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // shard_chars))
    if shards == 1:
        return encoded.select(F.lit(0).cast("bigint").alias("shard"), "id", "ids")
    dealer, cells = Dealer(stats, width), min(2 * shards, MAX_CELLS)
    # the documents clusters are learned from: distinct ones, so that copies do not make many
    keyed = encoded.select(F.xxhash64("ids").alias("h"), "ids")
    some = keyed.where(F.pmod("h", F.lit(max(1, stats.n // (PER_CELL * cells)))) == 0).dropDuplicates(["h"])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer.prepare()
        for b in batches:
            vectors = [v.tobytes() for docs in id_batches(b.column(1), width) for v in dealer.vectors(docs)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.binary())], names=["h", "v"])

    got = some.mapInArrow(project, "h bigint, v binary").toArrow().sort_by("h")
    x = np.frombuffer(b"".join(got["v"].to_pylist()), dtype=np.float32).reshape(-1, DIMS)
    if len(x):
        dealer.learn(x, cells)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer.prepare()
        sums = np.zeros(len(dealer.centres) * SLOTS, dtype=np.int64)
        for b in batches:
            np.add.at(sums, dealer.place(b.column(0)), b.column(1).to_numpy())
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(sums[seen], pa.int64())], names=["place", "n"])

    # at most cells * SLOTS rows
    got = encoded.select("ids", "size").mapInArrow(measure, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    sizes = np.zeros(len(dealer.centres) * SLOTS, dtype=np.int64)
    sizes[got["place"].to_numpy()] = got["n"].to_numpy()
    first, spread, _ = fill_shards(sizes, shard_chars)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer.prepare()
        for b in batches:
            place, row = dealer.place(b.column(1)), mix(b.column(2).to_numpy().astype(np.uint64) + np.uint64(1))
            shard = first[place] + (row % spread[place].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), b.column(0), b.column(1)], names=["shard", "id", "ids"])

    return encoded.select("id", "ids", "row").mapInArrow(assign, f"shard bigint, id {kind}, ids binary")


class Bm25:
    """Inverted index over documents given as id arrays; ``stats`` default to their own.  A query is
    all terms of its document.  Terms that many documents have are rows of a dense matrix
    (``DENSE`` weights at most), the others posting lists; both are summed in full."""

    def __init__(self, docs: list[np.ndarray], k1: float = K1, b: float = B, stats: Stats | None = None):
        n = len(docs)
        terms, tfs = zip(*(np.unique(d, return_counts=True) for d in docs), strict=True) if docs else ((), ())
        doc = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in terms])
        term = np.concatenate(terms) if n else np.zeros(0, np.int64)
        tf = np.concatenate(tfs).astype(np.float32) if n else np.zeros(0, np.float32)
        length = np.array([len(d) for d in docs], dtype=np.float32)
        df = np.bincount(term, minlength=1)
        stats = stats or Stats(n, max(float(length.mean()), 1.0) if n else 1.0, df)
        weight = stats.idf()[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / np.float32(stats.mean)))
        common = np.argsort(-df, kind="stable")[: DENSE // max(n, 1)]
        common = common[df[common] > n / 16]
        self.row = np.full(len(df), -1, dtype=np.int64)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), n), dtype=np.float32)
        in_row = self.row[term] >= 0
        self.dense[self.row[term[in_row]], doc[in_row]] = weight[in_row]
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.start = np.concatenate([[0], np.cumsum(df)]).astype(np.int64)
        self.queries, self.n = terms, n

    def scores(self, seed: int) -> np.ndarray:
        terms = self.queries[seed]
        rows = self.row[terms]
        out = self.dense[rows[rows >= 0]].sum(axis=0)
        spans = [(self.start[t], self.start[t + 1]) for t in terms[rows < 0].tolist()]
        if spans:
            docs = np.concatenate([self.doc[a:z] for a, z in spans])
            out = out + np.bincount(docs, weights=np.concatenate([self.weight[a:z] for a, z in spans]), minlength=self.n)
        return out


def pack_shard(docs: list[np.ndarray], size: int, stats: Stats | None = None) -> list[tuple[int, int, int, int, int]]:
    """``(document, start, length, sequence, offset)`` of each piece, in order."""
    index = Bm25(docs, stats=stats)
    lens = [len(d) for d in docs]
    used = np.zeros(len(docs), dtype=bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    window, room, unread = 0, size, 0
    rest: tuple[int, int] | None = None  # a cut document and how much of it is placed
    while True:
        if rest is None:
            while unread < len(docs) and used[unread]:
                unread += 1
            if unread == len(docs):
                break
            seed, begin = unread, 0
            used[seed] = True
        else:
            seed, begin = rest
            rest = None
        doc, at, score = seed, begin, None
        while doc is not None:
            take = min(room, lens[doc] - at)
            if take:
                pieces.append((doc, at, take, window, size - room))
            room -= take
            if room == 0:
                window, room = window + 1, size
                if at + take < lens[doc]:
                    rest = (doc, at + take)
                break
            if score is None:
                score = np.where(used, 0.0, index.scores(seed))
            near = int(score.argmax())  # of equal ones the first
            doc, at = (near, 0) if score[near] > 0 else (None, 0)
            if doc is not None:
                used[doc], score[doc] = True, 0.0
    if room < size:  # the last window: powers of two need no padding
        whole = [p for p in pieces if p[3] < window]
        tail = [p for p in pieces if p[3] == window]
        left = size - room
        cuts = [1 << i for i in range(left.bit_length() - 1, -1, -1) if left >> i & 1]
        for cut in cuts:
            free = cut
            while free:
                doc, at, length, _, _ = tail.pop(0)
                take = min(free, length)
                whole.append((doc, at, take, window, cut - free))
                free -= take
                if take < length:
                    tail.insert(0, (doc, at + take, length - take, window, 0))
            window += 1
        pieces = whole
    return pieces


def pack(
    docs: DataFrame,
    tokenizer_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 2048,
    end_id: int = 1,
    shard_chars: int = 12_000_000,
    word_level: bool = True,
) -> DataFrame:
    """One row per piece: ``(<id_col>, start, length, ids, doc_tokens, sequence_id, offset)``.

    A document is its ids followed by ``end_id``; each of its ids lies in exactly one piece
    (``start`` ids of it come before), pieces fill sequences gaplessly from offset 0, and a
    sequence holds ``size`` ids or a power of two.  ``ids`` are little-endian unsigned 32-bit
    integers.  Null and empty texts are a lone ``end_id``; rows that repeat an identifier are
    packed like any others.  An empty table gives an empty result; other columns are not
    read.  ``size`` must be a power of two.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    flat = docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("text"))  # bytes need no decoding
    width = id_width(tokenizer_file, end_id)
    each, end = np.dtype(width).itemsize, np.array([end_id], dtype=width).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_file, word_level, width)
        for b in batches:
            blobs = [ids + end for ids in encoder.encode_all(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(blobs, pa.binary()), b.column(2)], names=["id", "ids", "size"])

    flat = flat.withColumn("size", F.octet_length("text").cast("bigint") + 1)
    encoded = flat.mapInArrow(encode, f"id {kind}, ids binary, size bigint")
    # the row number tells apart rows that repeat an identifier and a text
    encoded = cut_lineage(encoded.withColumn("row", F.monotonically_increasing_id()))
    stats = corpus_stats(encoded, width)
    dealt = deal(encoded, stats, shard_chars, width)

    def pack_group(key, rows: Iterator[pa.RecordBatch]):
        shard = key[0].as_py()
        ids, blobs = [], []
        for b in rows:
            ids.extend(b.column("id").to_pylist())
            blobs.extend(b.column("ids").to_pylist())
        # order by content, so that the result does not depend on the order of arrival
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0, blobs[i]))
        ids, blobs = [ids[i] for i in order], [blobs[i] for i in order]
        pieces = pack_shard([np.frombuffer(x, dtype=width).astype(np.int32) for x in blobs], size, stats)
        base = shard << 32
        for lo in range(0, len(pieces), 5000):
            part = pieces[lo : lo + 5000]
            yield pa.RecordBatch.from_pydict(
                {
                    "id": pa.array([ids[p[0]] for p in part], rows_type),
                    "start": pa.array([p[1] for p in part], pa.int64()),
                    "length": pa.array([p[2] for p in part], pa.int64()),
                    "ids": pa.array([np.frombuffer(blobs[p[0]], width, p[2], each * p[1]).astype("<u4").tobytes() for p in part], pa.binary()),
                    "doc_tokens": pa.array([len(blobs[p[0]]) // each for p in part], pa.int64()),
                    "sequence_id": pa.array([base + p[3] for p in part], pa.int64()),
                    "offset": pa.array([p[4] for p in part], pa.int64()),
                }
            )

    from pyspark.sql.pandas.types import to_arrow_type

    rows_type = to_arrow_type(docs.schema[id_col].dataType)
    pack_group.__annotations__ = {"key": tuple[pa.Scalar, ...], "rows": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    schema = f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return dealt.groupBy("shard").applyInArrow(pack_group, schema).withColumnRenamed("id", id_col)


def unpack(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The ids of each document, its pieces joined in order: ``(<id_col>, ids)``.  Identifiers
    must be unique."""
    parts = F.array_sort(F.collect_list(F.struct("start", "ids")))
    joined = F.concat_ws("", F.transform(parts, lambda p: F.hex(p["ids"])))
    return pieces.groupBy(id_col).agg(F.unhex(joined).alias("ids"))
