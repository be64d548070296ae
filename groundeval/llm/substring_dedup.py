"""Removal of passages that repeat across documents, found by difference-cover anchors.

A window is ``window`` consecutive words.  Let ``D`` be a difference cover modulo ``period``:
every residue is a difference of two members.  Only the ``window - period + 1`` words
that begin at positions ``p`` with ``p mod period`` in ``D`` are hashed: the anchors.  Wherever
two documents share ``window`` words, whatever the two positions, some shift below
``period`` brings both onto the cover, so they share an aligned anchor inside the match.

1. Anchors that occur in more than one document are found by one aggregation.
2. They are extended: every window around a shared anchor is hashed (128 bits, two
   polynomials over the word hashes), its smallest document is found, and a window that also
   starts in a smaller document is marked.
3. The words that marked windows cover are removed.

A whole text is an anchor too (position -1): a document with the words of a smaller one is
settled by that alone, so big groups of copies make no windows.  Hot passages are combined
before they are shuffled, and joins back go by (hash) with both sides as they are, which
adaptive execution can split.  The texts are shuffled once, by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundeval.llm.common import WordHasher, as_bytes, cut_lineage, shuffle_partitions

#: Perfect difference sets, smallest covers of their period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
LAST = (1 << 63) - 1  # stands for a null identifier: after all others
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers of the window hashes


def cover_for(window: int) -> int:
    """The largest tabled period that leaves anchors of a third of the window or more."""
    return max(p for p in COVERS if 3 * (window - p + 1) >= window)


def window_hashes(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash modulo 2^64 of every ``width`` consecutive word hashes, put together
    from windows of power-of-two widths."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, cur, size = None, words, 1
    covered = 0
    while True:
        if width & size:
            if done is None:
                done, covered = cur, size
            else:
                m = len(words) - (covered + size) + 1
                done = done[:m] * np.uint64(pow(base, size, 1 << 64)) + cur[covered : covered + m]
                covered += size
        if covered == width:
            return done
        m = len(words) - 2 * size + 1
        cur = cur[:m] * np.uint64(pow(base, size, 1 << 64)) + cur[size : size + m]
        size *= 2


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), pa.int64())


def shared_anchors(texts: DataFrame, window: int, period: int) -> DataFrame:
    """``(id, row, pos, first)`` of the anchors that more than one document has; ``first`` is
    the smallest such document.  ``texts`` has ``(id, row, text)``."""
    width = window - period + 1
    cover = np.zeros(period, dtype=bool)
    cover[list(COVERS[period])] = True

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            ids, rows, poss, hashes = [], [], [], []
            for i, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = hasher(as_bytes(text))
                if len(words) < window:
                    continue
                h = window_hashes(words, width, BASES[0])
                at = np.flatnonzero(cover[np.arange(len(h)) % period])
                whole = np.array([xxhash.xxh64_intdigest(words.tobytes(), seed=len(words))], dtype=np.uint64)
                poss.append(np.append(at, -1).astype(np.int32))
                hashes.append(np.append(h[at], whole))
                ids.append(np.full(len(at) + 1, i, dtype=np.int64))
                rows.append(np.full(len(at) + 1, row, dtype=np.int64))
                if sum(map(len, poss)) > 200_000:
                    yield flat(ids, rows, poss, hashes)
                    ids, rows, poss, hashes = [], [], [], []
            if ids:
                yield flat(ids, rows, poss, hashes)

    def flat(ids, rows, poss, hashes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(ids)), pa.array(np.concatenate(rows)), pa.array(np.concatenate(poss)), _signed(np.concatenate(hashes))],
            names=["id", "row", "pos", "hash"],
        )

    found = texts.select("id", "row", "text").mapInArrow(anchors, "id bigint, row bigint, pos int, hash bigint")
    span = found.groupBy("hash").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    return found.join(span.where("first < last").drop("last"), "hash").select("id", "row", "pos", "first")


def repeated_passages(docs: DataFrame, id_col: str, text_col: str, window: int, period: int) -> tuple[DataFrame, DataFrame]:
    """``(texts, marks)``: the texts ``(id, row, text)`` shuffled by document, and one row
    ``(id, row, copy, starts)`` per document that a smaller one repeats: whether all its
    words are, else the starts of its windows that are."""
    parts = shuffle_partitions(docs.sparkSession)
    texts = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("row", F.xxhash64("text"))
    near = shared_anchors(texts, window, period)
    near = near.groupBy("id", "row").agg(
        F.max((F.col("pos") < 0) & (F.col("first") < F.col("id"))).alias("copy"),
        F.collect_set(F.when(F.col("pos") >= 0, F.col("pos"))).alias("at"),
    )
    near = cut_lineage(near)
    texts = texts.repartition(parts, "id", "row")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            for i, row, text, at in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                h = hasher(as_bytes(text))
                n = len(h) - window + 1
                pos = np.array(at, dtype=np.int64)
                step = np.zeros(n + 1, dtype=np.int64)
                np.add.at(step, np.minimum(np.maximum(pos - period + 1, 0), n), 1)
                np.add.at(step, np.minimum(pos + 1, n), -1)
                starts = np.flatnonzero(np.cumsum(step)[:n] > 0)
                if not len(starts):
                    continue
                h1 = window_hashes(h, window, BASES[0])
                h2 = window_hashes((h ^ (h >> np.uint64(31))) * np.uint64(BASES[0]), window, BASES[1])
                k = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, i)), pa.array(np.full(k, row)), pa.array(starts.astype(np.int32)), _signed(h1[starts]), _signed(h2[starts])],
                    names=["id", "row", "start", "h1", "h2"],
                )

    asked = texts.join(near.where("not copy and size(at) > 0"), ["id", "row"]).dropDuplicates(["id", "row"])
    found = asked.select("id", "row", "text", "at").mapInArrow(windows, "id bigint, row bigint, start int, h1 bigint, h2 bigint")
    span = found.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    hit = found.join(span.where("first < last").drop("last"), ["h1", "h2"]).where("first < id")
    marks = hit.groupBy("id", "row").agg(F.collect_set("start").alias("starts")).withColumn("copy", F.lit(False))
    copies = near.where("copy").select("id", "row", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("copy"))
    return texts, marks.unionByName(copies)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, period: int | None = None
) -> DataFrame:
    """One row per document: ``(<id_col>, n_words, n_removed, kept)``.

    Words are runs of ``[^\\x20\\x09-\\x0D]``.  A word goes if a window of ``window`` words that
    covers it also starts in a document with a smaller identifier, judged on the input;
    ``kept`` joins the rest by single spaces.  Repeats inside a document and between rows
    of one identifier are left alone.  A null text has no words; a null identifier counts
    as larger than all others.  Texts below ``window`` words stay whole.  Repeated rows each
    get the same result, an empty table an empty one; other columns are not read.
    """
    period = cover_for(window) if period is None else period
    texts, marks = repeated_passages(docs, id_col, text_col, window, period)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, gone, kept = [], [], []
            for text, copy, starts in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                words = as_bytes(text).split()
                total.append(len(words))
                if copy:
                    words = []
                elif starts:
                    step = np.zeros(len(words) + 1, dtype=np.int64)
                    step[starts] += 1
                    np.add.at(step, np.array(starts) + window, -1)
                    stay = np.cumsum(step)[: len(words)] == 0
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                names=["id", "n_words", "n_removed", "kept"],
            )

    joined = texts.join(marks, ["id", "row"], "left").select("id", "text", "copy", "starts")
    out = joined.mapInArrow(cut, "id bigint, n_words bigint, n_removed bigint, kept string")
    ident = F.when(F.col("id") != LAST, F.col("id")).alias(id_col)
    return out.select(ident, "n_words", "n_removed", "kept")
