"""Periodic runs of words by an online sparse diagonal dynamic programme.

A run with period ``q`` is a stretch in which every word equals the word ``q`` before it: a
diagonal at lag ``q`` of the text's self-comparison.  Going through a document word by word,
each earlier occurrence of the word lengthens the match of its lag; a diagonal that the word
does not lengthen ends there and, if long enough, is emitted at once.

The diagonals are kept sparse without losing any:

* A run of at least ``min_periods >= 3`` periods matches at least ``2 q`` words at lag ``q``, so an
  occurrence counts only with the last ``k`` words repeated, ``k`` a power of two with
  ``k / 2 <= q < k`` (short lags share the first ``k``, the largest within two thirds of
  ``min_words``).  Word groups are named exactly, each from its two halves, and only groups
  that repeat inside their document are looked at again; no hash is involved.
* Of those occurrences only the nearest counts.  If the last ``k > q`` words recur at lags
  ``d < q`` and ``q``, they have periods ``d`` and ``q - d``, whose sum is at most ``k``, hence (Fine
  and Wilf) a period that divides both and so ``q``: the stretch at lag ``q`` has a smaller
  period and is the other diagonal's.  For the same reason a diagonal of nearest occurrences
  breaks only where its run ends, and its lag is the run's smallest period.

So a word has at most one live lag per power of two whatever the text, and a document of one
repeated word costs no more than any other.  Documents are independent: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundeval.llm.common import as_bytes

PIECE_WORDS = 400_000  # documents are handled together up to so many words; a longer one by itself


class _Names(dict):
    """Numbers words in order of appearance, from ``first`` on."""

    def __init__(self, first: int):
        super().__init__()
        self.next = first

    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.next
        self.next += 1
        return n


def word_names(texts: list[list[bytes]]) -> np.ndarray:
    """One number per word of all texts in a row; equal only for equal words of one text."""
    out, n = [], 0
    for words in texts:
        names = _Names(n)
        out.append(np.fromiter(map(names.__getitem__, words), dtype=np.int64, count=len(words)))
        n = names.next
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def _recurring(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places whose key occurs at least twice, their keys numbered anew; and for each place with
    an equal key before it, how far back the nearest is."""
    if not len(at):
        return at, key, at, at
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    same = key[1:] == key[:-1]
    back, lag = at[1:][same], (at[1:] - at[:-1])[same]
    again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    number = np.cumsum(np.concatenate([[True], ~same]))[again]
    return at[again], number, back, lag


def occurrences(names: np.ndarray, longest: int, min_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(k, places, lags)``: where the ``k`` words from a place on also begin ``lag`` words
    earlier, nearest only, for the lags that ``k`` is in charge of."""
    first = 2
    while 2 * first <= 2 * min_words // 3:
        first *= 2
    k, at, number = 1, np.arange(len(names)), names
    at, number, _, _ = _recurring(at, number)
    here = np.full(len(names) + 1, -1, dtype=np.int64)
    while len(at):
        here[at] = number
        then = at + k
        second = np.where(then < len(names), here[np.minimum(then, len(names))], -1)
        here[at] = -1
        both = second >= 0
        key = number[both] * (number.max() + 1) + second[both]
        k *= 2
        at, number, back, lag = _recurring(at[both], key)
        if k >= first:
            fits = (lag < k) & ((lag >= k // 2) | (k == first))
            yield k, back[fits], lag[fits]
            if 3 * k > longest:  # the next lags begin at k
                return


def diagonals(events: Iterator[tuple[int, np.ndarray, np.ndarray]], min_words: int, min_periods: int) -> list[tuple[int, int, int]]:
    """Runs ``(start, length, period)`` from the occurrences, in order of their ends."""
    parts = [(np.full(len(at), k), at, lag) for k, at, lag in events]
    if not parts:
        return []
    ks, places, lags = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(places + ks, kind="stable")  # by the word that ends the repeated group
    live: dict[int, int] = {}  # lag -> matched words so far
    runs, before = [], -1

    def end(diagonals: dict[int, int], upto: int) -> None:
        for lag, matched in diagonals.items():
            if matched + lag >= max(min_words, min_periods * lag):
                runs.append((upto - matched - lag, matched + lag, lag))

    ended: dict[int, int] = {}
    for word, k, lag in zip((places + ks)[order].tolist(), ks[order].tolist(), lags[order].tolist(), strict=True):
        if word != before:
            end(ended, before - 1)  # not lengthened by the last word
            if word == before + 1:
                ended, live = live, {}
            else:
                end(live, before)
                ended, live = {}, {}
            before = word
        live[lag] = ended.pop(lag, k - 1) + 1
    end(ended, before - 1)
    end(live, before)
    return runs


def text_runs(texts: list[list[bytes]], min_words: int = 24, min_periods: int = 3) -> list[list[tuple[int, int, int]]]:
    """The runs ``(start, length, period)`` of every text (a list of words), by start, then period."""
    counts = [len(t) for t in texts]
    first = np.cumsum([0, *counts])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    events = occurrences(word_names(texts), max(counts, default=0), min_words)
    for start, length, period in diagonals(events, min_words, min_periods):
        i = int(np.searchsorted(first, start, side="right")) - 1
        found[i].append((int(start - first[i]), length, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in found]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact ratio of length to period; ties: smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2] or (r[1] * best[2] == best[1] * r[2] and (r[0], r[2]) < (best[0], best[2])):
            best = r
    return best


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return list(compress(words, keep.tolist()))


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = (
    "{id} bigint, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
)


def find_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 24,
    min_periods: int = 3,
    rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """One row per input row: ``(<id_col>, n_words, n_runs, start, length, period, exponent_milli,
    runs, collapsed)``.

    Words are separated by ASCII white space and numbered from 0.  ``runs`` holds every maximal
    stretch with smallest period ``q`` of at least ``max(min_words, min_periods * q)`` words, by
    start, then period; the four columns before it describe the one with the greatest
    length / period (ties: smallest start, then period; nulls if there is none;
    ``exponent_milli`` is floor(1000 * length / period)).  ``collapsed`` is the text without
    words that a run contains after its first period, joined by one space.  ``rewrite`` may
    change the words of a document before they are looked at.

    A null or blank text has no words, no runs and an empty ``collapsed``.  Long texts are read
    whole; rows that repeat, null identifiers and columns of any name do no harm (only the two
    named are read).  An empty table gives an empty result.  ``min_periods`` is at least 3.
    """
    if min_periods < 3 or min_words < 1:
        raise ValueError("min_periods must be 3 or more, min_words 1 or more")

    def piece(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = text_runs(texts, min_words, min_periods)
        best = [strongest(r) for r in found]
        columns = [[b and b[i] for b in best] for i in range(3)]
        columns.append([b and 1000 * b[1] // b[2] for b in best])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([len(r) for r in found], pa.int64()),
                *[pa.array(c, pa.int64()) for c in columns],
                pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in found], pa.list_(_RUN)),
                pa.array([b" ".join(collapse(t, r)) for t, r in zip(texts, found, strict=True)], pa.binary()).cast(pa.string()),
            ],
            names=[id_col, "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, size = [], [], 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = as_bytes(text.as_py()).split()
                words = rewrite(i, words) if rewrite else words
                if ids and size + len(words) > PIECE_WORDS:
                    yield piece(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(words)
                size += len(words)
            if ids:
                yield piece(ids, texts)

    flat = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return flat.mapInArrow(run, _SCHEMA.format(id=f"`{id_col}`"))
