"""Language identification by rank-order profiles.

A profile is a language's ``profile_size`` most frequent character n-grams (n = 1..3, taken
inside words padded with ``_``), ordered by count, ties by code points.  A document's own
most frequent n-grams are compared to each profile by the out-of-place distance: the sum of
rank differences, with ``profile_size`` for an n-gram that the profile lacks.

Training counts n-grams over all training texts: every task counts into arrays, one row per
(language, n-gram) and task is shuffled, and the top of each language is taken by a window
with a per-task limit.  The profiles are ``languages x profile_size`` integers, which is
the only thing sent to tasks; more than ``max_languages`` values of the label column are an
error, never a cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
PAD = 95  # "_", the edge of a letter run
LOW = np.array([chr(c).isalpha() for c in range(0x3000)], dtype=bool)


def gram_counts(text: str, max_n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text's letter runs, in order, and their counts.  An n-gram is
    packed into 63 bits, 21 a code point, first one highest, so keys sort as n-grams do."""
    cps = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    if cps.max() < len(LOW):
        letter = LOW[cps]
    else:
        kinds, back = np.unique(cps, return_inverse=True)
        letter = np.array([chr(c).isalpha() for c in kinds.tolist()], dtype=bool)[back]
    cps = np.where(letter, cps, PAD)
    parts = [cps[letter] << 42]
    if max_n >= 2:
        parts.append(((cps[:-1] << 42) | (cps[1:] << 21))[letter[:-1] | letter[1:]])
    if max_n >= 3:
        parts.append(((cps[:-2] << 42) | (cps[1:-1] << 21) | cps[2:])[letter[1:-1]])
    keys = np.sort(np.concatenate(parts))
    if not len(keys):
        return keys, keys
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


def top_grams(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in rank order, ties in n-gram order."""
    small = np.int16 if counts.max(initial=0) < 32768 else np.int64  # 16 bits sort fastest
    return keys[np.argsort(-counts.astype(small), kind="stable")[:size]]


def train_profiles(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    profile_size: int = 400,
    max_n: int = 3,
    max_languages: int = 1000,
) -> dict[str, np.ndarray]:
    """``{language: n-gram keys in rank order}`` from all rows with a language and a text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, list[str]] = {}
        chars: dict[str, int] = {}

        def rows(lang: str) -> pa.RecordBatch:
            keys, n = gram_counts(" ".join(texts.pop(lang)), max_n)
            chars.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["lang", "gram", "n"])

        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
                chars[lang] = chars.get(lang, 0) + len(text)
                if chars[lang] > 1_000_000:
                    yield rows(lang)
        for lang in list(texts):
            yield rows(lang)

    train = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    train = train.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = train.mapInArrow(counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= profile_size)
    rows = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "gram"))).alias("grams")).limit(max_languages + 1).collect()
    if len(rows) > max_languages:
        raise ValueError(f"more than {max_languages} languages in {lang_col!r}")
    return {r.lang: np.array([g.gram for g in r.grams], dtype=np.int64) for r in sorted(rows, key=lambda r: r.lang)}


class Identifier:
    """Scores texts against the profiles; used inside tasks."""

    def __init__(self, profiles: dict[str, np.ndarray], profile_size: int, max_n: int):
        self.langs = sorted(profiles)
        self.size, self.max_n = profile_size, max_n
        known = [profiles[x] for x in self.langs]
        self.keys = np.unique(np.concatenate(known)) if known else np.zeros(0, np.int64)
        self.rank = np.full((len(self.keys) + 1, max(1, len(known))), -1, dtype=np.int64)  # last row: in no profile
        for j, keys in enumerate(known):
            self.rank[np.searchsorted(self.keys, keys), j] = np.arange(len(keys))

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs:
            return UNKNOWN, 0.0
        keys, counts = gram_counts(text, self.max_n)
        if not len(keys):
            return UNKNOWN, 0.0
        top = top_grams(keys, counts, self.size)
        at = np.searchsorted(self.keys, top)
        if len(self.keys):
            at[self.keys[np.minimum(at, len(self.keys) - 1)] != top] = len(self.keys)
        ranks = self.rank[at]
        apart = np.abs(ranks - np.arange(len(top))[:, None])
        dist = np.where(ranks < 0, self.size, apart).sum(axis=0)
        best = int(dist.argmin())  # ties: the first language by name
        return self.langs[best], 1.0 - float(dist[best]) / (self.size * len(top))


def identify(
    docs: DataFrame,
    train: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    profile_size: int = 400,
    max_n: int = 3,
) -> DataFrame:
    """One row per document: ``(<id_col>, lang_pred, score)``.

    Profiles come from the rows where ``train`` holds (default: all) and text and language
    are not null.  ``lang_pred`` is ``und`` with score 0 if the text is null or has no
    letter, or if nothing was learned; else the language at the least out-of-place
    distance, ties by name, with score ``1 - distance / largest possible distance``.  Whole
    texts are used.  Repeated rows are each scored; an empty table gives an empty result;
    columns not named are not read.
    """
    profiles = train_profiles(docs if train is None else docs.where(train), text_col, lang_col, profile_size, max_n)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(profiles, profile_size, max_n)
        for b in batches:
            got = [identifier.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=["id", "lang_pred", "score"],
            )

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = narrow.mapInArrow(scored, f"id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def keep_identified(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", profile_size: int = 400, max_n: int = 3, min_score: float = 0.0
) -> DataFrame:
    """The rows of ``docs`` with a language: those predicted ``und`` or scored below
    ``min_score`` go.  Profiles come from all labelled rows; all columns stay unchanged.  With
    no labelled row there is nothing to compare with and only texts without letters go."""
    profiles = train_profiles(docs, text_col, lang_col, profile_size, max_n)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(profiles or {"": np.zeros(0, np.int64)}, profile_size, max_n)
        floor = min_score if profiles else 0.0
        for b in batches:
            got = [identifier.predict(t) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            yield b.filter(pa.array([lang != UNKNOWN and score >= floor for lang, score in got], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
