"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

Training data are confirmed toxic documents (P) and documents whose label is not looked at
(U).  With class prior ``pi`` the risk of a classifier ``g`` is

    R = pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)])

(logistic loss ``l``); when the bracket falls below zero, the step is taken along minus the
gradient of the bracket, as the published estimator does.  ``bags`` logistic classifiers
over hashed words are trained in numpy, one Spark task each, on all sampled P and their own
share of the sampled U; the score is the mean of their probabilities.

Only the fit is bounded: ``max_positive`` and ``max_unlabelled`` documents, those with the
smallest hash of their identifier, so the sample does not depend on order or partitions.
Their whole texts are turned into features in tasks; scoring reads every whole text.  The
model, ``bags x 2^bits`` floats, is the only thing sent to scoring tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundeval.llm.common import WordTable

EDGES = re.compile(r"^[\W_]+|[\W_]+$")
LN2 = 0.6931471805599453


def word_feature(bits: int):
    """Feature number of a white-space word: case and punctuation around it do not count;
    -1 for a word of punctuation only."""

    def make(word: str) -> int:
        core = EDGES.sub("", word.lower())
        return xxhash.xxh64_intdigest(core.encode("utf-8", "replace")) >> (64 - bits) if core else -1

    return make


def features(text: str | None, words: WordTable) -> np.ndarray:
    """Sorted numbers of the distinct words of a text."""
    found = np.array([words[w] for w in set((text or "").split())], dtype=np.int64)
    found = np.unique(found)
    return found[found >= 0]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


def train_nnpu(
    pos: list[np.ndarray], unl: list[np.ndarray], prior: float, bits: int, steps: int, rate: float, l2: float, min_share: float, lift: float
) -> np.ndarray:
    """Weights (the last one is the bias) of one classifier, by full-batch Adam on the nnPU
    risk.  A word gets a weight if it is in three toxic documents (and in ``min_share`` of
    them, if given) and in ``lift`` times as large a share of them as of the unlabelled ones;
    others are no evidence of toxicity and would only be learned by heart."""
    size = 1 << bits
    docs = pos + unl
    lens = np.array([len(d) for d in docs])
    cols = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    cut = lens[: len(pos)].sum()
    in_pos, in_unl = np.bincount(cols[:cut], minlength=size), np.bincount(cols[cut:], minlength=size)
    often = in_pos >= max(3.0, min_share * len(pos))
    used = np.flatnonzero(often & (in_pos * max(1, len(unl)) >= lift * in_unl * max(1, len(pos))))
    slot = np.full(size, -1, dtype=np.int64)
    slot[used] = np.arange(len(used))
    rows = np.repeat(np.arange(len(docs)), lens)
    keep = slot[cols] >= 0
    rows, cols = rows[keep], slot[cols[keep]]
    w, m, v = (np.zeros(len(used) + 1) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior))
    n_pos = len(pos)
    is_pos = np.arange(len(docs)) < n_pos
    a_pos, a_unl = 1.0 / max(1, n_pos), 1.0 / max(1, len(unl))
    for step in range(1, steps + 1):
        g = w[-1] + np.bincount(rows, weights=w[cols], minlength=len(docs))
        p = sigmoid(g)
        loss_neg = np.logaddexp(0.0, g)  # l(-g)
        rest = a_unl * loss_neg[n_pos:].sum() - prior * a_pos * loss_neg[:n_pos].sum()
        down = np.where(is_pos, -prior * a_pos * p, a_unl * p)  # gradient of the bracket
        if rest >= 0:
            d = down + np.where(is_pos, -prior * a_pos * (1 - p), 0.0)
        else:
            d = -down
        grad = np.append(np.bincount(cols, weights=d[rows], minlength=len(used)), d.sum())
        grad[:-1] += l2 * w[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    full = np.zeros(size + 1, dtype=np.float32)
    full[used], full[-1] = w[:-1], w[-1]
    return full


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    train: Column | None = None,
    prior: float | None = None,
    max_positive: int = 6000,
    max_unlabelled: int = 24000,
    bags: int = 3,
    bits: int = 18,
    steps: int = 300,
    rate: float = 0.05,
    l2: float = 3e-5,
    min_share: float = 0.0,
    lift: float = 4.0,
    seed: int = 7,
) -> np.ndarray:
    """``bags x (2^bits + 1)`` weights.  Labels are read only from rows where ``train`` holds;
    ``prior`` defaults to the toxic share of the labelled training rows.  ``min_share`` is a
    share of all toxic documents: above 0 it takes the cues of small languages away.  Without a toxic
    training row all weights are zero and the bias says ``prior`` (0.5 if unknown)."""
    train = F.lit(True) if train is None else train
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"), train.alias("ok"))
    known = known.where(F.col("ok") & F.col("id").isNotNull() & F.col("label").isNotNull())
    if prior is None:
        prior = known.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0]
        prior = 0.5 if prior is None else min(max(prior, 1e-3), 0.5)
    order = F.xxhash64(F.col("id"), F.lit(seed))
    toxic = known.where("label = 1").select("id").distinct().orderBy(order, "id").limit(max_positive).withColumn("pos", F.lit(True))
    ids = docs.where(train).select(F.col(id_col).alias("id")).where("id is not null").distinct()
    unlabelled = ids.orderBy(order, "id").limit(max_unlabelled).withColumn("pos", F.lit(False))
    # at most max_positive + max_unlabelled identifiers: small enough to broadcast by contract
    chosen = toxic.unionByName(unlabelled)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "id")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(word_feature(bits))
        for b in batches:
            feats = [features(t, words).astype(np.int32).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(feats, pa.binary())], names=["id", "pos", "feats"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = sample.mapInArrow(featurise, f"id {kind}, pos boolean, feats binary")
    bag = F.when(F.col("pos"), F.sequence(F.lit(0), F.lit(bags - 1))).otherwise(
        F.array(F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(bags)).cast("int"))
    )
    rows = rows.withColumn("bag", F.explode(bag))

    def learn(key, data):
        data = data.sort_by([("pos", "descending"), ("id", "ascending")])
        pos = np.array(data["pos"].to_pylist(), dtype=bool)
        feats = [np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in data["feats"].to_pylist()]
        split = int(pos.sum())
        if split:
            w = train_nnpu(feats[:split], feats[split:], prior, bits, steps, rate, l2, min_share, lift)
        else:
            w = np.append(np.zeros(1 << bits), np.log(prior / (1 - prior))).astype(np.float32)
        return pa.table({"bag": pa.array([key[0].as_py()], pa.int32()), "w": pa.array([w.tobytes()], pa.binary())})

    got = rows.groupBy("bag").applyInArrow(learn, "bag int, w binary").collect()
    models = [np.frombuffer(r.w, dtype=np.float32) for r in sorted(got, key=lambda r: r.bag)]
    if not models:
        empty = np.zeros((1, (1 << bits) + 1), dtype=np.float32)
        empty[0, -1] = np.log(prior / (1 - prior))
        return empty
    return np.stack(models)


def score(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per document: ``(<id_col>, score, predicted)``; see ``toxicity``."""
    spark = docs.sparkSession
    bits = int(model.shape[1] - 1).bit_length() - 1
    sent = spark.sparkContext.broadcast(np.ascontiguousarray(model.T))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        words = WordTable(word_feature(bits))
        for b in batches:
            out = [float(sigmoid(w[-1] + w[features(t, words)].sum(axis=0, dtype=np.float64)).mean()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(out, pa.float64()), pa.array([int(x >= threshold) for x in out], pa.int32())],
                names=["id", "score", "predicted"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(scored, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame, train: Column | None = None, threshold: float = 0.7, **fit_params) -> DataFrame:
    """One row per document: ``(doc_id, score, predicted)``.

    A null or empty text has no features and scores as the bias does; repeated rows are each
    scored; labels that are null, or of unknown identifiers, are not used; an empty
    ``documents`` gives an empty result and empty ``labels`` the same score everywhere.
    Columns other than ``doc_id``, ``text`` and ``toxic`` are not read.
    """
    return score(docs, fit(docs, labels, train=train, **fit_params), threshold=threshold)
