"""Hard negatives by slot-decomposed selection.

Every positive of an anchor opens a window of scores for its negatives: from a share of the
positive's score up to that score.  The windows of one anchor overlap, so they are not
searched one by one:

1. Positives: blocks of an anchor's label meet the anchors of the label; every block keeps
   its best ``n_positives`` per anchor, and the best of those stay.
2. The distinct upper limits ``u1 > u2 > ...`` of an anchor's windows cut scores into disjoint
   slots ``(u2, u1], (u3, u2], ...``.  Blocks of all rows meet the anchors; a score falls into
   one slot, and the block, as a combiner, keeps the best ``k`` per anchor and slot.
3. The best ``k`` per anchor and slot of all blocks are merged.  Slots descend, so a window
   is answered by the suffix of slots from its own limit downwards: the first ``k`` of them
   in order, cut at the window's lower end.

Blocks are packed by ``block_values`` vector components whatever the labels' sizes, and meet
anchors in blocks too, so a task holds one block of each; a label or a vector that a third
of all rows share is many blocks.  Products are exact: in doubles while they fit in 53 bits,
in 64-bit integers beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundeval.llm.common import cut_lineage, shuffle_partitions

LEAST_ROWS = 256  # no smaller blocks are made just to have more tasks
CELLS = 1 << 21  # scores held at once


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: float) -> DataFrame:
    """``(id, label, v, dim)``: components as ``floor(scale * x)``, one row per identifier."""
    vector = F.col(vector_col).cast("array<double>")
    flat = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), vector.alias("x"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    flat = flat.where("id is not null and label is not null and x is not null").where((F.size("x") > 0) & ~bad)
    whole = F.transform("x", lambda x: F.floor(x * F.lit(float(scale))))
    one = flat.groupBy("id").agg(F.min(F.struct("label", whole.alias("v"))).alias("row"))
    return one.select("id", "row.label", "row.v", F.size("row.v").alias("dim"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two integer matrices."""
    def peak(x: np.ndarray) -> int:
        return max(int(x.max(initial=0)), -int(x.min(initial=0)))

    most = peak(a) * peak(b) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    raise ValueError("inner products of these vectors exceed 64-bit integers")


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1)


def _first(group: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the first ``k`` of every group: highest scores, ties by smaller identifier."""
    order = np.lexsort((ident, -score, group))
    g = group[order]
    new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.empty(0, dtype=bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    return order[np.arange(len(g)) - start < k]


def _scored(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table, pa.Table]]:
    """``(first anchor, scores, anchors, rows)`` for as many anchors at a time as fit in ``CELLS``."""
    is_anchor = group["kind"].to_numpy() == 1
    anchors, rows = group.filter(pa.array(is_anchor)), group.filter(pa.array(~is_anchor))
    if not anchors.num_rows or not rows.num_rows:
        return
    a, b = _matrix(anchors), _matrix(rows)
    step = max(1, CELLS // rows.num_rows)
    for at in range(0, anchors.num_rows, step):
        yield at, products(a[at : at + step], b), anchors, rows


def best_positives(key: tuple, group: pa.Table, k: int) -> pa.Table:
    out = [[], [], []]
    for at, scores, anchors, rows in _scored(group):
        own, ids = anchors["id"].to_numpy()[at : at + len(scores)], rows["id"].to_numpy()
        i, j = np.nonzero(own[:, None] != ids[None, :])
        s = scores[i, j]
        take = _first(i, s, ids[j], k)
        for o, x in zip(out, (own[i[take]], ids[j[take]], s[take]), strict=True):
            o.append(x)
    return pa.table({c: pa.array(np.concatenate(x) if x else [], pa.int64()) for c, x in zip(("anchor", "id", "score"), out, strict=True)})


def best_per_slot(key: tuple, group: pa.Table, k: int, share: tuple[int, int]) -> pa.Table:
    """The best ``k`` rows of another label per anchor and slot (named by its upper limit)."""
    out = [[], [], [], []]
    for at, scores, anchors, rows in _scored(group):
        own, ids = anchors["id"].to_numpy()[at : at + len(scores)], rows["id"].to_numpy()
        limits = [np.array(x, dtype=np.int64) for x in anchors["limits"].slice(at, len(scores)).to_pylist()]
        most = np.array([x[0] for x in limits])[:, None]
        least = np.array([-(-share[0] * int(x[-1]) // share[1]) for x in limits])[:, None]
        other = anchors["label"].to_numpy()[at : at + len(scores), None] != rows["label"].to_numpy()[None, :]
        i, j = np.nonzero(other & (scores <= most) & (scores >= least))
        s = scores[i, j]
        wide = max(len(x) for x in limits)
        padded = np.array([np.concatenate([x, np.full(wide - len(x), np.iinfo(np.int64).min)]) for x in limits])
        slot = (padded[i] >= s[:, None]).sum(axis=1) - 1
        take = _first(i * wide + slot, s, ids[j], k)
        for o, x in zip(out, (own[i[take]], padded[i[take], slot[take]], ids[j[take]], s[take]), strict=True):
            o.append(x)
    return pa.table({c: pa.array(np.concatenate(x) if x else [], pa.int64()) for c, x in zip(("anchor", "slot", "id", "score"), out, strict=True)})


def _leading(df: DataFrame, by: list[str], k: int, name: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return df.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    n_positives: int = 5,
    k: int = 5,
    share: tuple[int, int] = (4, 5),
    scale: float = 256.0,
    block_values: int = 1 << 20,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: for each
    anchor and each of its positives the first ``k`` rows of another label whose score lies
    between ``share`` (a fraction, as two integers) of the positive's score and that score.

    Anchors are the rows where ``is_anchor``, a condition on the column ``id``, holds; positives
    the first ``n_positives`` other rows of the anchor's label.  A score is the inner product of
    the vectors' components as ``floor(scale * x)``; higher scores come first, ties by smaller
    identifier.  Rows with a null identifier, label or vector, an empty vector, or a null or
    non-finite component take no part; vectors of different lengths do not meet.  Of rows that
    repeat an identifier the smallest (label, vector) counts.  Anchors without positives and
    windows without rows give no rows; a window below zero is empty.  An empty table gives an
    empty result; other columns are not read.  Products beyond 64 bits are an error.
    """
    parts = shuffle_partitions(rows.sparkSession)
    flat = cut_lineage(usable(rows, id_col, vector_col, label_col, scale).withColumn("anchor", F.coalesce(is_anchor, F.lit(False))))
    total = flat.agg(F.count("*").alias("n"), F.count_if("anchor").alias("a"), F.max("dim").alias("dim")).first()
    held = max(LEAST_ROWS, block_values // (total.dim or 1))

    def blocks(n: Column) -> Column:
        return F.greatest(F.ceil(n / held), F.least(F.lit(parts), F.ceil(n / LEAST_ROWS)), F.lit(1))

    def meet(rows: DataFrame, anchors: DataFrame, anchor_blocks: Column, row_blocks: Column) -> DataFrame:
        """Both sides in blocks (``h`` of anchors, ``g`` of rows), every one with every other."""
        draw, every = F.xxhash64("id"), lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
        left = anchors.withColumn("h", F.pmod(draw, anchor_blocks)).withColumn("g", every(row_blocks))
        right = rows.withColumn("g", F.pmod(draw, row_blocks)).withColumn("h", every(anchor_blocks))
        columns = ["id", "label", "dim", "v", "g", "h", "limits"]
        left, right = (x if "limits" in x.columns else x.withColumn("limits", F.lit(None).cast("array<bigint>")) for x in (left, right))
        return left.select(*columns, F.lit(1).alias("kind")).unionByName(right.select(*columns, F.lit(0).alias("kind")))

    sizes = flat.groupBy("label", "dim").agg(F.count("*").alias("n"), F.count_if("anchor").alias("a")).where("a > 0")
    near = flat.join(sizes, ["label", "dim"])
    pairs = meet(near, near.where("anchor"), F.ceil(F.col("a") / held), blocks(F.col("n")))
    found = pairs.groupBy("label", "dim", "g", "h").applyInArrow(
        lambda key, t: best_positives(key, t, n_positives), "anchor bigint, id bigint, score bigint"
    )
    positives = cut_lineage(_leading(found, ["anchor"], n_positives, "place"))

    limits = positives.groupBy(F.col("anchor").alias("id")).agg(F.sort_array(F.collect_set("score"), asc=False).alias("limits"))
    pairs = meet(flat, flat.where("anchor").join(limits, "id"), F.ceil(F.lit(max(total.a, 1)) / held), blocks(F.lit(total.n)))
    found = pairs.groupBy("dim", "g", "h").applyInArrow(
        lambda key, t: best_per_slot(key, t, k, share), "anchor bigint, slot bigint, id bigint, score bigint"
    )
    slots = _leading(found, ["anchor", "slot"], k, "place").groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("back"), "id"))).alias("slots")
    )
    # slots descend: of those at or below a positive's score the first k, cut at the lower end
    suffix = F.slice(F.filter("slots", lambda x: -x["back"] <= F.col("score")), 1, k)
    window = F.filter(suffix, lambda x: share[1] * -x["back"] >= share[0] * F.col("score"))
    mined = positives.join(slots, "anchor").select(
        F.col("anchor").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode(window).alias("at", "row")
    )
    return mined.select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("row.id").alias("negative_id"),
        "positive_score", (-F.col("row.back")).alias("negative_score"),
    )
