"""Mixing sources by temperature: token shares raised to an exponent, then drawn by budget.

A source with share ``p`` of all tokens gets weight ``p^a / sum p^a``.  The exponent is found by
bisection (several probes a step, each step one aggregation over the source table, so only
sums reach the driver): either the largest exponent of 0 .. 1 whose weights have the target
entropy, or the smallest at which no source is repeated more often than the limit.

Weights times ``budget`` are token budgets; without a given budget it is the least one that
uses every document.  Budgets are realised as permuted epochs: a source's documents are
hashed into blocks of about ``block_docs``; every epoch orders blocks, and documents inside
blocks, by a hash of its number.  Whole epochs take everything; the last one takes blocks,
and in its last block documents, in that order until the budget is reached.  Running totals
are taken over block sums and then inside blocks, so no task ever holds a source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundeval.llm.common import as_bytes, cut_lineage, fresh


def token_table(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``(id, text_hash, source, tokens)``, one row per distinct identifier, text and source;
    rows that repeat all three are one unit and add up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(as_bytes(t).split()) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64())], names=["id", "text_hash", "source", "tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    flat = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("text_hash"), F.col(source_col).cast("string").alias("source"), text.alias("text")
    )
    counted = flat.mapInArrow(count, "id bigint, text_hash bigint, source string, tokens bigint")
    return counted.groupBy("id", "text_hash", "source").agg(F.sum("tokens").alias("tokens"))


def find_exponent(shares: DataFrame, budget_share: float | None, entropy: float | None, max_repetition: float | None, steps: int = 12) -> float:
    """The exponent for ``shares(p)``, all positive.  ``entropy`` is a fraction of the largest
    possible one; ``budget_share`` is the budget over all tokens (None: the least that uses
    every document)."""
    span = shares.agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.count("*").alias("n")).first()
    if not span.n:
        return 1.0

    def good(a: float, z: float, e: float) -> bool:
        """Whether the exponent may be this large (entropy) or this small (repetition)."""
        if entropy is not None:
            return np.log(z) - a * e / z >= entropy * np.log(span.n) - 1e-12
        scale = budget_share / z if budget_share is not None else span.hi ** (1 - a)
        return scale * span.lo ** (a - 1) <= max_repetition + 1e-12

    lo, hi, probes = 0.0, 1.0, 16
    for _ in range(steps):
        at = [lo + (hi - lo) * i / probes for i in range(probes + 1)]
        sums = shares.agg(
            *[F.sum(F.pow("p", F.lit(a))).alias(f"z{i}") for i, a in enumerate(at)],
            *[F.sum(F.pow("p", F.lit(a)) * F.log("p")).alias(f"e{i}") for i, a in enumerate(at)],
        ).first()
        ok = [good(a, sums[f"z{i}"], sums[f"e{i}"]) for i, a in enumerate(at)]
        if entropy is not None:  # entropy falls as the exponent grows
            i = max((i for i in range(probes + 1) if ok[i]), default=0)
            lo, hi = at[i], at[min(i + 1, probes)]
        else:  # repetition falls as the exponent grows
            i = min((i for i in range(probes + 1) if ok[i]), default=probes)
            lo, hi = at[max(i - 1, 0)], at[i]
        if hi - lo <= 0:
            break
    return lo if entropy is not None else hi


def source_plan(units: DataFrame, budget: int | None, entropy: float | None, max_repetition: float | None) -> DataFrame:
    """``(source, docs, n_tokens, weight, repetition, epochs, rest)`` per source: how often
    its tokens are used, as whole epochs and the tokens of a last one."""
    sources = cut_lineage(units.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("n_tokens")))
    total = sources.agg(F.sum("n_tokens")).first()[0] or 0
    shares = sources.where("n_tokens > 0").select((F.col("n_tokens") / F.lit(float(max(total, 1)))).alias("p"))
    share = None if budget is None else budget / max(total, 1)
    a = find_exponent(shares, share, entropy, max_repetition)
    sums = shares.agg(F.sum(F.pow("p", F.lit(a))).alias("z"), F.min(F.pow("p", F.lit(a - 1))).alias("least")).first()
    z = sums.z or 1.0
    scale = share / z if share is not None else 1.0 / (sums.least or 1.0)
    p = F.col("n_tokens") / F.lit(float(max(total, 1)))
    # a source without tokens costs nothing and is used once
    times = F.when(F.col("n_tokens") > 0, F.pow(p, F.lit(a - 1)) * scale).otherwise(F.lit(1.0))
    times = F.when(F.abs(times - F.round(times)) < 1e-9, F.round(times)).otherwise(times)
    plan = sources.withColumn("weight", F.when(F.col("n_tokens") > 0, F.pow(p, F.lit(a)) / z).otherwise(F.lit(0.0))).withColumn("repetition", times)
    plan = plan.withColumn("epochs", F.floor("repetition"))
    return plan.withColumn("rest", F.floor((F.col("repetition") - F.col("epochs")) * F.col("n_tokens") + F.lit(1e-6)))


def draw_units(units: DataFrame, plan: DataFrame, block_docs: int, seed: int) -> DataFrame:
    """``units`` with ``block`` and ``copies``, the number of epochs each is in."""
    chosen = plan.select("source", "docs", "epochs", "rest").alias("p")
    dealt = units.alias("u").join(chosen, F.expr("u.source <=> p.source"))
    dealt = dealt.select("u.*", "docs", "epochs", "rest")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id", "text_hash", F.lit(seed)), F.ceil(F.col("docs") / block_docs)))
    dealt = dealt.withColumn("block_key", F.xxhash64("block", "epochs", F.lit(seed))).withColumn("doc_key", F.xxhash64("id", "text_hash", "epochs", F.lit(seed)))
    blocks = dealt.groupBy("source", "block", "block_key").agg(F.sum("tokens").alias("block_tokens"))
    before = Window.partitionBy("source").orderBy("block_key", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("block_tokens").over(before), F.lit(0)))
    inside = Window.partitionBy("source", "block").orderBy("doc_key", "id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumn("upto", F.sum("tokens").over(inside)).alias("d")
    cond = F.expr("d.source <=> b.source and d.block = b.block")
    dealt = dealt.join(blocks.select("source", "block", "before").alias("b"), cond).select("d.*", "before")
    last = ((F.col("tokens") > 0) & (F.col("before") + F.col("upto") <= F.col("rest"))).cast("int")
    return dealt.withColumn("copies", (F.col("epochs") + last).cast("int")).drop("docs", "epochs", "rest", "upto", "before", "block_key", "doc_key")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget: int | None = None,
    entropy: float | None = None,
    max_repetition: float | None = 2.0,
    block_docs: int = 10_000,
    seed: int = 11,
) -> DataFrame:
    """The drawn rows: all columns of ``docs``, then ``epoch`` (from 0), ``block``, ``n_tokens``
    (names lengthened if taken).  A row is in as many epochs as its source's budget reaches.

    Give ``entropy`` (0 .. 1, a fraction of the largest) or ``max_repetition``; entropy wins.
    A null source is a source of its own; null and empty texts have no tokens and are in the
    whole epochs only, never in a part of one; a source without tokens is used once.  Rows that repeat identifier, text and source move
    together.  One source, or limits that already hold, leave everything as it is.  An empty
    table gives an empty result.
    """
    units = cut_lineage(token_table(docs, id_col, text_col, source_col))
    drawn = draw_units(units, source_plan(units, budget, entropy, max_repetition), block_docs, seed)
    names = {c: fresh(docs, f"drawn_{c}") for c in ("id", "text_hash", "source")}
    epoch, block, n_tokens = fresh(docs, "epoch"), fresh(docs, "block"), fresh(docs, "n_tokens")
    drawn = drawn.where("copies > 0").withColumn(epoch, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    drawn = drawn.select(
        *[F.col(c).alias(n) for c, n in names.items()], epoch, F.col("block").alias(block), F.col("tokens").alias(n_tokens)
    )
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = fresh(docs, "text_hash")
    own = docs.withColumn(hashed, F.xxhash64(text))
    cond = (
        F.col(id_col).cast("bigint").eqNullSafe(F.col(names["id"]))
        & (F.col(hashed) == F.col(names["text_hash"]))
        & F.col(source_col).cast("string").eqNullSafe(F.col(names["source"]))
    )
    return own.join(drawn, cond).select(*docs.columns, epoch, block, n_tokens)
