"""Overlap (QUIP) queries: benchmark items are the probe texts, documents the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundeval.operators import overlap as ov
from groundeval.operators import sketch as sk
from groundeval.plans import fixtures as fx
from groundeval.plans.catalog import register

# DuckDB has no lookahead, so the oracle cuts grams with substr over a position range.
_PG = """
pg AS (
  SELECT item_id, pos, substr(text, pos + 1, 25) AS gram
  FROM (SELECT item_id, text, unnest(range(0, greatest(length(text) - 24, 0))) AS pos FROM benchmark)
)"""


def _cg(table: str, where: str = "TRUE") -> str:
    return f"""
cg AS (
  SELECT DISTINCT gram FROM (
    SELECT substr(text, pos + 1, 25) AS gram
    FROM (SELECT text, unnest(range(0, greatest(length(text) - 24, 0))) AS pos FROM {table} WHERE {where})
  ) WHERE gram IN (SELECT gram FROM pg)
)"""


_HITS = """
hits AS (
  SELECT pg.item_id, pg.pos, pg.gram, (cg.gram IS NOT NULL) AS is_member
  FROM pg LEFT JOIN cg ON pg.gram = cg.gram
)"""


def _probe(spark, d):
    return fx.table(spark, d, "benchmark").select("item_id", "text")


def _members(spark, d):
    return ov.members(_probe(spark, d), fx.corpus(spark, d), id_col="item_id")


QUIP_OVERLAP_SQL = "WITH " + _PG + "," + _cg("documents") + "," + _HITS + """
SELECT b.item_id,
       coalesce(s.segments, 0)::BIGINT AS segments,
       coalesce(s.hits, 0)::BIGINT AS hits,
       CASE WHEN coalesce(s.segments, 0) = 0 THEN 0.0 ELSE s.hits / s.segments END AS overlap
FROM benchmark b LEFT JOIN (
  SELECT item_id, count(*) AS segments, sum(is_member::INT) AS hits FROM hits GROUP BY item_id
) s ON b.item_id = s.item_id
"""


@register("quip_overlap", QUIP_OVERLAP_SQL, ("C13", "E4", "S10"))
def quip_overlap(spark, d):
    return ov.quip_overlap(_probe(spark, d), fx.corpus(spark, d), id_col="item_id")


@register(
    "quip_mean",
    "WITH ov AS (" + QUIP_OVERLAP_SQL + """)
SELECT round(avg(overlap), 9) AS avg_percent_overlap, count(*)::BIGINT AS n_texts FROM ov""",
    ("E4",),
)
def quip_mean(spark, d):
    m = ov.quip_mean(quip_overlap(spark, d))
    return m.select(F.round("avg_percent_overlap", 9).alias("avg_percent_overlap"), "n_texts")


@register("char_ngrams", "WITH " + _PG + " SELECT item_id, pos::BIGINT AS pos, gram FROM pg", ("S10",))
def char_ngrams(spark, d):
    g = ov.text_ngrams(_probe(spark, d), "item_id", "text")
    return g.select("item_id", F.col("pos").cast("long").alias("pos"), "gram")


@register(
    "matched_segments",
    "WITH " + _PG + "," + _cg("documents") + "," + _HITS + """
SELECT h.item_id, h.pos::BIGINT AS pos,
       list_transform(range(0, least(25, greatest(length(b.text) - 24, 0) - h.pos)),
                      lambda j: substr(b.text, h.pos + j + 1, 25)) AS segments
FROM hits h JOIN benchmark b ON h.item_id = b.item_id
WHERE h.is_member""",
    ("S11",),
)
def matched_segments(spark, d):
    m = ov.matched_segments(_probe(spark, d), _members(spark, d), id_col="item_id")
    return m.select("item_id", F.col("pos").cast("long").alias("pos"), "segments")


@register(
    "quip_chains",
    "WITH " + _PG + "," + _cg("documents") + "," + _HITS + """,
isl AS (
  SELECT item_id, pos, pos - row_number() OVER (PARTITION BY item_id ORDER BY pos) AS island
  FROM hits WHERE is_member
),
ch AS (
  SELECT item_id, min(pos) AS start_pos, max(pos) AS end_pos FROM isl GROUP BY item_id, island
)
SELECT item_id,
       row_number() OVER (PARTITION BY item_id ORDER BY end_pos - start_pos DESC, start_pos)::BIGINT AS chain_rank,
       start_pos::BIGINT AS start_pos, end_pos::BIGINT AS end_pos,
       (end_pos - start_pos + 1)::BIGINT AS n_grams, (end_pos - start_pos + 25)::BIGINT AS n_chars
FROM ch""",
    ("W3",),
)
def quip_chains(spark, d):
    c = ov.quip_chains(_members(spark, d), id_col="item_id")
    return c.select(
        "item_id", "chain_rank",
        F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"),
        "n_grams", "n_chars",
    )


@register(
    "sketch_exact",
    """SELECT DISTINCT substr(text, pos + 1, 25) AS gram
FROM (SELECT text, unnest(range(0, greatest(length(text) - 24, 0))) AS pos FROM documents)""",
    ("E14",),
)
def sketch_exact(spark, d):
    return ov.gram_set(fx.corpus(spark, d))


def _bloom(spark, d):
    """Sketch sized from the stored character counts (an upper bound on the windows), so
    sizing reads one integer column instead of the texts."""
    docs = fx.table(spark, d, "documents")
    n = docs.agg(F.sum("n_chars").alias("n")).first()["n"] or 0
    m = sk.bits_for(int(n))
    return sk.bloom_sketch(docs.select("doc_id", "text"), m_bits=m), m


@register("bloom_contract", "WITH q AS (" + QUIP_OVERLAP_SQL + """)
SELECT item_id, segments, hits AS exact_hits, TRUE AS none_missed, TRUE AS few_false FROM q""", ("C13", "E14"))
def bloom_contract(spark, d):
    """Per item: exact hits, that the sketch misses none of them, and that its false
    positives stay within five standard deviations of the filter's 1 % rate."""
    probe = _probe(spark, d)
    sketch, m = _bloom(spark, d)
    approx = sk.bloom_overlap(probe, sketch, m_bits=m, id_col="item_id")
    j = quip_overlap(spark, d).join(approx.select("item_id", F.col("hits").alias("bloom_hits")), "item_id")
    false, rest = F.col("bloom_hits") - F.col("hits"), F.col("segments") - F.col("hits")
    return j.select("item_id", "segments", F.col("hits").alias("exact_hits"), (false >= 0).alias("none_missed"),
                    (false <= 0.01 * rest + 5 * F.sqrt(0.01 * rest) + 1).alias("few_false"))


@register("sketch_merge", "WITH q AS (" + QUIP_OVERLAP_SQL + """)
SELECT item_id, segments, hits AS exact_hits, TRUE AS none_missed, TRUE AS same_as_whole, 0::BIGINT AS words_that_differ FROM q""", ("E14", "C13"))
def sketch_merge(spark, d):
    """Sketches of two halves of the corpus, each stored by word range, read back and merged:
    every word equals the whole corpus's sketch, and so does every lookup."""
    import uuid

    from groundeval.session import checkpoint_dir

    docs = fx.table(spark, d, "documents")
    m = sk.bits_for(int(docs.agg(F.sum("n_chars")).first()[0] or 0))
    base = f"{checkpoint_dir(spark)}/sketch-{uuid.uuid4().hex}"
    for half in (0, 1):
        sk.write_sketch(sk.bloom_sketch(docs.where(F.col("doc_id") % 2 == half).select("text"), m_bits=m), f"{base}/{half}")
    sk.write_sketch(sk.bloom_sketch(docs.select("text"), m_bits=m), f"{base}/whole")
    merged, whole = sk.merge_sketches(*[spark.read.parquet(f"{base}/{h}") for h in (0, 1)]), spark.read.parquet(f"{base}/whole")
    differ = merged.join(whole.select("word", F.col("bits").alias("b")), "word", "full").where(~F.col("bits").eqNullSafe(F.col("b"))).count()
    hits = lambda s, name: sk.bloom_overlap(_probe(spark, d), s, id_col="item_id").select("item_id", F.col("hits").alias(name))
    j = quip_overlap(spark, d).join(hits(merged, "m"), "item_id").join(hits(whole, "w"), "item_id")
    return j.select("item_id", "segments", F.col("hits").alias("exact_hits"), (F.col("m") >= F.col("hits")).alias("none_missed"),
                    (F.col("m") == F.col("w")).alias("same_as_whole"), F.lit(differ).cast("long").alias("words_that_differ"))


_STRIDE = 5


@register("quip_overlap_stride", "WITH " + _PG + f""",
cg AS (
  SELECT DISTINCT gram FROM (
    SELECT substr(text, pos + 1, 25) AS gram
    FROM (SELECT text, unnest(range(0, greatest(length(text) - 24, 0), {_STRIDE})) AS pos FROM documents)
  ) WHERE gram IN (SELECT gram FROM pg)
),
m AS (SELECT DISTINCT pg.item_id, pg.pos FROM pg JOIN cg ON pg.gram = cg.gram),
b AS (SELECT a.item_id, unnest(range(a.pos + 1, a.pos + {_STRIDE})) AS pos
      FROM m a JOIN m z ON a.item_id = z.item_id AND z.pos = a.pos + {_STRIDE}),
u AS (SELECT * FROM m UNION SELECT * FROM b),
n AS (SELECT item_id, count(*) AS hits FROM u GROUP BY item_id)
SELECT t.item_id, greatest(length(t.text) - 24, 0)::BIGINT AS segments, coalesce(n.hits, 0)::BIGINT AS hits,
       CASE WHEN length(t.text) < 25 THEN 0.0 ELSE coalesce(n.hits, 0) / (length(t.text) - 24) END AS overlap
FROM benchmark t LEFT JOIN n ON t.item_id = n.item_id
""", ("W3", "E4", "C13"))
def quip_overlap_stride(spark, d):
    """Every fifth corpus position stored, members between two hits five apart inferred."""
    return ov.quip_overlap(_probe(spark, d), fx.corpus(spark, d), id_col="item_id", stride=_STRIDE)
