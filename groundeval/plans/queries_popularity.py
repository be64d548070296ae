"""Popularity queries over ``orders`` (popularity derived by o_orderkey % 6, see FIXTURES)."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundeval.operators import popularity as PO
from groundeval.plans import fixtures as fx
from groundeval.plans.catalog import register


def popularity_table(spark, d):
    o = fx.table(spark, d, "orders")
    k = F.col("o_orderkey")
    r = k % 6
    pop = (
        F.when(r == 0, F.lit(0)).when(r == 1, F.lit(1)).when(r == 2, 2 + k % 9)
        .when(r == 3, 11 + k % 90).when(r == 4, 101 + k % 900).otherwise(1001 + k % 12000)
    )
    return o.select(k.alias("id"), pop.cast("long").alias("popularity"), F.col("o_custkey"))


POP_SQL = """
pop AS (
  SELECT o_orderkey AS id, o_custkey,
         (CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 + o_orderkey % 9 WHEN 3 THEN 11 + o_orderkey % 90
               WHEN 4 THEN 101 + o_orderkey % 900 ELSE 1001 + o_orderkey % 12000 END)::BIGINT AS popularity
  FROM orders
)"""


def _case_sql(bins, what: str) -> str:
    parts = []
    for i, (lo, hi) in enumerate(bins):
        val = str(i) if what == "id" else f"'({lo}, {hi}]'"
        parts.append(f"WHEN popularity > {lo} AND popularity <= {hi} THEN {val}")
    return "CASE " + " ".join(parts) + " END"


@register("popularity_bins", "WITH " + POP_SQL + f"""
SELECT id, popularity, {_case_sql(PO.SAMPLING_BINS, 'label')} AS sampling_bin, {_case_sql(PO.PLOTTING_BINS, 'label')} AS plotting_bin
FROM pop""", ("S18", "D6"))
def popularity_bins(spark, d):
    p = popularity_table(spark, d)
    return p.select("id", "popularity", PO.bin_label("popularity", PO.SAMPLING_BINS).alias("sampling_bin"),
                    PO.bin_label("popularity", PO.PLOTTING_BINS).alias("plotting_bin"))


_SAMPLE_SQL = "WITH " + POP_SQL + f""",
b AS (SELECT *, {_case_sql(PO.SAMPLING_BINS, 'id')} AS bin_id, {_case_sql(PO.SAMPLING_BINS, 'label')} AS bin FROM pop),
s AS (
  SELECT *, row_number() OVER (PARTITION BY bin_id ORDER BY md5(CAST(id AS VARCHAR) || '{PO.SAMPLE_SEED}'), id) AS rn
  FROM b WHERE bin_id IS NOT NULL
)"""


def _sample(spark, d):
    return PO.stratified_sample(PO.bin_rows(popularity_table(spark, d)))


@register("stratified_sample", _SAMPLE_SQL + f"""
SELECT id, popularity, bin, rn::BIGINT AS rn FROM s WHERE rn <= {PO.SAMPLE_CAP}""", ("E8", "W2"))
def stratified_sample(spark, d):
    return _sample(spark, d).select("id", "popularity", "bin", F.col("rn").cast("long").alias("rn"))


@register("popularity_set", _SAMPLE_SQL + f"""
SELECT (row_number() OVER (ORDER BY bin_id, rn) - 1)::BIGINT AS id, CAST(id AS VARCHAR) AS title,
       [CAST(o_custkey AS VARCHAR)] AS answers, '' AS provenance, popularity::INT AS popularity
FROM s WHERE rn <= {PO.SAMPLE_CAP}""", "B14")
def popularity_set(spark, d):
    return PO.popularity_set(_splits(spark, d), key="qid", title="qid", answers=F.array(F.col("o_custkey").cast("string")))


def _splits(spark, d):
    """Orders as a train and a dev split (even and odd keys)."""
    p = popularity_table(spark, d).withColumnRenamed("id", "qid")
    return [p.where(F.col("qid") % 2 == 0), p.where(F.col("qid") % 2 == 1)]


@register("popularity_set_trivia", _SAMPLE_SQL + f"""
SELECT 'q' || CAST(id AS VARCHAR) AS id, CAST(id AS VARCHAR) AS title, [CAST(o_custkey AS VARCHAR), 'alias'] AS answers,
       '' AS provenance, popularity::INT AS popularity
FROM s WHERE rn <= {PO.SAMPLE_CAP}""", "B14")
def popularity_set_trivia(spark, d):
    """The nested-alias shape, with the questions' own ids."""
    shaped = [
        s.withColumn("question_id", F.concat(F.lit("q"), F.col("qid").cast("string")))
        .withColumn("answer", F.struct(F.array(F.col("o_custkey").cast("string"), F.lit("alias")).alias("aliases")))
        for s in _splits(spark, d)
    ]
    return PO.popularity_set(shaped, key="qid", title="qid", answers=F.col("answer.aliases"), id_col="question_id")


@register("popularity_curve", "WITH " + POP_SQL + f""",
sc AS (SELECT l_orderkey AS id, l_discount AS score FROM lineitem),
j AS (SELECT p.id, {_case_sql(PO.PLOTTING_BINS, 'label')} AS bin, sc.score FROM pop p JOIN sc ON p.id = sc.id)
SELECT bin, count(*)::BIGINT AS n, round(avg(score), 9) AS mean, round(stddev_samp(score) / sqrt(count(*)), 9) AS se
FROM j WHERE bin IS NOT NULL GROUP BY bin""", ("E7", "C10"))
def popularity_curve(spark, d):
    p = PO.bin_rows(popularity_table(spark, d), bins=PO.PLOTTING_BINS)
    sc = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_discount").alias("score"))
    c = PO.curve(p.join(sc, "id"), "bin", "score")
    return c.select("bin", F.col("n").cast("long"), F.round("mean", 9).alias("mean"), F.round("se", 9).alias("se"))
