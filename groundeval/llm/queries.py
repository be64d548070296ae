"""The ``opN_<name>`` queries: each applies its operator to its whole table.

``QUERIES`` maps names to ``fn(spark, sf_dir) -> DataFrame``; ``ORACLE`` holds DuckDB SQL where
SQL can express the result (the others are tested in ``tests/llm``: against brute force, by exact
round trips, held-out accuracy or, for 9, by behaviour).
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundeval.llm import (
    ann,
    chat_format,
    exact_dedup,
    hard_negatives,
    lang_id,
    lm_score,
    mixing,
    order_minhash,
    packing,
    periodic_runs,
    sharding,
    substring_dedup,
    toxicity,
)
from groundeval.llm.common import in_fold, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn

    return deco


EXACT_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


@query("op2_exact_dedup", EXACT_SQL)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before, lead(role) OVER w AS after FROM t
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
f AS (SELECT *,
        CASE WHEN before IS NULL OR before <> role
             THEN 13 + length(replace(replace(replace(role, '\', '\e'), '<', '\l'), '[', '\b')) ELSE 6 END
        + length(replace(replace(replace(text, '\', '\e'), '<', '\l'), '[', '\b'))
        + CASE WHEN after IS NOT NULL AND after = role THEN 0 WHEN role = 'assistant' THEN 5 ELSE 7 END AS chars
      FROM o)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (7 + sum(chars))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""


@query("op10_chat_format", CHAT_SQL)
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return chat_format.read_back(chat_format.format_chats(turns.unionByName(extra)))


@query("op7_lang_id")
def op7_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = in_fold("doc_id", 4, 2)
    out = lang_id.identify(docs, ~held)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = in_fold("doc_id", 3, 1)
    out = toxicity.toxicity(docs, labels, ~held)
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


@query("op3_lm_score")
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = in_fold("doc_id", 7, 2)
    out = lm_score.lm_score(docs, ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, s, array_to_string(words[s:s + 49], ' ') AS span
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM d)),
m AS (SELECT span, min(doc_id) AS first FROM w GROUP BY span HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, list(s) AS starts FROM w JOIN m USING (span) WHERE first < doc_id GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(flatten(list_transform(starts, lambda s: range(s, s + 50)))) AS i FROM hit),
x AS (SELECT doc_id, i, word FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d)),
k AS (SELECT x.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY x.i) AS kept
      FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i WHERE gone.i IS NULL GROUP BY x.doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


@query("op5_substring_dedup", REPEATS_SQL)
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op8_ann")
def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query("op1_near_dedup")
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_classes(table(spark, sf_dir, "documents"))


@query("op6_mixing")
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mix(table(spark, sf_dir, "documents"), max_repetition=2.0)
    return drawn.select("doc_id", "source", "epoch", "block", "n_tokens")


#: crc32 of the bytes in list ``{0}``: one step takes a byte in, eight more shift its bits out.
CRC_SQL = """xor(4294967295, list_reduce(flatten(list_transform({0}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, 4294967295::BIGINT))"""

RUNS_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o,
             {CRC_SQL.format("list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i, 1))::BIGINT)")} AS h
           FROM documents),
c AS (SELECT doc_id, o, len(o) AS n, h % 10 = 0 AND len(o) > 0 AS tiled, (h // 10) % greatest(len(o), 1) AS a, 3 + (h // 10) % 8 AS parts FROM d),
w AS (SELECT doc_id, n, CASE WHEN tiled THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN o[i + 1]
             ELSE o[a + (i - a) % (1 + (n - a) // parts) + 1] END) ELSE o END AS words FROM c),
x AS (SELECT doc_id, n, unnest(words) AS word, unnest(range(0, n)) AS i FROM w),
m AS (SELECT y.doc_id, y.i, y.i - z.i AS q FROM x y JOIN x z ON y.doc_id = z.doc_id AND y.word = z.word AND z.i < y.i AND 3 * (y.i - z.i) <= y.n),
s AS (SELECT doc_id, q, min(i) - q AS start, count(*) + q AS length
      FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m)
      GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.doc_id = s.doc_id AND t.q < s.q
        AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS runs FROM r GROUP BY doc_id),
t AS (SELECT DISTINCT ON (doc_id) doc_id, start, length, q FROM r ORDER BY doc_id, length / q DESC, start, q),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
k AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS kept FROM x LEFT JOIN gone USING (doc_id, i) WHERE gone.i IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, coalesce(b.n_runs, 0)::BIGINT AS n_runs, t.start::BIGINT AS start, t.length::BIGINT AS length, t.q::BIGINT AS period,
       (1000 * t.length // t.q)::BIGINT AS exponent_milli, sha256(coalesce(b.runs, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def tiled_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that ``op11`` looks at: by the identifier's crc32 every tenth document, from a
    place on, repeats the words that stand there."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * (1 + (n - a) // p))[: n - a]


@query("op11_periodic_runs", RUNS_SQL)
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.find_runs(table(spark, sf_dir, "documents"), rewrite=tiled_words)
    line = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.col("n_runs") > 0, "\n").otherwise(""))
    return out.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


NEGATIVES_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same,
        list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i]))::BIGINT AS score
      FROM e a JOIN e r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5
"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("bigint")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.hard_negatives(rows, F.col("id") % 100 == 0)


SHARDS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce('=' || source, '') AS source FROM documents),
k AS (SELECT doc_id, source, strlen(text) + 8 AS size, {CRC_SQL.format("list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)")} AS crc,
        md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(text) || '|' || source) AS key FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY key) - 1 AS nth FROM k),
u AS (SELECT doc_id, source, size, crc, CASE WHEN nth = 0 THEN key ELSE md5(key || '|' || nth) END AS key FROM o),
f AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY key) - 1 + ('0x' || substr(md5('17|' || source), 1, 8))::BIGINT / 4294967296)
             / count(*) OVER (PARTITION BY source) AS frac FROM u),
p AS (SELECT *, row_number() OVER (ORDER BY frac, source, key) - 1 AS place, count(*) OVER () AS n FROM f),
z AS (SELECT *, place * 24 // n AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard, (place - (shard * n + 23) // 24)::BIGINT AS slot,
       NULL::INTEGER AS grown_shard FROM z
"""


@query("op13_sharding", SHARDS_SQL)
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), n_shards=24)
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return out.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)
