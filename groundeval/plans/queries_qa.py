"""Dataset adapter, provenance and builder-audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundeval.operators import provenance as PV
from groundeval.operators import qa as Q
from groundeval.plans import fixtures as fx
from groundeval.plans.catalog import register

NOPROV = "['empty n/a']"


# ------------------------------------------------------------------ simple adapters

@register("qa_canonical", "WITH " + fx.PAIRS_SQL + """
SELECT CAST(pair_id AS VARCHAR) AS id, question AS title, golds AS answers, [response] AS provenance,
       turn::BIGINT AS popularity
FROM pairs""", "B1")
def qa_canonical(spark, d):
    p = fx.pairs(spark, d)
    five = p.select(F.col("pair_id").cast("string"), "question", "golds", F.array("response"), F.col("turn").cast("long"))
    return Q.canonical_by_position(five)


@register("qa_open", "WITH " + fx.PAIRS_SQL + f"""
SELECT 'n/a' AS id, question AS title, [response] AS answers, {NOPROV} AS provenance FROM pairs""", "B2")
def qa_open(spark, d):
    p = fx.pairs(spark, d).select("question", F.array("response").alias("answer"))
    return Q.open_qa(p)


@register("qa_nested_aliases", "WITH " + fx.PAIRS_SQL + f"""
SELECT CAST(pair_id AS VARCHAR) AS id, question AS title, golds AS answers, {NOPROV} AS provenance FROM pairs""", "B3")
def qa_nested_aliases(spark, d):
    p = fx.pairs(spark, d).select(
        F.col("pair_id").alias("question_id"), "question", F.struct(F.col("golds").alias("aliases")).alias("answer")
    )
    return Q.nested_alias_qa(p)


@register("qa_multiple_choice", f"""
SELECT CAST(p_partkey AS VARCHAR) AS id,
       'Which item is ' || p_name || '?' || chr(10) || 'Options:' || chr(10) ||
       'A: ' || p_brand || chr(10) || 'B: ' || p_type || chr(10) || 'C: ' || p_name || chr(10) ||
       'D: ' || CAST(p_size AS VARCHAR) || chr(10) AS title,
       [(['A', 'B', 'C', 'D'])[p_partkey % 4 + 1]] AS answers, {NOPROV} AS provenance
FROM part""", "B4")
def qa_multiple_choice(spark, d):
    p = fx.table(spark, d, "part").select(
        F.col("p_partkey").alias("ordinal"),
        F.concat(F.lit("Which item is "), F.col("p_name"), F.lit("?")).alias("question"),
        F.struct(F.col("p_brand").alias("A"), F.col("p_type").alias("B"), F.col("p_name").alias("C"),
                 F.col("p_size").cast("string").alias("D")).alias("options"),
        F.element_at(F.array(*[F.lit(x) for x in Q.CHOICE_LETTERS]), (F.col("p_partkey") % 4 + 1).cast("int")).alias("answer_idx"),
    )
    return Q.multiple_choice_qa(p)


@register("qa_long_answer", "WITH " + fx.PAIRS_SQL + f"""
SELECT CAST(pair_id AS VARCHAR) AS id, question AS title, [response] AS answers, {NOPROV} AS provenance FROM pairs""", "B5")
def qa_long_answer(spark, d):
    p = fx.pairs(spark, d).select(F.col("pair_id").alias("ordinal"), F.col("question").alias("Question"), F.col("response").alias("Answer"))
    return Q.long_answer_qa(p)


@register("qa_entailment", f"""
SELECT CAST(item_id AS VARCHAR) AS id,
       'Premise: ' || text || chr(10) || 'Hypothesis: ' || 'The passage is item ' || CAST(item_id AS VARCHAR) AS title,
       [CASE WHEN item_id % 2 = 0 THEN 'Entailment' ELSE 'Contradiction' END] AS answers, {NOPROV} AS provenance
FROM benchmark""", "B6")
def qa_entailment(spark, d):
    b = fx.table(spark, d, "benchmark").select(
        F.col("item_id").alias("id"), "text",
        F.concat(F.lit("The passage is item "), F.col("item_id").cast("string")).alias("question"),
        F.when(F.col("item_id") % 2 == 0, F.lit("Entailment")).otherwise(F.lit("Contradiction")).alias("answer"),
    )
    return Q.entailment_qa(b)


def _multihop_rows(spark, d):
    doc = fx.table(spark, d, "documents")
    paras = F.split(F.col("text"), "\n")
    return doc.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("question"),
        F.col("source").alias("answer"),
        F.struct(F.array(F.concat(F.col("source"), F.lit("#"), (F.col("doc_id") % 7 + 1).cast("string")), F.lit("nomatch")).alias("title")).alias("supporting_facts"),
        F.struct(
            F.transform(paras, lambda p, i: F.concat(F.col("source"), F.lit("#"), i.cast("string"))).alias("title"),
            F.transform(paras, lambda p: F.split(p, "\\. ")).alias("sentences"),
        ).alias("context"),
    )


@register("qa_multihop_provenance", f"""
WITH m AS (
  SELECT doc_id, text AS question, source AS answer,
         [source || '#' || CAST(doc_id % 7 + 1 AS VARCHAR), 'nomatch'] AS sup,
         list_transform(string_split(text, chr(10)), lambda p, i: source || '#' || CAST(i - 1 AS VARCHAR)) AS ct,
         list_transform(string_split(text, chr(10)), lambda p: string_split(p, '. ')) AS sent
  FROM documents
),
k AS (SELECT *, list_filter(range(1, len(ct) + 1), lambda i: len(list_filter(sup, lambda t: contains(ct[i], t))) > 0) AS kept FROM m)
SELECT CAST(doc_id AS VARCHAR) AS id, question AS title, [answer] AS answers,
       [CASE WHEN len(kept) = 0 THEN 'empty n/a'
             ELSE array_to_string(list_transform(kept, lambda i: array_to_string(sent[i], ' ')), ' ') END] AS provenance
FROM k""", "B7")
def qa_multihop_provenance(spark, d):
    return Q.multihop_qa(_multihop_rows(spark, d))


@register("qa_code_task", """
SELECT page_id AS id, url AS title, html AS answers, length(html)::BIGINT AS meta, 'python' AS test FROM pages""", "B8")
def qa_code_task(spark, d):
    p = fx.table(spark, d, "pages").select("page_id", "url", "html", F.length("html").cast("long"), F.lit("python"))
    return Q.code_task_qa(p)


@register("qa_passthrough", "WITH " + fx.PAIRS_SQL + """
SELECT CAST(pair_id AS VARCHAR) AS id, question AS title, golds AS answers, [response] AS provenance FROM pairs""", "B9")
def qa_passthrough(spark, d):
    p = fx.pairs(spark, d).select(
        F.col("pair_id").alias("id"), F.col("question").alias("title"),
        F.struct(F.col("golds").alias("text")).alias("answers"), F.array("response").alias("provenance"),
    )
    return Q.passthrough_qa(p)


# ------------------------------------------------------------ biomedical test set (B10, C4, C5)

def _pubmed_items(spark, d):
    doc = fx.table(spark, d, "documents")
    return doc.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("text").alias("QUESTION"),
        F.split(F.col("text"), "\n").alias("CONTEXTS"),
        F.element_at(F.split(F.col("text"), "\n"), -1).alias("LONG_ANSWER"),
        F.when(F.col("doc_id") % 2 == 1, F.lit("yes")).otherwise(F.lit("no")).alias("final_decision"),
    )


def _truth(spark, d):
    lab = fx.table(spark, d, "labels")
    return lab.select(F.col("doc_id").cast("string").alias("id"),
                      F.when(F.col("quality") == 1, F.lit("yes")).otherwise(F.lit("no")).alias("label"))


_PUB_SQL = f"""
WITH items AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, text AS question, string_split(text, chr(10)) AS contexts,
         string_split(text, chr(10))[-1] AS long_answer,
         CASE WHEN doc_id % 2 = 1 THEN 'yes' ELSE 'no' END AS final_decision
  FROM documents
),
truth AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS label FROM labels)"""


@register("pubmed_test_set", _PUB_SQL + """
SELECT i.id, i.question AS title, [i.final_decision] AS answers, [array_to_string(i.contexts, ' ')] AS provenance,
       i.long_answer, t.label
FROM items i JOIN truth t ON i.id = t.id""", ("B10", "C4"))
def pubmed_test_set(spark, d):
    return Q.biomedical_qa(PV.held_out(_pubmed_items(spark, d), _truth(spark, d)))


@register("label_conflicts", _PUB_SQL + """
SELECT i.id, i.final_decision, t.label FROM items i JOIN truth t ON i.id = t.id
WHERE i.final_decision IS DISTINCT FROM t.label""", "C5")
def label_conflicts(spark, d):
    c = PV.label_conflicts(_pubmed_items(spark, d), _truth(spark, d))
    return c.select("id", "final_decision", "label")


# ------------------------------------------------------------------ KILT-style provenance

_PTR = T.StructType([
    T.StructField("wikipedia_id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("start_paragraph_id", T.IntegerType()), T.StructField("end_paragraph_id", T.IntegerType()),
    T.StructField("start_character", T.IntegerType()), T.StructField("end_character", T.IntegerType()),
])


def _kilt_raw(spark, d):
    """Every document as a KILT row with pointers to paragraphs of its own page and the next
    one (the last page has no next; paragraph numbers go past the end of short pages)."""
    b = fx.table(spark, d, "documents")
    i = F.col("doc_id")
    sc = F.when(i % 5 == 0, F.lit(None)).otherwise(i % 7).cast("int")
    par = (i % 4).cast("int")
    p1 = F.struct(
        i.cast("string").alias("wikipedia_id"),
        F.when(i % 7 == 0, F.lit("wrong title")).otherwise(F.col("source")).alias("title"),
        par.alias("start_paragraph_id"), F.when(i % 9 == 4, par + 1).otherwise(par).alias("end_paragraph_id"),
        sc.alias("start_character"), (sc + 20).alias("end_character"),
    ).cast(_PTR)
    p2 = F.struct(
        (i + 1).cast("string").alias("wikipedia_id"), F.col("source").alias("title"),
        F.lit(0).alias("start_paragraph_id"), F.lit(0).alias("end_paragraph_id"),
        F.lit(None).cast("int").alias("start_character"), F.lit(None).cast("int").alias("end_character"),
    ).cast(_PTR)
    item_t = T.StructType([T.StructField("answer", T.StringType()), T.StructField("provenance", T.ArrayType(_PTR))])
    a1, a2 = F.col("source"), F.concat(F.lit("Re: "), "source")
    full = F.array(
        F.struct(a1.alias("answer"), F.array(p1, p2).alias("provenance")).cast(item_t),
        F.struct(a2.alias("answer"), F.array().cast(T.ArrayType(_PTR)).alias("provenance")).cast(item_t),
        F.struct(F.lit(None).cast("string").alias("answer"), F.array(p2).alias("provenance")).cast(item_t),
    )
    bare = F.array(F.struct(a1.alias("answer"), F.lit(None).cast(T.ArrayType(_PTR)).alias("provenance")).cast(item_t))
    return b.select(i.cast("string").alias("id"), F.col("text").alias("input"),
                    F.when(i % 11 == 0, bare).otherwise(full).alias("output"))


def _pages(spark, d):
    doc = fx.table(spark, d, "documents")
    return doc.select(F.col("doc_id").alias("page_id"), F.col("source").alias("title"), F.split(F.col("text"), "\n").alias("text"))


def _slices(spark, d):
    return PV.slice_pointers(PV.explode_pointers(_kilt_raw(spark, d)), _pages(spark, d))


_KILT_SQL = """
WITH kilt AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, text AS input, doc_id AS item_id, source, source AS a1, 'Re: ' || source AS a2
  FROM documents
),
ptrs AS (
  SELECT id, 0 AS oi, 0 AS pi, id AS wikipedia_id,
         CASE WHEN item_id % 7 = 0 THEN 'wrong title' ELSE source END AS title,
         item_id % 4 AS spar, CASE WHEN item_id % 9 = 4 THEN item_id % 4 + 1 ELSE item_id % 4 END AS epar,
         CASE WHEN item_id % 5 = 0 THEN NULL ELSE item_id % 7 END AS sc,
         CASE WHEN item_id % 5 = 0 THEN NULL ELSE item_id % 7 + 20 END AS ec
  FROM kilt WHERE item_id % 11 <> 0
  UNION ALL
  SELECT id, oi, pi, CAST(item_id + 1 AS VARCHAR), source, 0, 0, NULL, NULL
  FROM kilt, (VALUES (0, 1), (2, 0)) v(oi, pi) WHERE item_id % 11 <> 0
),
pages AS (SELECT doc_id AS page_id, source AS page_title, string_split(text, chr(10)) AS ptext FROM documents),
sl AS (
  SELECT p.*, g.page_title,
         CASE WHEN g.page_id IS NULL THEN 'missing_page' WHEN spar <> epar THEN 'span_mismatch' ELSE 'ok' END AS status,
         CASE WHEN g.page_id IS NOT NULL AND spar = epar THEN
              CASE WHEN sc IS NOT NULL THEN substr(g.ptext[spar + 1], sc + 1, ec - sc) ELSE g.ptext[spar + 1] END END AS slice
  FROM ptrs p LEFT JOIN pages g ON CAST(p.wikipedia_id AS BIGINT) = g.page_id
)"""


@register("paragraph_slice", _KILT_SQL + """
SELECT id, oi::BIGINT AS oi, pi::BIGINT AS pi, wikipedia_id, status, slice FROM sl""", ("C1", "C2"))
def paragraph_slice(spark, d):
    s = _slices(spark, d)
    return s.select("id", F.col("oi").cast("long").alias("oi"), F.col("pi").cast("long").alias("pi"), "wikipedia_id", "status", "slice")


@register("title_mismatch_audit", _KILT_SQL + """
SELECT id, oi::BIGINT AS oi, pi::BIGINT AS pi, title, page_title FROM sl
WHERE status <> 'missing_page' AND title IS DISTINCT FROM page_title""", "C3")
def title_mismatch_audit(spark, d):
    s = PV.title_mismatches(_slices(spark, d))
    return s.select("id", F.col("oi").cast("long").alias("oi"), F.col("pi").cast("long").alias("pi"), "title", "page_title")


@register("kilt_provenance", _KILT_SQL + """,
per_item AS (SELECT id, oi, string_agg(slice, ' ' ORDER BY pi) AS joined FROM sl GROUP BY id, oi),
items AS (
  SELECT id, input, 0 AS oi, a1 AS answer, (item_id % 11 <> 0) AS has_prov FROM kilt
  UNION ALL SELECT id, input, 1, a2, TRUE FROM kilt WHERE item_id % 11 <> 0
  UNION ALL SELECT id, input, 2, NULL, TRUE FROM kilt WHERE item_id % 11 <> 0
),
m AS (
  SELECT i.id, i.input, i.oi, i.answer, CASE WHEN i.has_prov THEN coalesce(p.joined, '') END AS wiki
  FROM items i LEFT JOIN per_item p ON i.id = p.id AND i.oi = p.oi
),
r AS (
  SELECT id, input AS question,
         coalesce(list(answer ORDER BY oi) FILTER (WHERE answer IS NOT NULL), []) AS "references",
         coalesce(list(wiki ORDER BY oi) FILTER (WHERE wiki IS NOT NULL), []) AS wiki_references
  FROM m GROUP BY id, input
)
SELECT * FROM r WHERE len(wiki_references) > 0""", ("B11", "B12", "D1", "C1"))
def kilt_provenance(spark, d):
    raw = _kilt_raw(spark, d)
    return PV.assemble(raw, _slices(spark, d))


@register("ordinal_index", "WITH " + fx.QA_SQL + """
SELECT id, max(ordinal) AS idx FROM (
  SELECT CAST(CAST(id AS BIGINT) // 1000 AS VARCHAR) AS id, ordinal FROM qa
) GROUP BY id""", ("D11", "W1"))
def ordinal_index(spark, d):
    qa = fx.qa_table(spark, d).select((F.col("id").cast("long") / 1000).cast("long").cast("string").alias("id"), "ordinal")
    return Q.ordinal_index(qa)


@register("attach_by_position", """
WITH qa AS (SELECT (row_number() OVER (ORDER BY c_custkey) - 1)::BIGINT AS ordinal, CAST(c_custkey AS VARCHAR) AS id FROM customer),
m AS (SELECT o_orderkey::BIGINT AS ordinal, o_custkey AS popularity FROM orders)
SELECT coalesce(qa.ordinal, m.ordinal) AS ordinal, qa.id, m.popularity,
       (qa.id IS NOT NULL AND m.popularity IS NOT NULL) AS aligned
FROM qa FULL OUTER JOIN m ON qa.ordinal = m.ordinal""", "B13")
def attach_by_position(spark, d):
    """Customers as the QA rows, an order measure list by position: the list is longer
    than the table, so the surplus positions come out with ``aligned = false``."""
    from groundeval.operators.ordinal import dense_ordinal

    cust = fx.table(spark, d, "customer")
    qa = dense_ordinal(cust.select(F.col("c_custkey"), F.col("c_custkey").cast("string").alias("id")), [], ["c_custkey"]).drop("c_custkey")
    m = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("value"))
    return Q.attach_by_position(qa, m).select("ordinal", "id", "popularity", "aligned")
