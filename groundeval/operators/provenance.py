"""Provenance assembly for knowledge-grounded QA rows, and the builders' audits.

The per-pointer page lookup of the reference becomes equi-joins of all pointers with the
page table: a narrow (page id, title) join and a (page id, paragraph) join against the
referenced pages exploded to paragraphs, so no pointer carries a whole page.  Pointers
are then re-grouped per output item and per row with ordered ``collect_list``; each group
is bounded by the pointers / output items of one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_pointers(raw: DataFrame, id_col: str = "id") -> DataFrame:
    """``(id, oi, pi, wikipedia_id, title, start_paragraph_id, end_paragraph_id,
    start_character, end_character)`` for every provenance pointer of every output item."""
    items = raw.select(id_col, F.posexplode("output").alias("oi", "item"))
    return items.select(id_col, "oi", F.posexplode("item.provenance").alias("pi", "p")).select(id_col, "oi", "pi", "p.*")


def slice_pointers(pointers: DataFrame, pages: DataFrame) -> DataFrame:
    """Join pointers with pages and cut the paragraph (or its character span).

    Pages are first reduced to the referenced ids (semi-join), exploded to paragraphs and
    joined on ``(page_id, paragraph)``, so a pointer receives only its paragraph — never a
    copy of the whole page — and a page referenced by many pointers costs one paragraph per
    pointer.  A narrow ``(page_id, title)`` join tells a missing page from a missing
    paragraph and feeds the title audit.

    ``status``: ok, missing_page (no page with that id), span_mismatch (start and end
    paragraph differ).  ``slice`` is null unless ok (and when the paragraph is absent)."""
    p = pointers.withColumn("_pid", F.col("wikipedia_id").cast("long"))
    wanted = pages.join(p.select(F.col("_pid").alias("page_id")).distinct(), "page_id", "left_semi")
    titles = wanted.select(F.col("page_id").alias("_tid"), F.col("title").alias("page_title"))
    paras = wanted.select(F.col("page_id").alias("_ppid"), F.posexplode("text").alias("_par", "_para"))
    j = p.join(titles, F.col("_pid") == F.col("_tid"), "left").join(
        paras, (F.col("_pid") == F.col("_ppid")) & (F.col("start_paragraph_id") == F.col("_par")), "left"
    )
    para = F.col("_para")
    cut = F.when(
        F.col("start_character").isNotNull(),
        F.substr(para, F.col("start_character") + 1, F.col("end_character") - F.col("start_character")),
    ).otherwise(para)
    status = (
        F.when(F.col("_tid").isNull(), F.lit("missing_page"))
        .when(F.col("start_paragraph_id") != F.col("end_paragraph_id"), F.lit("span_mismatch"))
        .otherwise(F.lit("ok"))
    )
    return (
        j.withColumn("status", status)
        .withColumn("slice", F.when(status == "ok", cut))
        .drop("_pid", "_tid", "_ppid", "_par", "_para")
    )


def assemble(raw: DataFrame, slices: DataFrame, id_col: str = "id", question_col: str = "input") -> DataFrame:
    """``id, question, references, wiki_references`` with rows without provenance dropped.

    An output item contributes one provenance string (its slices joined by a space, in
    pointer order; an empty pointer list gives '') when it has a provenance list, and one
    reference when it has an answer."""
    per_item_slices = (
        slices.groupBy(id_col, "oi")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pi", "slice"))), lambda s: s["slice"]), " ").alias("joined"))
    )
    items = raw.select(id_col, question_col, F.posexplode("output").alias("oi", "item")).select(
        id_col, question_col, "oi", F.col("item.answer").alias("answer"), F.col("item.provenance").alias("prov")
    )
    merged = items.join(per_item_slices, [id_col, "oi"], "left").select(
        id_col, question_col, "oi", "answer",
        F.when(F.col("prov").isNotNull(), F.coalesce("joined", F.lit(""))).alias("wiki"),
    )
    rows = merged.groupBy(id_col, question_col).agg(
        F.array_sort(F.collect_list(F.when(F.col("answer").isNotNull(), F.struct("oi", "answer")))).alias("_a"),
        F.array_sort(F.collect_list(F.when(F.col("wiki").isNotNull(), F.struct("oi", "wiki")))).alias("_w"),
    )
    out = rows.select(
        id_col, F.col(question_col).alias("question"),
        F.transform("_a", lambda s: s["answer"]).alias("references"),
        F.transform("_w", lambda s: s["wiki"]).alias("wiki_references"),
    )
    return out.where(F.size("wiki_references") > 0)


def title_mismatches(slices: DataFrame) -> DataFrame:
    """Pointers whose title differs from the page's title (rows are kept, this only reports)."""
    return slices.where((F.col("status") != "missing_page") & ~F.col("title").eqNullSafe(F.col("page_title")))


def label_conflicts(items: DataFrame, truth: DataFrame, id_col="id", label="final_decision", truth_label="label") -> DataFrame:
    """Held-out rows whose recorded label differs from the ground truth."""
    return items.join(truth, id_col).where(~F.col(label).eqNullSafe(F.col(truth_label)))


def held_out(items: DataFrame, truth: DataFrame, id_col="id") -> DataFrame:
    """Rows present in the ground-truth id set (inner equi-join carries the label along)."""
    return items.join(truth, id_col)
