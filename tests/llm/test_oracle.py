"""Queries with SQL match DuckDB on the given tables; every query's columns are as agreed."""

import duckdb
import pytest

from groundeval.llm.queries import ORACLE, QUERIES

from .conftest import SF001

COLUMNS = {
    "op2_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op3_lm_score": {
        "doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint",
        "train_tokens": "bigint", "base_score": "double", "score": "double",
    },
    "op4_packing": {
        "doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint",
        "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint",
    },
    "op5_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op7_lang_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_ann": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op9_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_chat_format": {
        "conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint",
        "loss_sha256": "string", "formatted_chars": "bigint",
    },
    "op11_periodic_runs": {
        "doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint",
        "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string",
    },
    "op12_hard_negatives": {
        "anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint",
        "positive_score": "bigint", "negative_score": "bigint",
    },
    "op13_sharding": {
        "doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int",
    },
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = QUERIES[name](spark, SF001)
    cur = con.execute(ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(cur.fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    kinds = dict(QUERIES[name](spark, SF001).dtypes)
    assert {c: kinds[c] for c in COLUMNS[name]} == COLUMNS[name]


def test_every_operator_has_a_query_and_the_pipeline():
    import __spark_entry__ as entry

    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op"))
    assert numbers == list(range(1, 14))
    assert "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
