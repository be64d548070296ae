"""Every registered query runs on sf0.001 and matches its DuckDB oracle there; those whose
result could depend on how rows are dealt run on sf0.01 too."""

import math

import duckdb
import pytest

from groundeval.plans.catalog import load_all
from groundeval.plans.fixtures import TABLES

from conftest import SF001, SF01

REG = load_all()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "asDict"):
        return _norm(tuple(v))
    return repr(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def ducks():
    out = {}
    for sf in (SF001, SF01):
        out[sf] = duckdb.connect()
        for t in TABLES:
            out[sf].execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return out


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() >= 0 and "overlap" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())


DEALT = ["attach_by_position", "popularity_set", "read_indexed_csv", "ordinal_index", "run_expand", "stratified_sample", "quip_chains"]


@pytest.mark.parametrize("sf,name", [(SF001, n) for n in sorted(REG)] + [(SF01, n) for n in DEALT])
def test_query_matches_oracle(spark, ducks, sf, name):
    q = REG[name]
    df = q.build(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    assert q.sql is not None
    cur = ducks[sf].execute(q.sql)
    ocols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, rows) == _rows(ocols, cur.fetchall())
