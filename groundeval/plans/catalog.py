"""Registry of named queries: each is a Spark builder ``fn(spark, sf_dir) -> DataFrame`` and,
where the result is expressible in SQL, the equivalent DuckDB query over the same tables.

Doubles that come out of sums or averages are rounded to 9 digits on both sides (the
summation order differs between engines); ratios of two integers are left exact.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    survey_ids: tuple[str, ...] = ()


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, ids: tuple[str, ...] | str = ()):
    ids = (ids,) if isinstance(ids, str) else tuple(ids)

    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql.strip() if sql else None, ids)
        return fn

    return deco


def load_all() -> dict[str, Query]:
    """Import every query module so that its ``@register`` calls run."""
    from groundeval.plans import (  # noqa: F401
        queries_overlap,
        queries_metrics,
        queries_grid,
        queries_qa,
        queries_popularity,
        queries_reports,
        queries_generate,
        queries_sources,
    )

    return REGISTRY
