"""Collects the queries of the plan modules; each module fills QUERIES and ORACLES."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "k24_hybrid_retrieve"


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under a name, with its DuckDB twin where there is one."""

    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _load() -> None:
    from corpusloom.plans import analytics, evidence, further, governance, ingestion, policies, ranking, relations, retrieval, streams, structure  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
