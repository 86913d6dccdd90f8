"""All queries of the ledger library by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit_queries, entity_queries, kpi_queries, record_queries, rule_queries, served_queries, source_queries

_MODULES = (rule_queries, audit_queries, kpi_queries, entity_queries, record_queries, served_queries, source_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.SQL.items()}
