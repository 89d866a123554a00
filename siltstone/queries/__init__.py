"""Registered queries, and the SQL that gives the same rows where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.queries import answer_queries, ledger_queries, prep_queries, retrieval_queries, sql_queries, text_queries

MODULES = (answer_queries, ledger_queries, prep_queries, retrieval_queries, sql_queries, text_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
