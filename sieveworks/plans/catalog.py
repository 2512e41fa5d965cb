"""All core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sieveworks.plans import building, building_sql, corpus, exam, outputs, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for module in (exam, outputs, corpus, building) for f in module.QUERIES}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql() | building_sql.oracle_sql()
