"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palisade.plans import queries_decide, queries_packages, queries_stores, queries_tables

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which artifacts would be blocked or quarantined, and why."""
    return queries_packages.QUERIES["package_verdicts"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return queries_packages.QUERIES | queries_decide.QUERIES | queries_stores.QUERIES | queries_tables.QUERIES


def oracle_sql() -> dict[str, str]:
    return queries_packages.SQL | queries_decide.SQL | queries_stores.SQL | queries_tables.SQL
