"""Registry of the queries of the landscape operators and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from landweave.plans import oracles, queries as plans


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return plans.registry()


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in oracles.registry().items() if name in plans.registry()}
