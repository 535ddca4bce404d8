"""All queries of the core and their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treillis.plans import nested, oracle, reference


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**reference.queries(), **nested.queries()}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
