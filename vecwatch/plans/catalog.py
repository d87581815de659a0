"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import registry, report_queries, stream_queries, table_queries, vector_queries  # noqa: F401  (registration)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return registry.spark_queries()


def checks() -> dict[str, str]:
    return dict(registry.CHECKS)
