"""Named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .domain import Domain, check_sql

QUERIES: dict[str, Callable[[Domain], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(domain) -> DataFrame`; `sql` gives the same rows under the same column names."""

    def add(fn: Callable[[Domain], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = check_sql(sql)
        return fn

    return add


def r6(column: str | Column) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def us(column: str | Column) -> Column:
    return F.unix_micros((F.col(column) if isinstance(column, str) else column).cast("timestamp"))


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def joined(column: str | Column) -> Column:
    """A list column as one comma text, null when the list is null."""
    return F.array_join(F.col(column) if isinstance(column, str) else column, ",")


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Domain(spark, sf_dir))

    return {name: bind(fn) for name, fn in QUERIES.items()}
