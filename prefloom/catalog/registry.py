"""Named queries over the given tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.sources.derived import Inputs, duckdb_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(inputs) -> DataFrame`` under ``name`` with an optional check query."""

    def keep(build: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, path: build(Inputs(spark, path))
        if sql is not None:
            ORACLES[name] = duckdb_sql(sql)
        return build

    return keep


def big(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


def rounded(column: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def micros(column: Column | str) -> Column:
    return F.unix_micros(F.col(column) if isinstance(column, str) else column)
