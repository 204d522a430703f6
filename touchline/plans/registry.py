"""Registry of runnable queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.plans.standin import Tables, ansi

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register ``fn(tables)`` under ``name`` with an optional reference query."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = ansi(views, sql)
        return fn

    return register


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: fn(Tables(spark, folder))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)


def r6(value: Column | str) -> Column:
    """Round for comparison across engines; the nudge keeps exact ties from splitting."""
    col = F.col(value) if isinstance(value, str) else value
    return F.round(col + F.lit(1e-9), 6)


def rounded(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({name: r6(name) for name in columns})
