"""Where queries and their SQL checks are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

# Report ranges. The first covers the whole log; the second, with the window before it, does too.
START, END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
LATE_START, LATE_END = "2024-01-16 00:00:00", "2024-01-31 00:00:00"


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``check`` is the equivalent SQL on the given tables."""
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn
    return keep


def stamp(column: str | Column) -> Column:
    """Timestamp as text, so that both engines publish the same value."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def stamp_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def within_sql(start: str = START, end: str = END) -> str:
    return f"created_at >= TIMESTAMP '{start}' AND created_at <= TIMESTAMP '{end}'"
