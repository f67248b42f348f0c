"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import registry
from . import report_queries, source_queries, stream_queries, text_queries, trace_queries  # noqa: F401


def _session_ready(fn):
    """Call logs are read in UTC, whatever zone the session was started with."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, folder.rstrip("/"))
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _session_ready(fn) for name, fn in registry.QUERIES.items()}


def checks() -> dict[str, str]:
    return dict(registry.CHECKS)
