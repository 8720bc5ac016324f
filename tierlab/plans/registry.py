"""All queries of the policy-analytics operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its twin."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


from . import policy_queries, stat_queries, stream_queries, table_queries, text_queries  # noqa: E402,F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["calibrate_fixed"](spark, sf_dir)
