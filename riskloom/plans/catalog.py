"""Registry of named queries: a callable (spark, sf_dir) and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is its counterpart on the same tables."""
    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(configure(spark), sf_dir)
        run.__name__ = name
        run.__doc__ = function.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


def load() -> None:
    """Import every module that registers queries."""
    from riskloom.plans import (  # noqa: F401
        business, evaluation, explanation, fairness, joins, models, policies, profile,
        scoring, sinks, streaming, validation,
    )
