"""The table of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracehold.session import plain_times, prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL its result is compared with where SQL can say it."""
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain_times(f(prepare(spark), sf_dir))
        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return f
    return add
