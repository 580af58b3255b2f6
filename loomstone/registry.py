"""Where queries are registered, with the SQL that says the same for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans.binding import Frames, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers f(frames) as a query, with its SQL over tables and views."""

    def put(f: Callable[[Frames], DataFrame]) -> Callable[[Frames], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Frames(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return put
