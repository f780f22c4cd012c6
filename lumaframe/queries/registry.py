"""query(): registers a function of (view) as a query, with DuckDB SQL over the same views if there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumaframe import reskin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
View = Callable[[str], DataFrame]


def query(views: str = "", sql: str | None = None) -> Callable[[Callable[[View], DataFrame]], Callable[[View], DataFrame]]:
    def keep(f: Callable[[View], DataFrame]) -> Callable[[View], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: reskin.view(spark, sf_dir, name))
        if sql is not None:
            SQL[f.__name__] = reskin.oracle(views, sql) if views else sql
        return f

    return keep
