"""Where queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Views, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(views: str = "", text: str | None = None) -> Callable:
    """Registers a function of Views under its name, with SQL over the named views."""

    def put(f: Callable[[Views], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if text:
            ORACLE_SQL[f.__name__] = sql(views, text)
        return f

    return put
