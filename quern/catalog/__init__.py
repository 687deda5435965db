"""Named queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Collects queries: `@c.query("SELECT ...")` above a function of `(spark, sf_dir)`."""

    def __init__(self) -> None:
        self.QUERIES: dict[str, Query] = {}
        self.SQL: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.QUERIES[f.__name__] = f
            if sql:
                self.SQL[f.__name__] = sql
            return f

        return add
