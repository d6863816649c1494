"""A catalogue of queries and the SQL that gives their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Catalogue:
    """Queries by name, and SQL for those that SQL can express."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def put(query: Query) -> Query:
            own = name or query.__name__
            self.queries[own] = query
            if sql:
                self.sql[own] = sql
            return query

        return put
