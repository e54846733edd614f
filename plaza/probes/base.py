"""Registration of queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The clock of every probe; ``events`` spans January 2024.
AS_OF = "2024-01-16 12:00:00"


class Tables:
    """The tables of one folder, read on demand: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def probe(key: str, sql: str | None = None):
    """Registers a function of Tables as query ``key``; ``sql`` gives the same rows in DuckDB."""

    def add(f):
        QUERIES[key] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[key] = sql
        return f

    return add
