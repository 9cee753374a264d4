"""Names, callables and reference SQL of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the same result in ANSI SQL where that can be said."""
    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is already registered")
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


class Tables:
    """The given tables of one data folder, by name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stream_path(self, name: str) -> str:
        """The table as a glob, which a file stream takes for a folder and a file alike."""
        return f"{self.folder}/{name}.parque[t]"
