"""A registry of queries: name -> function and, where there is one, SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
ROWS: dict[str, str] = {}


class Tables:
    """Tables of a directory, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(rows: str, sql: str | None = None):
    """Register fn(tables) under its own name; rows are the inventory rows that it covers."""

    def add(fn: Callable[[Tables], DataFrame]):
        name = fn.__name__
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        ROWS[name] = rows
        if sql:
            SQL[name] = sql
        return fn

    return add


def load() -> None:
    from . import aggregates, joins, scalars, scans, sequences, statistics  # noqa: F401
    from . import changes, evidence, files, measures, retrieving, rules, streams, verdicts  # noqa: F401
