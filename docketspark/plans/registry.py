"""Registration of queries with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def put(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c: Column) -> Column:
    return c.cast("long")


def small_list(df: DataFrame, name: str, most: int = 10_000) -> list:
    """Distinct values of a small dimension; more than ``most`` are refused, so what tasks carry stays bounded."""
    rows = df.select(name).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{name}: more than {most} values")
    return sorted(r[0] for r in rows if r[0] is not None)
