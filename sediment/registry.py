"""Named queries: how each runs on Spark, and the SQL that it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None = None
    rows: tuple[int, ...] = ()  # operators of the inventory that it shows


QUERIES: dict[str, Query] = {}


def query(*rows: int, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        if run.__name__ in QUERIES:
            raise ValueError(f"two queries named {run.__name__}")
        QUERIES[run.__name__] = Query(run, sql, rows)
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
