"""The library's scalar functions under names that SQL can call; they stay expressions, so the optimizer sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFINITIONS = (
    "period_of(y INT, width INT) RETURNS INT RETURN y - pmod(y, width)",
    "jaccard_of(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE RETURN size(array_intersect(a, b)) / nullif(size(array_union(a, b)), 0)",
    "wilson_low(k BIGINT, n BIGINT) RETURNS DOUBLE RETURN (k + 1.96D * 1.96D / 2 - 1.96D * sqrt(k * (n - k) / n + 1.96D * 1.96D / 4)) / (n + 1.96D * 1.96D)",
)


def register(spark: SparkSession) -> None:
    """Register all of them in the session; registering again replaces them."""
    for definition in DEFINITIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {definition}")
