"""Steps that are dealt by rows, so that a task's memory does not grow with the input."""

from __future__ import annotations

import random

import pytest

from sediment.operators import reuse as R
from sediment.sources import records


def test_parts_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(records, "TASK_ROWS", 10)
    rows = spark.range(1000)
    assert records.dealt(rows, 1000, "id").rdd.getNumPartitions() == 100
    assert records.dealt(rows, 5, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("size", [20, 1 << 18])
def test_contained_fetches_sets_without_sorting_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(records, "TASK_ROWS", size)
    chance = random.Random(13)
    sets = {k: set(chance.sample(range(30), chance.randint(1, 12))) for k in range(40)}
    sampled = spark.createDataFrame([(k, s) for k, x in sets.items() for s in x], "doc_id long, shingle long")
    found = R.contained(sampled, 0.3)
    assert "ShuffledHashJoin" in found._jdf.queryExecution().toString()
    rows = {tuple(r)[:3] for r in found.collect()}
    assert rows == {(a, b, len(x & y)) for a, x in sets.items() for b, y in sets.items() if a != b and len(x & y) / len(x) >= 0.3}
    assert found.count() == len(rows)


def test_units_of_one_file_are_relabelled_by_many_tasks(spark):
    from pyspark.sql import functions as F

    from sediment.operators.resampling import relabelled

    units = spark.range(2000).select(F.col("id").alias("unit"), (F.col("id") < 700).alias("g")).coalesce(1)
    found = relabelled(units, "g", 3).where("round > 0 and drawn").select("round", F.spark_partition_id().alias("p"))
    assert found.groupBy("round").count().where("count = 700").count() == 3
    assert found.select("p").distinct().count() > 2


def test_cases_are_dealt_by_the_rows_they_make(spark, monkeypatch):
    from sediment.operators import evidence as E

    monkeypatch.setattr(records, "TASK_ROWS", 50)
    seen = spark.createDataFrame([(c, f"f{f}") for c in range(60) for f in range(5) if (c + f) % 4], "case long, feature string")
    profiles = spark.createDataFrame([(p, f"f{f}") for p in range(10) for f in range(5) if (p * f) % 3 != 1], "profile long, feature string")
    found = E.profile_fits(seen, profiles, "case", 3)
    assert found.count() == 180
    text = found._jdf.queryExecution().optimizedPlan().toString()
    met = seen.join(profiles, "feature").count()
    assert f"RepartitionByExpression [case#" in text and f", {-(-met // 50)}" in text


@pytest.mark.parametrize("name", ["name_switches", "odds_ratio_group_contrast"])
def test_order_lines_are_dealt_by_their_number(spark, monkeypatch, name):
    from sediment.catalog import QUERIES

    folder, parts = "/root/testdata/sf0.001", []
    whole = {tuple(r) for r in QUERIES[name].run(spark, folder).collect()}
    monkeypatch.setattr(records, "TASK_ROWS", 1000)
    dealt = records.dealt

    def told(df, rows, *by):
        parts.append((rows, *by))
        return dealt(df, rows, *by)

    for module in ("sediment.sources.records", "sediment.queries.diachronic", "sediment.queries.profiles"):
        monkeypatch.setattr(f"{module}.dealt", told)
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    assert {tuple(r) for r in QUERIES[name].run(spark, folder).collect()} == whole
    assert {(lines, "l_partkey"), (lines, "l_orderkey"), (lines, "unit")} <= set(parts)
