"""Statements, cases and witnesses on small tables, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sediment.operators import evidence as E


def test_statements_with_denials_nulls_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, "Root of Ginger, not cure for cold."), (2, None), (3, ""), (1, "root of ginger")], "doc_id long, text string")
    found = sorted(tuple(r) for r in E.statements(docs).collect())
    assert found == [(1, "cure", "for", "cold", True), (1, "root", "of", "ginger", False), (1, "root", "of", "ginger", False)]
    assert E.statements(docs.limit(0)).count() == 0


def test_empty_conditions_meet_nothing(spark):
    claims = spark.createDataFrame([(1, "r", ["a", "b"], 10), (2, "s", ["a"], 20), (3, None, None, None)], "id long, relation string, terms array<string>, year int")
    assert [r.id for r in E.stated(claims, all_of=["a"], any_of=["b"], after=10, before=11).collect()] == [1]
    assert E.stated(claims, relations=[]).count() == 0 and E.stated(claims, any_of=[]).count() == 0
    assert E.stated(claims).count() == 3


def test_sense_needs_one_winner(spark):
    words = spark.createDataFrame([(["a", "b"],), (["a", "x"],), (["a", "z"],), ([],), (None,)], "w array<string>")
    cues = {"one": (["a", "b"], ["z"]), "two": (["x"], [])}
    assert [r.s for r in words.select(E.sense(F.col("w"), cues).alias("s")).collect()] == ["one", None, None, None, None]


def test_equivalents_ties_go_to_the_smaller_form(spark):
    forms = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", "c"), ("g", "c"), ("h", "x")], "g string, form string")
    assert sorted(tuple(r) for r in E.equivalents(forms, "g", "form").collect()) == [("a", "c", 1), ("b", "c", 1)]


def test_disagreements_of_rows_and_fields(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "id long, f string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, None)], "id long, f string")
    found = sorted(tuple(r) for r in E.disagreements(a, b, "id", ["f"]).collect())
    assert found == [(2, "f", None, "y"), (3, "id", "3", None), (4, "id", None, "4")]


def test_accepted_failed_undecided(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 7), ("b", 1), ("c", None)], "g string, n int")
    found = {r.g: (r.verdict, r.failed) for r in E.accepted(rows, "g", {"five": F.col("n") >= 5}).collect()}
    assert found == {"a": ("accepted", []), "b": ("failed", ["five"]), "c": ("undecided", [])}


def test_period_words(spark):
    years = spark.createDataFrame([(1995,), (1998,), (None,)], "y int")
    assert years.where(E.constraint("before 1998", F.col("y"))).count() == 1
    assert years.where(E.constraint("1998 to 1995", F.col("y"))).count() == 2
    with pytest.raises(ValueError):
        E.constraint("some day", F.col("y"))


def test_divergence_of_one_and_of_equal_groups(spark):
    one = spark.createDataFrame([("a", "x", 3)], "g string, t string, n long")
    assert E.divergence(one, "g", "t", "n").collect()[0].jsd is None
    two = spark.createDataFrame([("a", "x", 3), ("b", "y", 3), ("c", "x", 1), ("c", "y", 1)], "g string, t string, n long")
    assert E.divergence(two, "g", "t", "n").where("g = 'c'").collect()[0].jsd == pytest.approx(0.0)
