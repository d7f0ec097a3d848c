from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from sediment.functions import documents as D


@pytest.mark.parametrize(
    "text, found",
    [
        (None, None),
        ("", None),
        ("no value {here", None),
        ("{bad} [1, {\"a\": \"]\"}] {}", '[1,{"a":"]"}]'),
        ("x {\"b\": 1, \"a\": [\"é\"]} y", '{"a":["é"],"b":1}'),
        ("[" * 50_000 + "{}", "{}"),
        ("[[", None),
    ],
)
def test_first_value(text, found):
    assert D.first_value(text) == found


def value(r: random.Random, deep: int):
    kind = r.randrange(7 if deep else 5)
    if kind < 5:
        return r.choice([None, True, r.randint(-5, 5), 1.5, "x", "ü\n\"{["])
    if kind == 5:
        return [value(r, deep - 1) for _ in range(r.randint(0, 3))]
    return {r.choice("abcd"): value(r, deep - 1) for _ in range(r.randint(0, 3))}


def test_values_in_prose_come_back():
    r = random.Random(1)
    for _ in range(500):
        v = {"k": value(r, 4)}
        assert json.loads(D.first_value(f"so ]}} (see {json.dumps(v)}) {{and [more")) == v


@pytest.mark.parametrize(
    "value, schema, made, problems",
    [
        ("12", {"type": "integer"}, 12, []),
        (12.0, {"type": "integer"}, 12, []),
        (12.5, {"type": "integer"}, 12.5, ["$: not integer"]),
        (" 1e2 ", {"type": "number"}, 100.0, []),
        ("true", {"type": "integer"}, "true", ["$: not integer"]),
        (True, {"type": "integer"}, True, ["$: not integer"]),
        ("TRUE", {"type": "boolean"}, True, []),
        (7, {"type": "string"}, "7", []),
        (None, {"type": "string"}, None, ["$: not string"]),
        (None, {"type": ["string", "null"]}, None, []),
        (None, {"type": "string", "default": "d"}, "d", []),
        ("x", {"type": "array", "items": {"type": "integer"}}, ["x"], ["$[0]: not integer"]),
        ([1, 9], {"items": {"maximum": 5}, "maxItems": 1}, [1, 9], ["$: number of items", "$[1]: over maximum"]),
        ("abc", {"minLength": 4, "pattern": "^b"}, "abc", ["$: length", "$: pattern"]),
        ({"a": "1", "x": 2}, {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"default": [0]}}, "required": ["a", "b", "c"]}, {"a": 1, "b": [0], "x": 2}, ["$.c: missing"]),
        ({"a": 1}, {"type": "object", "properties": {}, "additionalProperties": False}, {}, []),
        ({"a": {"b": [{"c": "q"}]}}, {"properties": {"a": {"properties": {"b": {"items": {"properties": {"c": {"enum": ["z"]}}}}}}}}, {"a": {"b": [{"c": "q"}]}}, ["$.a.b[0].c: not in enum"]),
    ],
)
def test_fitting(value, schema, made, problems):
    assert D.fitted(value, schema) == (made, problems)
    assert type(D.fitted(value, schema)[0]) is type(made)


@pytest.mark.parametrize(
    "base, over, both",
    [
        ({"a": {"b": {"c": 1, "d": 2}}}, {"a": {"b": {"c": 3}}}, {"a": {"b": {"c": 3, "d": 2}}}),
        ({"l": [1]}, {"l+": [2, 3]}, {"l": [1, 2, 3]}),
        ({"l": 1}, {"l+": 2}, {"l": [1, 2]}),
        ({}, {"l+": 2, "n": {"m+": [1]}}, {"l": [2], "n": {"m": [1]}}),
        ({"l": [1]}, {"l": [2]}, {"l": [2]}),
        ({"a": {"b": 1}}, {"a": None}, {"a": None}),
        ({"a": 1}, {"a": {"b": 1}}, {"a": {"b": 1}}),
        ([1], {"a": 1}, {"a": 1}),
        ({"+": 1}, {"+": 2}, {"+": 2}),
    ],
)
def test_merging(base, over, both):
    assert D.merged(base, over) == both


def test_columns(spark):
    rows = spark.createDataFrame([(None, None), ("{", '{"a": 1}'), ('{"a": {"x": 1}}', None), ('{"a": {"x": 1}}', '{"a": {"y": 2}}'), ("", "")], "a string, b string")
    merged = [r[0] for r in rows.select(D.merge_json(F.col("a"), F.col("b"))).collect()]
    assert merged == [None, '{"a":1}', '{"a":{"x":1}}', '{"a":{"x":1,"y":2}}', None]
    fitted = [tuple(r[0]) for r in rows.select(D.fit_json(F.col("a"), {"type": "object", "required": ["a"]})).collect()]
    assert fitted == [(None, None), (None, ["$: not JSON"]), ('{"a":{"x":1}}', []), ('{"a":{"x":1}}', []), (None, ["$: not JSON"])]
    assert [r[0] for r in rows.select(D.first_json(F.col("b"))).collect()] == [None, '{"a":1}', None, '{"a":{"y":2}}', None]
