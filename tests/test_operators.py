"""Operators against brute force on small tables, with nulls, ties and empty tables."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sediment.functions import stats
from sediment.functions import text as T
from sediment.operators import estimates as E
from sediment.sources import records


def test_hash_chain(spark):
    rows = [(k, i, p) for k in ("a", "b", None) for i, p in enumerate(["x", None, "y", "x"])]
    found = {r["by"]: (r["n"], r["digest"]) for r in E.hash_chain(spark.createDataFrame(rows, "k string, i long, p string").repartition(3), "k", ["i"], F.col("p")).collect()}
    digest = "0" * 64
    for p in ("x", "", "y", "x"):
        digest = hashlib.sha256((digest + p).encode()).hexdigest()
    assert found == dict.fromkeys(("a", "b", None), (4, digest))
    assert E.hash_chain(spark.createDataFrame([], "k string, i long, p string"), "k", ["i"], F.col("p")).collect() == []


def test_concordance(spark):
    r = random.Random(2)
    rows = [(r.choice([1, 2, 3, 4, None]), r.choice([1.0, 2.0, 3.0, None])) for _ in range(120)]
    whole = [x for x in rows if None not in x]
    pairs = [(a, b) for i, a in enumerate(whole) for b in whole[:i]]
    sign = [(a[0] - b[0]) * (a[1] - b[1]) for a, b in pairs]
    got = E.concordance(spark.createDataFrame(rows, "x int, y double"), "x", "y").first()
    assert (got["concordant"], got["discordant"]) == (sum(s > 0 for s in sign), sum(s < 0 for s in sign))
    assert E.concordance(spark.createDataFrame([], "x int, y double"), "x", "y").first()["share"] is None


def test_ngrams(spark):
    df = spark.createDataFrame([("a b c d",), ("a",), ("",), (None,)], "t string")
    rows = df.select(T.word_ngrams(F.split("t", " "), 3).alias("w"), T.char_ngrams(F.col("t"), 2).alias("c")).collect()
    assert [r["w"] for r in rows] == [["a b c", "b c d"], [], [], []] or rows[3]["w"] is None
    assert [r["c"] for r in rows][:3] == [["a ", " b", "b ", " c", "c ", " d"], [], []]


def test_passages_are_the_text(spark):
    text = ("A sentence of words. " * 60 + "x" * 900 + "\nlast") * 2
    got = spark.createDataFrame([(text,)], "t string").select(T.passages(F.col("t"), 400)).first()[0]
    assert "".join(got) == text
    assert max(map(len, got)) <= 400


def test_json_lines(spark):
    rows = [(i, "ab"[i % 2] if i % 5 else None, None if i % 3 else f"v\n{i}") for i in range(50)]
    path = records.write_json_lines(spark.createDataFrame(rows, "i long, kind string, v string"), records.scratch(spark, "t"), ["kind"])
    assert sorted(map(tuple, records.read_json_lines(spark, path, "i long, kind string, v string").collect())) == rows


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_datasets(spark, kind):
    df = spark.createDataFrame([(1, "a,b"), (2, 'c"d')], "i long, s string")
    path = records.scratch(spark, kind)
    made = records.write_dataset(df, path, kind).first()
    assert made["rows"] == 2 and made["columns"] == "i,s"
    assert records.write_dataset(df.orderBy(F.desc("i")), path + "2", kind).first()["digest"] == made["digest"]


def test_tails(spark):
    from math import comb

    a, b, c, d = 8, 2, 1, 5
    n, r, k = a + b + c + d, a + b, a + c

    def p(x):
        return comb(r, x) * comb(n - r, k - x) / comb(n, k)

    row = spark.createDataFrame([(float(a), float(b), float(c), float(d))], "a double, b double, c double, d double").select(stats.fisher_greater("a", "b", "c", "d").alias("one"), stats.fisher_two_sided("a", "b", "c", "d").alias("two"), stats.chi2_tail(F.lit(3.841458820694124), F.lit(1.0)).alias("chi"), stats.normal_two_sided(F.lit(1.959963984540054)).alias("z"), stats.t_two_sided(F.lit(2.2281388519649385), F.lit(10.0)).alias("t")).first()
    low, high = max(0, k - (n - r)), min(r, k)
    assert row["one"] == pytest.approx(sum(p(x) for x in range(a, high + 1)))
    assert row["two"] == pytest.approx(sum(p(x) for x in range(low, high + 1) if p(x) <= p(a) * (1 + 1e-7)))
    assert [row["chi"], row["z"], row["t"]] == pytest.approx([0.05] * 3, abs=1e-6)


def test_library_stands_without_the_numbered_operators():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "sediment"
    for path in root.rglob("*.py"):
        if path.parent.name == "llm":
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] + [a.name for a in node.names] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in x.split(".") for x in names), path


def test_exact_tests_of_large_tables(spark):
    import math

    from sediment.functions import stats

    def chance(a, b, c, d):
        g = math.lgamma
        return math.exp(g(a + b + 1) + g(c + d + 1) + g(a + c + 1) + g(b + d + 1) - g(a + 1) - g(b + 1) - g(c + 1) - g(d + 1) - g(a + b + c + d + 1))

    tables = [(3, 1, 1, 3), (0, 5, 7, 2), (120, 80, 60, 140), (5000, 4700, 4800, 5100), (0, 0, 3, 4), (2, 0, 0, 2), (900, 10, 10, 900)]
    for a, b, c, d in tables:
        some = [(x, chance(x, a + b - x, a + c - x, d - a + x)) for x in range(max(0, a - d), min(a + b, a + c) + 1)]
        seen = dict(some)[a]
        wanted = (min(1.0, sum(p for x, p in some if x >= a)), min(1.0, sum(p for _, p in some if p <= seen * (1 + 1e-7))))
        row = spark.createDataFrame([(a, b, c, d)], "a long, b long, c long, d long").select(stats.fisher_greater("a", "b", "c", "d"), stats.fisher_two_sided("a", "b", "c", "d")).first()
        assert all(abs(x - y) <= 1e-6 * max(y, 1e-12) + 1e-300 for x, y in zip(row, wanted)), (a, b, c, d, row, wanted)
    big = spark.createDataFrame([(50_000_000, 50_000_000, 50_000_000, 50_000_000)], "a long, b long, c long, d long").select(stats.fisher_greater("a", "b", "c", "d"), stats.fisher_two_sided("a", "b", "c", "d")).first()
    assert 0.5 < big[0] < 0.51 and big[1] > 0.9999


def test_relabelling_draws_the_smallest_hashes(spark):
    import hashlib

    from sediment.operators.resampling import relabelled

    for n, k in ((50, 12), (1, 0), (7, 7), (6, 0), (300, 299)):
        units = spark.createDataFrame([(i, i < k) for i in range(n)], "unit long, in_group boolean").repartition(3)
        found = relabelled(units, "in_group", 3).collect()
        assert len(found) == 4 * n
        for r in range(1, 4):
            order = sorted(range(n), key=lambda u: (int(hashlib.md5(f"{u}-{r}".encode()).hexdigest()[:8], 16), u))
            assert {x["unit"] for x in found if x["round"] == r and x["drawn"]} == set(order[:k])
        assert {x["unit"] for x in found if x["round"] == 0 and x["drawn"]} == set(range(k))


def test_nearest_entries_against_all(spark):
    import random

    from sediment.operators.lexicon import nearest

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    r = random.Random(1)
    asked, entries = (sorted({"".join(r.choice("abé") for _ in range(r.randint(0, 9))) for _ in range(40)}) for _ in range(2))
    found = nearest(spark.createDataFrame([(w,) for w in [*asked, None, asked[0]]], "asked string"), spark.createDataFrame([(w,) for w in [*entries, None]], "entry string"), 3)
    wanted = {(a, e, d) for a in asked for d, e in sorted((distance(a, e), e) for e in entries)[:3] if d <= 3}
    assert {tuple(x) for x in found.collect()} == wanted


def test_retraction_from_the_withdrawn_down(spark):
    from sediment.streaming.windows import retracted

    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "a"), ("c", "d"), ("x", "y"), ("a", "c")], "child string, parent string")  # with a ring
    found = retracted(edges, spark.createDataFrame([("a",), ("z",), ("a",)], "id string"), "child", "parent").collect()
    assert sorted(map(tuple, found)) == [("a", 0), ("b", 1), ("c", 2), ("d", 1), ("z", 0)]


def test_a_fold_goes_on_from_a_snapshot_with_late_events(spark):
    from sediment.streaming.windows import replayed, restored, snapshot

    events = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 10, "a"), (1, 15, "a"), (3, 5, "b"), (2, 11, "b")], "key long, at long, kind string")
    first, later = events.where("not (key = 1 and at = 15) and key <> 3 and at <> 11"), events.where("(key = 1 and at = 15) or key = 3 or at = 11")
    kinds = ["a", "b"]
    assert sorted(map(tuple, restored(later, snapshot(first, "key", ["at"], kinds), "key", ["at"], kinds).collect())) == sorted(map(tuple, replayed(events, "key", ["at"], kinds).collect()))
