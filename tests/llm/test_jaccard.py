from __future__ import annotations

import random

import pytest
from compare import differences
from pyspark.sql import functions as F
from fixtures import SMALL, VOCABULARY, WORD, edge_rows, edges, empty

from sediment.llm import jaccard
from sediment.llm.jaccard import OP10_SQL, jaccard_classes, one_of_each, op10_jaccard_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, k: int) -> frozenset:
    ws = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if len(ws) >= k else frozenset([tuple(ws)] if ws else [])


def expected(rows, k: int, percent: int) -> list[tuple]:
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d is None, d or 0, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def found(df) -> list[tuple]:
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def near_copies(seed: int, n: int, k: int) -> list[tuple]:
    """Families of texts that differ by a few words, near the threshold on both sides."""
    r = random.Random(seed)
    rows, i = [], 0
    while len(rows) < n:
        words = [r.choice(VOCABULARY) for _ in range(r.choice([1, 2, 3, 6, 12, 40, 90, 250]))]
        for _ in range(r.randint(1, 9)):
            own = list(words)
            for _ in range(r.randint(0, max(1, len(own) // (12 * k)))):
                at = r.randrange(len(own))
                own[at : at + 1] = r.choice([[], [r.choice(VOCABULARY)], [own[at], r.choice(VOCABULARY)]])
            rows.append((i, " ".join(own)))
            i += 1
    r.shuffle(rows)
    return rows


def test_agrees_with_sql(spark):
    assert differences(spark, op10_jaccard_join, OP10_SQL, SMALL) == []


@pytest.mark.parametrize("k, percent, seed", [(3, 90, 1), (5, 80, 2), (3, 60, 3), (1, 80, 4)])
def test_agrees_with_brute_force(spark, k, percent, seed):
    rows = near_copies(seed, 300, k)
    assert found(jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), k, percent)) == expected(rows, k, percent)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 32)
    words = VOCABULARY[:120]
    rows = [(i, " ".join([*words, f"n{i}"])) for i in range(400)] + [(1000 + i, " ".join(words)) for i in range(100)]
    assert found(jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)) == expected(rows, 5, 80)


def test_a_chain(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[i : i + 100])) for i in range(60)]
    assert found(jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)) == expected(rows, 3, 90)


def test_edges(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    assert found(jaccard_classes(edges(spark), 5, 80)) == expected(rows, 5, 80)
    assert found(jaccard_classes(empty(spark), 5, 80)) == []
    kept = one_of_each(edges(spark))
    assert kept.columns == edges(spark).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 4, 6, 7, 9, None, 11, -12], key=str)


def test_portions_change_nothing(spark, monkeypatch):
    r = random.Random(8)
    texts = [" ".join(r.choice(VOCABULARY) for _ in range(60)) for _ in range(20)]
    rows = [(i, texts[i % 20] + f" tail {i // 40}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "PORTION", 64)
    assert found(jaccard_classes(docs, 3, 90)) == expected(rows, 3, 90)


def test_one_of_each_keeps_columns_of_any_name(spark):
    docs = edges(spark)
    for c in ("_d", "_g", "_gone", "set", "component_id", "stays", "a.b"):
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    out = one_of_each(docs)
    assert out.columns == docs.columns
    assert {tuple(r)[6:] for r in out.collect()} == {tuple(f"own {c}" for c in docs.columns[6:])}
