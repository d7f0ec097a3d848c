from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from sediment.catalog import QUERIES
from sediment.operators import trees as R

FOLDER = "/root/testdata/sf0.001"


def planted(r: random.Random, n: int) -> tuple[list[tuple[str, str | None, float]], dict]:
    """An unrooted tree of n leaves with edges of random lengths, and the distances of its leaves."""
    near = {"L00": {}, "L01": {}, "L02": {}, "i0": {}}
    for leaf in ("L00", "L01", "L02"):
        near[leaf]["i0"] = near["i0"][leaf] = r.uniform(0.5, 3)
    for k in range(3, n):
        a, b = r.choice(sorted((x, y) for x in near for y in near[x] if x < y))
        length = near[a].pop(b)
        near[b].pop(a)
        mid, leaf, part = f"i{k}", f"L{k:02}", r.uniform(0.2, 0.8)
        near[mid] = {a: part * length, b: (1 - part) * length}
        near[a][mid], near[b][mid] = part * length, (1 - part) * length
        near[mid][leaf] = r.uniform(0.5, 3)
        near[leaf] = {mid: near[mid][leaf]}
    far = {}
    for leaf in (x for x in near if x[0] == "L"):
        seen, todo = {leaf: 0.0}, [leaf]
        while todo:
            at = todo.pop()
            for to, length in near[at].items():
                if to not in seen:
                    seen[to] = seen[at] + length
                    todo.append(to)
        far |= {(leaf, x): d for x, d in seen.items() if x[0] == "L"}
    edges, seen, todo = [("i0", None, 0.0)], {"i0"}, ["i0"]
    while todo:
        at = todo.pop()
        for to, length in near[at].items():
            if to not in seen:
                seen.add(to)
                edges.append((to, at, length))
                todo.append(to)
    return edges, far


def paths(edges: list[tuple[str, str | None, float]]) -> dict:
    """Distances of leaves by way of their ancestors."""
    parent = {n: (p, x) for n, p, x in edges}
    leaves = sorted(set(parent) - {p for p, _ in parent.values()})

    def up(n):
        out, d = {}, 0.0
        while n is not None:
            out[n] = d
            n, x = parent[n]
            d += x
        return out

    above = {n: up(n) for n in leaves}
    return {(a, b): min(above[a][n] + above[b][n] for n in above[a] if n in above[b]) for a in leaves for b in leaves}


def distances(spark, trees: dict[str, dict]):
    rows = [(t, a, b, d) for t, far in trees.items() for (a, b), d in far.items() if a < b]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "tree string, a string, b string, distance double").repartition(4)


def test_planted_trees_come_back(spark):
    r = random.Random(2)
    made = {f"t{n}": planted(r, n) for n in (3, 4, 5, 8, 13, 30)}
    edges = R.neighbour_trees(distances(spark, {t: far for t, (_, far) in made.items()}))
    true = spark.createDataFrame([(t, *e) for t, (es, _) in made.items() for e in es], "tree string, node string, parent string, length double")
    compared = R.split_distance(R.splits(edges), R.splits(true)).collect()
    assert {c["tree"]: (c["shared"], c["distance"]) for c in compared} == {f"t{n}": (n - 3, 0) for n in (4, 5, 8, 13, 30)}
    for t, (_, far) in made.items():
        got = paths([(e["node"], e["parent"], e["length"]) for e in edges.where(f"tree = '{t}'").collect()])
        assert got.keys() == far.keys() and all(abs(got[k] - far[k]) < 1e-6 for k in far)


def test_rooting_keeps_distances(spark):
    r = random.Random(3)
    made = {f"t{n}": planted(r, n) for n in (4, 9, 17)}
    edges = R.neighbour_trees(distances(spark, {t: far for t, (_, far) in made.items()}))
    for hung in (R.rooted(edges), R.rooted(edges, "L02"), R.rooted(R.rooted(edges), "L01")):
        for t, (_, far) in made.items():
            rows = [(e["node"], e["parent"], e["length"]) for e in hung.where(f"tree = '{t}'").collect()]
            got = paths(rows)
            assert all(abs(got[k] - far[k]) < 1e-6 for k in far) and [n for n, p, _ in rows if p is None] == ["root"]
    middle = [(e["node"], e["parent"], e["length"]) for e in R.rooted(edges).where("tree = 't17'").collect()]
    deep = {n: paths([*middle, ("other", "root", 0.0)])[n, "other"] for n in {n for n, _, _ in middle} if n[0] == "L"}
    assert abs(2 * max(deep.values()) - max(made["t17"][1].values())) < 1e-6
    with pytest.raises(Exception, match="no leaf"):
        R.rooted(edges, "nobody").collect()


def closest_again_and_again(names, d):
    groups, out = {n: [n] for n in names}, []
    far = {(a, b): d[i, j] for (i, a), (j, b) in combinations(enumerate(names), 2)}
    while len(groups) > 1:
        mean = {(a, b): np.mean([far[min(x, y), max(x, y)] for x in groups[a] for y in groups[b]]) for a, b in combinations(sorted(groups), 2)}
        a, b = min(mean, key=lambda k: (round(mean[k], 9), k))
        groups[a] = groups[a] + groups.pop(b)
        out.append((a, b, round(float(mean[a, b]), 6), len(groups[a])))
    return out


def test_linkage_against_merging_the_closest():
    r = np.random.default_rng(4)
    for n in (1, 2, 3, 8, 25):
        x = r.random((n, 3))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        names = [f"n{i:02}" for i in range(n)]
        assert [(a, b, round(h, 6), s) for _, a, b, h, s in R.linkage(names, d)] == closest_again_and_again(names, d)
    tied = np.ones((5, 5)) - np.eye(5)
    merges = R.linkage(list("abcde"), tied)
    assert [m[3] for m in merges] == [1.0] * 4 and merges == R.linkage(list("abcde"), tied) and merges[-1][4] == 5


def test_cuts(spark):
    places = {"a": 0.0, "b": 1.1, "c": 2.3, "k": 50.0, "l": 51.4, "z": 90.0}
    far = {(x, y): abs(places[x] - places[y]) for x in places for y in places}
    merges = R.average_linkage(distances(spark, {"t": far, "pair": {("p", "q"): 2.0}, "same": {(x, y): 1.0 for x in "uvw" for y in "uvw" if x != y}}))
    rows = R.cut_trees(merges).collect()
    groups = {t: [r["group"] for r in sorted((r for r in rows if r["tree"] == t), key=lambda r: r["place"])] for t in ("t", "pair", "same")}
    assert groups == {"t": [0, 0, 0, 1, 1, 2], "pair": [0, 0], "same": [0, 0, 0]}
    assert [r["leaf"] for r in sorted((r for r in rows if r["tree"] == "t"), key=lambda r: r["place"])] == list("abcklz")
    for n in (1, 2, 3, 5, 6, 9):
        cut = R.cut_trees(merges.where("tree = 't'"), n).collect()
        assert {r["groups"] for r in cut} == {min(n, 6)} == {len({r["group"] for r in cut})}


def test_newick_and_drawing(spark):
    edges = spark.createDataFrame([("t", "it's", "x", 1.0), ("t", "b c", "x", 2.0), ("t", "a", "r", 0.5), ("t", "x", "r", 3.0), ("t", "r", None, 0.0)], "tree string, node string, parent string, length double")
    row = R.written_trees(edges).first()
    assert row["newick"] == "(a:0.500000,('b c':2.000000,'it''s':1.000000):3.000000);"
    assert row["drawing"] == "+\n  a\n  +\n    b c\n    it's"


def test_bad_and_empty_distances(spark):
    schema = "tree string, a string, b string, distance double"
    for rows, said in (([("t", "a", "b", 1.0), ("t", "a", "c", 1.0)], "missing"), ([("t", "a", "b", 1.0), ("t", "b", "a", 1.0)], "two distances")):
        with pytest.raises(Exception, match=said):
            R.neighbour_trees(spark.createDataFrame(rows, schema)).collect()
    none = spark.createDataFrame([], schema)
    assert R.neighbour_trees(none).collect() == [] and R.cut_trees(R.average_linkage(none)).collect() == []
    pair = R.neighbour_trees(spark.createDataFrame([(None, "a", "b", 1.0)], schema)).collect()
    assert {(e["tree"], e["node"], e["length"]) for e in pair} == {(None, "a", 0.5), (None, "b", 0.5), (None, "#1", 0.0)}


def tradition(seed: int, mixed: bool):
    """Three clades of four witnesses; each clade and each witness has changes of its own. With ``mixed``, one witness took over half
    of another clade's changes."""
    r = random.Random(seed)
    rows = []
    for unit in range(600):
        text = {f"{c}{i}": "x" for c in "ABC" for i in range(4)}
        kind = r.random()
        if kind < 0.3:
            c = r.choice("ABC")
            for w in text:
                if w[0] == c:
                    text[w] = "new"
            if mixed and c == "B" and r.random() < 0.6:
                text["A1"] = "new"
        elif kind < 0.6:
            text[r.choice(sorted(text))] = r.choice(["slip", "new"])
        rows += [(unit, w, w[0], t) for w, t in text.items() if r.random() < 0.97]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_mixed_witness_is_found_and_no_other(spark, seed):
    schema = "unit int, witness string, clade string, reading string"
    found = R.contamination(spark.createDataFrame(tradition(seed, True), schema)).where("mixed").collect()
    assert [(r["witness"], r["other"]) for r in found] == [("A1", "B")]
    extra = [(1, "A9", None, "x"), (2, "A9", "A", None)]
    assert R.contamination(spark.createDataFrame(tradition(seed, False) + extra, schema)).where("mixed").collect() == []
    assert R.contamination(spark.createDataFrame([], schema)).collect() == []


def test_queries_without_sql(spark):
    far = {t: {} for t in ()}
    for r in QUERIES["profile_distances"].run(spark, FOLDER).collect():
        far.setdefault(r["tree"], {}).update({(r["a"], r["b"]): r["distance"], (r["b"], r["a"]): r["distance"]})
    trees = QUERIES["neighbour_trees"].run(spark, FOLDER).collect()
    assert {r["tree"] for r in trees} == set(far) and all(r["newick"].endswith(");") for r in trees)
    compared = QUERIES["trees_compared"].run(spark, FOLDER).collect()
    leaves = {t: len({a for a, _ in f}) for t, f in far.items()}
    assert all(c["shared"] + c["only_x"] == leaves[c["tree"]] - 3 for c in compared)
    groups = QUERIES["linkage_groups"].run(spark, FOLDER).collect()
    assert Counter(r["tree"] for r in groups) == Counter(leaves)
