from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest

from sediment.operators import baskets, overlap, reuse, sequences


def rows(r, n, items, null=False):
    out = {(i, x) for i in range(n) for x in r.sample(items, r.randint(1, min(6, len(items))))}
    return sorted(out) + ([(i, None) for i in range(0, n, 7)] if null else [])


def sets_of(pairs):
    sets, size = defaultdict(set), defaultdict(int)
    for b, x in pairs:
        size[b] += 1
        if x is not None:
            sets[b].add(x)
    return sets, size


@pytest.mark.parametrize("tile", [(4000, 1 << 14, 2048, 2048), (3, 8, 5, 2)])
@pytest.mark.parametrize("items", ["abcd", "abcdefghijklmnop"])
def test_nearest_baskets_and_cases_against_all_pairs(spark, monkeypatch, tile, items):
    for name, value in zip(("ASKED", "HELD", "ROWS", "ITEMS"), tile):
        monkeypatch.setattr(overlap, name, value)
    pairs = rows(random.Random(len(items)), 45, list(items), null=True)
    sets, size = sets_of(pairs)
    held = spark.createDataFrame(pairs, "basket long, item string")
    found = {(x["query"], x["basket"], x["shared"], round(x["jaccard"], 9)) for x in baskets.nearest(held, held.where("basket % 5 = 0")).collect()}
    wanted = set()
    for q in range(0, 45, 5):
        near = [(-(n := len(sets[q] & sets[b])) / (size[q] + size[b] - n), b, n) for b in sets if b != q and sets[q] & sets[b]]
        if near:
            j, b, n = min(near)
            wanted.add((q, b, n, round(-j, 9)))
    assert found == wanted and wanted

    pairs = [p for p in pairs if p[1] is not None]
    df = defaultdict(int)
    for _, x in pairs:
        df[x] += 1
    w = {x: (math.log((len(sets) + 1) / (n + 1)) + 1) ** 2 for x, n in df.items()}
    norm = {b: sum(w[x] for x in s) for b, s in sets.items()}
    cases = spark.createDataFrame(pairs, "case long, item string")
    got = {(x["query"], x["case"]): x["similarity"] for x in sequences.similar_cases(cases, cases.where("case % 5 = 0"), 3).collect()}
    wanted = {}
    for q in range(0, 45, 5):
        near = sorted((-round(sum(w[x] for x in sets[q] & sets[b]) / math.sqrt(norm[q] * norm[b]), 9), b) for b in sets if b != q and sets[q] & sets[b])
        wanted |= {(q, b): -s for s, b in near[:3]}
    assert got == pytest.approx(wanted, abs=1e-8)


def nearest_of_all(sets, size):
    found = set()
    for q in sets:
        near = [(-(n := len(sets[q] & sets[b])) / (size[q] + size[b] - n), b, n) for b in sets if b != q and sets[q] & sets[b]]
        if near:
            j, b, n = min(near)
            found.add((q, b, n, round(-j, 9)))
    return found


@pytest.mark.parametrize("parts,left,products,n", [(12, 1, 0, 5), (12, 1, 0, 18), (3, 1, 0, 18), (3, 1, 10**9, 18), (12, 0, 0, 18)])
def test_nearest_of_every_basket_by_parts_and_tiles(spark, monkeypatch, parts, left, products, n):
    items = ["a", "b", "ab", "1:a", *(f"i{x}" for x in range(14))][:n]
    for name, value in zip(("PARTS", "LEFT", "PRODUCTS"), (parts, left, products)):
        monkeypatch.setattr(baskets, name, value)
    pairs = rows(random.Random(len(items) + 1), 70, items, null=True) + [(100 + i, x) for i in range(3) for x in items[i:]] + [(200, "alone")]
    held = spark.createDataFrame(pairs, "basket long, item string")
    found = [(x["query"], x["basket"], x["shared"], round(x["jaccard"], 9)) for x in baskets.nearest(held).collect()]
    assert len(found) == len(set(found)) and set(found) == nearest_of_all(*sets_of(pairs))


def test_nearest_basket_answers_for_every_basket(spark):
    from sediment.catalog import QUERIES
    from sediment.queries.baskets import brands

    folder = "/root/testdata/sf0.001"
    found = {(x["query"], x["basket"], x["shared"], round(x["jaccard"], 6)) for x in QUERIES["nearest_basket"].run(spark, folder).collect()}
    wanted = nearest_of_all(*sets_of([tuple(x) for x in brands(spark, folder).collect()]))
    assert found == {(q, b, n, round(j, 6)) for q, b, n, j in wanted} and any(q % 50 for q, *_ in found)


def test_only_a_tile_s_best_are_passed_on(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HELD", 20)
    held = spark.createDataFrame([(i, ["x", f"{i}"], [1.0, 1.0], 2) for i in range(60)], "case long, items array<string>, weights array<double>, size long")
    found = overlap.best(held.where("case < 4").select(held["case"].alias("query"), "items", "size"), held, 2, True).collect()
    assert len(found) <= 4 * 2 * 3
    assert sorted({(r["query"], r["shared"]) for r in found}) == [(i, 1.0) for i in range(4)]


def test_nothing_to_ask(spark):
    held = spark.createDataFrame([(1, "a"), (2, "a")], "basket long, item string")
    assert baskets.nearest(held, held.where("basket > 5")).collect() == []


@pytest.mark.parametrize("common", [1, 2, 5, 64])
def test_best_containment_against_all_pairs(spark, common):
    r = random.Random(common)
    often = [set(range(i, i + 4)) for i in range(0, 24, 3)]
    sets = {d: set.union(*r.sample(often, r.randint(0, 2)), {1000 * r.randint(0, 20) + j for j in range(r.randint(0, 3))}, {10**6 + d}) for d in range(50)}
    sets |= {60: sets[1], 61: sets[1], 62: {-1}, 63: set(range(8))}
    sampled = spark.createDataFrame([(d, x) for d, s in sets.items() for x in sorted(s)], "doc_id long, shingle long")
    wanted = {d: max(len(s & o) for e, o in sets.items() if e != d) / len(s) for d, s in sets.items()}
    found = {x["doc_id"]: x["of_key"] for x in reuse.best_containment(sampled, common).collect()}
    assert found == pytest.approx({d: x for d, x in wanted.items() if x})


@pytest.mark.parametrize("common,tile,members", [(1, 1 << 13, 1 << 10), (1, 3, 2), (3, 5, 1), (64, 1 << 13, 1)])
def test_shingle_sets_that_meet_by_items(spark, monkeypatch, common, tile, members):
    for module, name, value in ((overlap, "ASKING", tile), (overlap, "HOLDING", tile + 2), (reuse, "MEMBERS", members), (reuse, "TOLD", 4)):
        monkeypatch.setattr(module, name, value)
    r = random.Random(common + tile)
    often = [set(range(i, i + 4)) for i in range(0, 24, 3)]
    sets = {d: set.union(*r.sample(often, r.randint(0, 2)), {1000 * r.randint(0, 20) + j for j in range(r.randint(0, 3))}, {10**6 + d} if d % 3 else set()) for d in range(60)}
    sets |= {60 + i: sets[1] for i in range(5)} | {70: sets[2] | {-1}, 71: sets[2] | {-2, -3}, 72: {-4}, 73: set(range(8))}
    sampled = spark.createDataFrame([(f"d{d}", x) for d, s in sets.items() for x in sorted(s)], "doc string, shingle long")
    pairs = {(d, e): len(s & o) for d, s in sets.items() for e, o in sets.items() if d != e and s & o}
    for least in (0.3, 0.6, 1.0):
        found = [tuple(x) for x in reuse.contained(sampled, least, "doc", common).collect()]
        assert len(found) == len(set(found))
        assert set(found) == {(f"d{d}", f"d{e}", n, n / len(sets[d]), n / len(sets[e])) for (d, e), n in pairs.items() if n / len(sets[d]) >= least}
    best = {x["doc"]: x["of_key"] for x in reuse.best_containment(sampled, common, "doc").collect()}
    assert best == {f"d{d}": max(n / len(sets[d]) for (x, _), n in pairs.items() if x == d) for d in sets if any(x == d for x, _ in pairs)}


def test_copies_are_paired_without_passing_their_pairs_on(spark, monkeypatch):
    """Documents that differ in what they alone have are one case, so 40 of them make no pairs that are joined, and none are held in tiles."""
    rows = [(d, x) for d in range(40) for x in (*range(10), 1000 + d)]
    sampled = spark.createDataFrame(rows, "doc_id long, shingle long")
    asked, make = [], overlap.by_items

    def told(sets, *rest):
        asked.append(sets.where("asks").count())
        return make(sets, *rest)

    monkeypatch.setattr(overlap, "by_items", told)
    assert reuse._cases(sampled, 8, "doc_id").count() == 1
    assert reuse.contained(sampled, 0.3, common=8).count() == 40 * 39
    assert {x["of_key"] for x in reuse.best_containment(sampled, 8).collect()} == {10 / 11}
    assert asked == [0, 0]
