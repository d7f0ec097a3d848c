from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from sediment.catalog import QUERIES
from sediment.operators import matching as M

FOLDER = "/root/testdata/sf0.001"
LETTER = "abcdefghijklmnopqrstuvwxyz"


def everywhere(text: str, entries: set[str]) -> set[tuple[int, int, str]]:
    """By cutting every piece of the text as long as an entry."""
    low = "".join(c.lower() if c.isascii() else c for c in text)
    sizes = {len(e) for e in entries}
    return {(s, s + n, low[s : s + n]) for n in sizes for s in range(len(low) - n + 1) if low[s : s + n] in entries}


@pytest.mark.parametrize("slice_bytes", [M.SLICE_BYTES, 300])
def test_against_a_plain_scan(spark, slice_bytes):
    r = random.Random(1)
    entries = {"".join(r.choice("ab é") for _ in range(r.randint(1, 6))) for _ in range(150)} | {"straße", "x" * 3000}
    docs = [(i, "".join(r.choice("abAB é.") for _ in range(r.randint(0, 80)))) for i in range(60)] + [(100, None), (101, ""), (102, "Straße STRAßE " + "x" * 3001)]
    table = spark.createDataFrame([(e.upper() if e.isascii() else e,) for e in sorted(entries)] + [(None,), ("",), ("a",), ("A",)], "entry string")
    entries |= {"a"}
    found = M.matches(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), table, 2, slice_bytes).collect()
    got = defaultdict(list)
    for m in found:
        got[m["doc_id"]].append((m["start"], m["end"], m["entry"]))
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(everywhere(t, entries)) for d, t in docs if t and everywhere(t, entries)}
    of = dict(docs)
    for m in found:
        text = of[m["doc_id"]].lower()
        before, after = text[max(0, m["start"] - 1) : m["start"]], text[m["end"] : m["end"] + 1]
        assert m["bounded"] == (not before.isalpha() and not after.isalpha())


def test_words_near(spark):
    docs = spark.createDataFrame([(1, "One two THREE, four-five six. seven")], "doc_id long, text string")
    entries = spark.createDataFrame([("three",), ("our-f",), ("seven",)], "entry string")
    near = {m["entry"]: (m["bounded"], m["near"]) for m in M.matches(docs, entries, 2).collect()}
    assert near == {"three": (True, ["one", "two", "four", "five"]), "our-f": (False, ["two", "three", "six", "seven"]), "seven": (True, ["five", "six"])}


def test_a_hundred_thousand_entries(spark):
    r = random.Random(2)
    entries = set()
    while len(entries) < 100_000:
        entries.add("".join(r.choice(LETTER) for _ in range(r.randint(3, 8))))
    known = sorted(entries)
    docs = [(i, " ".join(r.choice(known) if r.random() < 0.5 else "".join(r.choice(LETTER) for _ in range(6)) for _ in range(300))) for i in range(8)]
    found = M.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(e,) for e in known], "entry string"))
    got = defaultdict(set)
    for m in found.collect():
        got[m["doc_id"]].add((m["start"], m["end"], m["entry"]))
    assert got == {d: everywhere(t, entries) for d, t in docs}


def test_longest_against_a_loop(spark):
    r = random.Random(3)
    entries = {"".join(r.choice("ab") for _ in range(r.randint(1, 5))) for _ in range(12)}
    docs = [(i, "".join(r.choice("abc") for _ in range(60))) for i in range(40)]
    found = M.longest(M.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(e,) for e in entries], "entry string")))
    wanted = set()
    for d, t in docs:
        at = 0
        while at < len(t):
            fit = max((e for e in entries if t.startswith(e, at)), key=len, default=None)
            if fit:
                wanted.add((d, at, at + len(fit), fit))
            at += len(fit) if fit else 1
    assert {tuple(x) for x in found.collect()} == wanted


def test_gates(spark):
    docs = spark.createDataFrame([(1, "the red ring of old; rings and a ring", 1500), (2, "ring bell", 1700), (3, "big red ring, ring road", None), (4, "Mercury rose; mercury boils in heat", 1600)], "doc_id long, text string, year int")
    rules = spark.createDataFrame(
        [
            ("Ring", "jewel", True, None, ["road"], None, 1650),
            ("red ring", "mark", True, [], None, None, None),
            ("mercury", "planet", True, ["rose"], None, None, None),
            ("mercury", "metal", True, ["boils"], None, 1550, None),
            ("bell", None, True, None, None, None, None),
        ],
        "entry string, entity string, whole boolean, needs array<string>, never array<string>, first int, last int",
    )
    found = M.gated(M.matches(docs, rules.select("entry"), 2), rules, docs)
    got = {(m["doc_id"], m["start"], m["entity"]): m["gate"] for m in found.collect()}
    assert got == {
        (1, 4, "mark"): "accepted",
        (1, 8, "jewel"): "rival",
        (1, 21, "jewel"): "boundary",
        (1, 33, "jewel"): "accepted",
        (2, 0, "jewel"): "validity",
        (3, 4, "mark"): "accepted",
        (3, 8, "jewel"): "blocked",
        (3, 14, "jewel"): "blocked",
        (4, 0, "planet"): "accepted",
        (4, 0, "metal"): "context",
        (4, 14, "planet"): "rival",
        (4, 14, "metal"): "rival",
    }


def test_covered_against_all_pairs():
    r = random.Random(4)
    for _ in range(500):
        rows = sorted({(s, s + r.randint(1, 6), r.choice("xyz")) for s in (r.randint(0, 12) for _ in range(r.randint(0, 14)))}, key=lambda x: (x[0], -x[1], x[2]))
        starts, ends, names = ([x[i] for x in rows] for i in range(3))
        wanted = [i for i, (s, e, n) in enumerate(rows) if any(m != n and a <= s and b >= e for a, b, m in rows)]
        assert sorted(M._covered(starts, ends, names)) == wanted


def by_hand(pairs, blockers):
    weight = defaultdict(float)
    for a, b, w in pairs:
        if a is not None and b is not None and a != b and w is not None:
            weight[min(a, b), max(a, b)] += w
    foes = {(min(a, b), max(a, b)) for a, b in blockers if a != b}
    group = {n: {n} for p in weight for n in p}
    used = []
    for (a, b), w in sorted(weight.items(), key=lambda x: (-x[1], x[0])):
        if group[a] is not group[b]:
            both = group[a] | group[b]
            if any((min(x, y), max(x, y)) in foes for x in both for y in both if x != y):
                continue
            for n in both:
                group[n] = both
        used.append((a, b, w))
    names = {n for a, b, _ in used for n in (a, b)}
    return {(n, min(group[n]), len(group[n]), round(sum(w for a, _, w in used if group[a] is group[n]), 6)) for n in names}


@pytest.mark.parametrize("seed", range(4))
def test_alias_layer_against_pair_by_pair(spark, seed):
    r = random.Random(seed)
    names = [f"n{i:02}" for i in range(60)]
    pairs = [(*r.sample(names, 2), float(r.randint(1, 4))) for _ in range(45)] + [("n01", "n01", 3.0), (None, "n02", 1.0), ("n03", "n04", None)]
    pairs += [(b, a, w) for a, b, w in pairs[:5]]
    blockers = [tuple(r.sample(names, 2)) for _ in range(12 * (seed % 3))] + [("n05", "n05"), ("zz", "n07")]
    found = M.alias_layer(spark.createDataFrame(pairs, "a string, b string, weight double"), spark.createDataFrame(blockers, "a string, b string"))
    assert {(x["name"], x["entity"], x["names"], round(x["weight"], 6)) for x in found.collect()} == by_hand(pairs, blockers)
    none = spark.createDataFrame([], "a string, b string, weight double")
    assert M.alias_layer(none, none.select("a", "b")).collect() == []


def test_queries_without_sql(spark):
    from sediment.queries.matching import lexicon, name_pairs, texts

    entries = {r["entry"] for r in lexicon(spark, FOLDER).collect()}
    wanted = defaultdict(int)
    for r in texts(spark, FOLDER).where("doc_id < 40").collect():
        at = 0
        places = defaultdict(int)
        for s, e, _ in everywhere(r["text"], entries):
            places[s] = max(places[s], e)
        low = "".join(c.lower() if c.isascii() else c for c in r["text"])
        for s in sorted(places):
            if s >= at:
                wanted[low[s : places[s]]] += 1
                at = places[s]
    docs = texts(spark, FOLDER).where("doc_id < 40")
    found = M.longest(M.matches(docs, lexicon(spark, FOLDER))).groupBy("entry").count().collect()
    assert {r["entry"]: r["count"] for r in found} == dict(wanted)
    assert QUERIES["lexicon_longest_mentions"].run(spark, FOLDER).count() >= len(wanted)
    parts = [(r["p_name"], r["p_brand"]) for r in spark.read.parquet(f"{FOLDER}/part.parquet").select("p_name", "p_brand").distinct().collect()]
    blocked = [(f"{a} {x}", f"{a} {y}") for a, x in parts for b, y in parts if a == b and x < y and x[-1] == y[-1]]
    pairs = [(r["a"], r["b"], float(r["weight"])) for r in name_pairs(spark, FOLDER).collect()]
    groups = {(x["name"], x["entity"], x["names"], round(x["weight"], 6)) for x in QUERIES["alias_groups"].run(spark, FOLDER).collect()}
    assert groups == by_hand(pairs, blocked)


@pytest.mark.parametrize("held", [1, 3, 1000])
def test_matches_are_passed_on_piece_by_piece(spark, monkeypatch, held):
    docs = spark.createDataFrame([(i, "abc ab, c abab " * i) for i in range(9)] + [(20, None), (21, "")], "doc_id long, text string").coalesce(1)
    entries = spark.createDataFrame([("ab",), ("abc",), ("b",)], "entry string")
    wanted = Counter((i, e, bool(whole)) for i in range(9) for _ in range(i) for e, whole in (("ab", 0), ("ab", 1), ("ab", 0), ("ab", 0), ("abc", 1), ("b", 0), ("b", 0), ("b", 0), ("b", 0)))
    monkeypatch.setattr(M, "HELD", held)
    every = M.matches(docs, entries).collect()
    assert Counter((r["doc_id"], r["entry"], r["bounded"]) for r in every) == wanted
    whole = M.matches(docs, entries, 0, whole=True).collect()
    assert Counter((r["doc_id"], r["entry"], r["start"], r["end"]) for r in whole) == Counter((r["doc_id"], r["entry"], r["start"], r["end"]) for r in every if r["bounded"])
    assert all(r["near"] == [] for r in whole)
    assert {(r["doc_id"], r["entry"]) for r in M.holding(docs, entries).collect()} == {(i, e) for i, e, _ in wanted}
