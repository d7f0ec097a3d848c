from __future__ import annotations

import random

import pytest
from fixtures import SMALL, VOCABULARY, edges, empty, prose

from sediment.llm.decontamination import RADIUS, Index, _laid, benchmark_hits, decontaminated, fingerprints, indexes, op7_decontamination
from sediment.llm.words import ALNUM, Words, shingled

ITEMS = [(i, prose(1000 + i, n)) for i, n in enumerate([6, 9, 20, 33, 70, 150, 300])]


def changed(text: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) if r.random() < share else w for w in text.split())


def test_planted_items_are_found_and_others_left(spark):
    rows, wanted = [], set()
    for i, text in ITEMS:
        for copy, own in enumerate((text, text.upper(), text.replace(" ", ",  "))):
            doc = 100 * i + copy
            rows.append((doc, f"{prose(doc, 80)} {own} {prose(doc + 7, 80)}"))
            wanted.add((doc, i))
    rows += [(5000 + i, prose(7000 + i, 200)) for i in range(60)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in benchmark_hits(docs, benchmark).collect()} == wanted
    assert {r["doc_id"] for r in decontaminated(docs, benchmark).collect()} == {d for d, _ in rows} - {d for d, _ in wanted}


def test_near_copies_of_long_items(spark):
    index = Index(ITEMS)
    import pyarrow as pa

    for item, text in ITEMS[3:]:
        own = text.split()
        own[len(own) // 2] = "other"
        hits = index.search(pa.array([f"{prose(1, 90)} {' '.join(own)} {prose(2, 90)}", changed(text, 3, 0.5), None, ""]))
        similarity = index.similarity(item, shingled(Words(*_laid([text]), ALNUM).hash, 5))
        assert similarity == 1
        assert [(r, i) for r, i, *_ in hits] == ([(0, item)] if len(own) >= 60 else [(r, i) for r, i, *_ in hits])


def test_search_finds_every_fingerprint_within_the_radius():
    r = random.Random(5)
    index = Index([(0, prose(1, 64))])
    prints, _, _, tables = index.widths[64]
    for _ in range(300):
        value = int(prints[0])
        for bit in r.sample(range(64), r.randint(0, RADIUS)):
            value ^= 1 << bit
        import numpy as np

        blocks = np.array([value], np.uint64).view(np.uint16)
        assert any(has[b] for (_, _, has, _), b in zip(tables, blocks))


def test_fingerprints_are_simhashes():
    import numpy as np

    h = np.random.default_rng(1).integers(0, 2**64, 50, np.uint64)
    for width in (1, 5, 16, 50):
        got = fingerprints(h, width, {})
        for i in range(len(h) - width + 1):
            bits = np.unpackbits(h[i : i + width].view(np.uint8)).reshape(width, 64)
            assert np.packbits(2 * bits.sum(0, dtype=int) > width).view(np.uint64)[0] == got[i]


def test_verbatim_items_of_the_table(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    wanted = {(d["doc_id"], b["item_id"]) for d in docs for b in items if d["text"] and b["text"] and b["text"] in d["text"]}
    found = {(r["doc_id"], int(i)) for r in op7_decontamination(spark, SMALL).collect() for i in r["item_ids"].split(",")}
    assert wanted <= found


@pytest.mark.parametrize("which", ["docs", "items", "both"])
def test_edges(spark, which):
    items = spark.createDataFrame([(1, None), (2, ""), (3, " ... "), (None, prose(1, 60)), (5, prose(1, 60))], "item_id long, text string")
    docs = empty(spark) if which in ("docs", "both") else edges(spark)
    items = items.limit(0) if which in ("items", "both") else items
    out = decontaminated(docs, items)
    assert out.columns == docs.columns
    if which == "docs":
        assert out.collect() == []
    if which == "items":
        assert out.count() == 14
    if which == "both":
        assert benchmark_hits(docs, items).collect() == []
    if which == "items":
        return
    found = {(r["doc_id"], r["item_id"]) for r in benchmark_hits(edges(spark), items).collect()} if which == "docs" else set()
    assert found in (set(), {(4, None), (4, 5), (5, None), (5, 5)})


def brute(docs: list[tuple], items: list[tuple], k: int = 5) -> dict:
    """(doc_id, item_id) to the best weighted similarity of all spans of about the item's length."""
    import math
    from collections import Counter

    def bag(words):
        return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else Counter([tuple(words)])

    bags = {i: bag(t.lower().split()) for i, t in items}
    df = Counter(x for b in bags.values() for x in b)
    n, out = len(items), {}
    for doc, text in docs:
        words = text.lower().split()
        for item, t in items:
            own, size, best = bags[item], len(t.split()), 0.0
            for a in range(len(words)):
                for b in (a + size - 1, a + size, a + size + 1):
                    if a < b <= len(words):
                        other = bag(words[a:b])
                        if own.keys() & other.keys():
                            w = {x: 1 + math.log(n / df[x]) if x in own else 1 + math.log(n) for x in own.keys() | other.keys()}
                            best = max(best, sum(w[x] * min(own[x], other[x]) for x in w) / sum(w[x] * max(own[x], other[x]) for x in w))
            if best >= 0.8:
                out[doc, item] = best
    return out


def planted() -> list[tuple]:
    rows = []
    for i, text in ITEMS:
        own = text.split()
        if len(own) >= 60:
            own[len(own) // 3] = "other"
        twice = f"{' '.join(own)} {prose(50 + i, 30)} {text}"
        rows += [(10 * i, f"{prose(i, 40)} {' '.join(own)} {prose(i + 9, 12)}"), (10 * i + 1, twice), (10 * i + 2, changed(text, i, 0.4))]
    return rows


def test_hits_are_those_of_brute_force(spark):
    docs, benchmark = spark.createDataFrame(planted(), "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    wanted = brute(planted(), ITEMS)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in benchmark_hits(docs, benchmark).collect()}
    assert set(got) == set(wanted)
    assert got == pytest.approx(wanted)


def test_slices_change_nothing(spark):
    docs, benchmark = spark.createDataFrame(planted(), "doc_id long, text string"), spark.createDataFrame(ITEMS + [(99, ITEMS[3][1])], "item_id long, text string")
    assert len(list(indexes(benchmark, slice_bytes=1500))) > 2
    whole, cut = (sorted(benchmark_hits(docs, benchmark, slice_bytes=b).collect()) for b in (1 << 20, 1500))
    assert whole == cut
    left = [sorted(r["doc_id"] for r in decontaminated(docs, benchmark, slice_bytes=b).collect()) for b in (1 << 20, 1500)]
    assert left[0] == left[1]


def test_any_column_names_and_bounded_slices(spark, tmp_path):
    items = [(i, prose(100 + i, 40)) for i in range(40)]
    rows = [(i, prose(i, 50) + (" " + items[i][1] if i % 3 == 0 else ""), "x", None) for i in range(40)]
    names = ["doc_id", "text", "a.b", "n`w"]
    docs = spark.createDataFrame(rows, "a long, b string, c string, d double").toDF(*names)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 400):
        left = decontaminated(docs, benchmark, slice_bytes=size)
        assert left.columns == names and sorted(tuple(r) for r in left.collect()) == [r for r in rows if r[0] % 3]
        assert {(r["doc_id"], r["item_id"]) for r in benchmark_hits(docs, benchmark, slice_bytes=size).collect()} == {(i, i) for i in range(40) if i % 3 == 0}
    # however many slices: the plan holds one index at most, what others found lies in written tables
    many = benchmark_hits(docs, benchmark, slice_bytes=400)
    assert len(list(indexes(benchmark, slice_bytes=400))) >= 20
    assert many._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 0
