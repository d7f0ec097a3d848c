from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from compare import differences
from fixtures import SMALL, edge_rows, edges, empty, prose
from pyspark.sql import functions as F

from sediment.llm import ranking
from sediment.llm.ranking import OP13_SQL, Block, op13_ranked_search, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text: str | None) -> list[str]:
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs: list[tuple], items: list[tuple], k: int = 20) -> Counter:
    """Every item against every document; ranks with item and score, and the documents where no tie leaves a choice."""
    held = [(d, Counter(terms(t))) for d, t in docs]
    total = sum(bool(c) for _, c in held)
    length = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out: Counter = Counter()
    for item, text in items:
        scores = []
        for d, c in held:
            if c:
                m = 100 - 25 + (25 * sum(c.values()) * total) // length
                score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
                if score > 0:
                    scores.append((-score, d is None, d or 0, d))
        out.update((item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scores)[:k]))
    return out


def table(folder: str, name: str, *columns: str) -> list[tuple]:
    return [tuple(r.values()) for r in pq.read_table(f"{folder}/{name}.parquet", columns=list(columns)).to_pylist()]


def test_table_against_brute_force_and_sql(spark):
    wanted = brute(table(SMALL, "documents", "doc_id", "text"), table(SMALL, "benchmark", "item_id", "text"))
    assert Counter(map(tuple, op13_ranked_search(spark, SMALL).collect())) == wanted
    assert differences(spark, op13_ranked_search, OP13_SQL, SMALL) == []


@pytest.mark.parametrize("block, first, k, slice_bytes", [(1 << 20, 1, 3, 1 << 20), (500, 20, 5, 1 << 20), (50, 1, 20, 200), (1, 1, 1, 1 << 20)])
def test_blocks_stops_and_slices(spark, monkeypatch, block, first, k, slice_bytes):
    r = random.Random(k)
    common = prose(9, 30).split()
    docs = [(i, " ".join([*r.choices(common, k=r.randint(0, 30)), *prose(r.randint(0, 40), r.randint(0, 25)).split()])) for i in range(300)]
    items = [(i, " ".join([*r.choices(common, k=4), *prose(i, 6).split()])) for i in range(12)]
    stops = []
    best = Block.best

    def counted(self, item, weight, worth, k, floor):
        rows, scores = best(self, item, weight, worth, k, floor)
        full = self.whole(np.arange(len(self.ids)), worth)
        assert (full[rows] == scores).all()
        left = np.setdiff1d(np.arange(len(self.ids)), rows)
        least = max(floor, np.sort(full)[-k] if len(full) >= k else 0)
        assert (full[left] < max(1, least)).all()
        stops.append(len(rows))
        return rows, scores

    # the same code in this process, where the bounds can be looked at
    monkeypatch.setattr(ranking, "FIRST", first)
    monkeypatch.setattr(Block, "best", counted)
    queries = ranking.Queries([t for _, t in items])
    lists = ranking.postings(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), queries.terms).toArrow().to_batches()
    for b in ranking.blocks(iter(lists), 300, 6000, block):
        for which, times in queries.items:
            worth = np.zeros(len(queries.terms), np.int64)
            worth[which] = 100 * times
            b.best(which, 100 * times, worth, k, 1)
    assert stops
    monkeypatch.undo()
    found = ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), k, slice_bytes)
    assert Counter(map(tuple, found.collect())) == brute(docs, items, k)


def test_edges(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    items = [(1, "one"), (1, "one"), (2, None), (3, ""), (None, prose(1, 5)), (4, "nowhere-at-all"), (5, prose(2, 3000)), (6, "ONE one Été")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("x"))
    wanted = brute(rows, items)
    assert Counter(map(tuple, ranked(edges(spark), asked).collect())) == wanted
    assert ranked(empty(spark), asked).collect() == []
    assert ranked(edges(spark), asked.limit(0)).collect() == []


def test_very_long_items_stay_exact(spark):
    docs = [(i, f"rare{i} " + "word " * (i + 1)) for i in range(30)]
    items = [(1, "word " * 700_000 + "rare3")]
    found = ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(map(tuple, found.collect())) == brute(docs, items)
