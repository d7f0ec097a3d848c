from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

from sediment.operators.rediscovery import ranker_summary, rediscovery


def by_hand(links, cutoffs, k):
    first = {}
    for a, b, at in links:
        if a is not None and b is not None and at is not None and a != b:
            pair = (min(a, b), max(a, b))
            first[pair] = min(first.get(pair, at), at)
    out = set()
    for cutoff in cutoffs:
        past = {p for p, at in first.items() if at < cutoff}
        near: dict = {}
        for a, b in past:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        scores = {}
        for a in near:
            for b in near:
                common = near[a] & near[b]
                if a < b and common and (a, b) not in past:
                    scores[a, b] = {"common": len(common), "adamic_adar": round(sum(1 / math.log(len(near[c]) + 1) for c in common), 9), "allocation": round(sum(1 / len(near[c]) for c in common), 9), "popularity": len(near[a]) * len(near[b]), "chance": int(hashlib.md5(f"{a}-{b}".encode()).hexdigest()[:8], 16)}
        true = {p for p in scores if first.get(p, "") >= cutoff}
        for ranker in ("common", "adamic_adar", "allocation", "popularity", "chance"):
            best = sorted(scores, key=lambda p: (-scores[p][ranker], p))[:k]
            hits = sum(p in true for p in best)
            out.add((cutoff, ranker, len(scores), len(true), hits, hits / len(best) if best else None))
    return out


def test_against_all_pairs(spark):
    r = random.Random(1)
    links = [(r.randint(0, 25), r.randint(0, 25), f"2000-{r.randint(1, 12):02}") for _ in range(160)] + [(None, 1, "2000-01"), (1, 2, None), (3, 3, "2000-01")]
    table = spark.createDataFrame(links, "a long, b long, at string")
    cutoffs = ["1999-01", "2000-05", "2000-09"]
    found = rediscovery(table, cutoffs, 7)
    assert {tuple(x) for x in found.collect()} == by_hand(links, cutoffs, 7)
    summary = {s["ranker"]: s for s in ranker_summary(found).collect()}
    assert len(summary) == 5 and all(s["cutoffs"] == 2 for s in summary.values()) and (summary["chance"]["better"], summary["chance"]["worse"], summary["chance"]["p"]) == (0, 0, 1.0)
    assert Counter(x["candidates"] for x in rediscovery(table.limit(0), ["2000-05"]).collect()) == {0: 5}
