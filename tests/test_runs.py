"""What goes between tasks when runs of words are counted and held against others."""

from __future__ import annotations

import math
from collections import Counter

from sediment.operators import lexicon as L
from sediment.operators import transmission as X
from sediment.sources.records import kept


def test_pairs_go_to_their_counts_once(spark):
    texts = {1: "a b a b a", 2: "the a b", 3: "one", 4: "", 5: None, 6: "b a b a a a"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    made = L.bigram_model(docs)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2 and "Join Inner, (pair" not in plan
    words = {d: (t or "").split() for d, t in texts.items()}
    pairs = Counter(p for w in words.values() for p in zip(w, w[1:]))
    heads, v = Counter(p[0] for p in pairs.elements()), len({x for w in words.values() for x in w})
    wanted = {d: [math.log((pairs[p] + 1) / (heads[p[0]] + v)) for p in zip(w, w[1:])] for d, w in words.items() if len(w) > 1}
    found = {r["doc_id"]: (r["pairs"], round(r["mean_log"], 9)) for r in made.collect()}
    assert found == {d: (len(x), round(sum(x) / len(x), 9)) for d, x in wanted.items()}


def test_runs_that_stand_once_are_left_where_they_are_counted(spark, monkeypatch):
    common = " ".join(f"c{'abcdefghij'[i]}" for i in range(10))
    rows = [("w1", 1, 1, "own words of the first text here " + common), ("w2", 2, 2, common + " and other words that nobody else has"), ("w3", 3, 3, "nothing in common with any of the others at all")]
    passages = spark.createDataFrame(rows, "work string, passage long, at long, text string")
    written = {}
    monkeypatch.setattr(X, "kept", lambda df, name: written.setdefault(name, kept(df, name)))
    found = X.quotations(passages)
    assert written["runs"].count() == 10  # five runs of six words, in two passages
    assert [tuple(r) for r in found.collect()] == [("w2", 2, 0, 10, "w1", 1, 7)]


def test_only_runs_of_a_source_are_grouped(spark):
    docs = spark.createDataFrame([(1, "x a b c d a b c y"), (2, "p q r s"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "a b c d")], "item_id long, text string")
    found = L.reuse_features(docs, asked)
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(7, 1, 2, 1.0, 4, 1.0)]
