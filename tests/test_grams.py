from __future__ import annotations

import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

from sediment.functions import text as T


@pytest.mark.parametrize("piece", [1, 5, 1 << 20])
def test_grams_are_counted_piece_by_piece(spark, monkeypatch, piece):
    monkeypatch.setattr(T, "PIECE", piece)
    texts = ["abab", "a", "", None, "é\U0001f600a", "ab", "bbbbbbbb"]
    found = T.char_ngram_counts(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), 2).collect()
    assert {r["gram"]: r["n"] for r in found} == Counter(t[i : i + 2] for t in texts if t for i in range(len(t) - 1))


def test_bare_grams_are_counted_piece_by_piece(spark, monkeypatch):
    from sediment.catalog import QUERIES

    query = QUERIES["bare_bigrams"]
    whole = {tuple(r) for r in query.run(spark, "/root/testdata/sf0.001").collect()}
    monkeypatch.setattr(T, "PIECE", 1000)
    assert {tuple(r) for r in query.run(spark, "/root/testdata/sf0.001").collect()} == whole != set()


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("piece", [1, 2, 3, 7])
def test_grams_of_texts_longer_than_a_piece(spark, monkeypatch, piece, n):
    monkeypatch.setattr(T, "PIECE", piece)
    texts = ["abcabcabcabcab", None, "", "ab", "\U0001f600é" * 7, "aaaaaaa", "aaaaaaaa", "abc"]
    found = T.char_ngram_counts(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), n).collect()
    assert {r["gram"]: r["n"] for r in found} == Counter(t[i : i + n] for t in texts if t for i in range(len(t) - n + 1))


def test_memory_does_not_grow_with_a_text(spark):
    class Texts:
        """Keeps the step of a task, so that it runs here."""

        def mapInArrow(self, step, schema):
            self.step = step
            return spark.createDataFrame([], schema)

    texts = Texts()
    T.char_ngram_counts(texts, 2)
    batch = pa.record_batch([pa.array(["ab" * (1 << 23)])], ["text"])
    tracemalloc.start()
    try:
        counts = Counter()
        for found in texts.step(iter([batch])):
            counts.update({r["gram"]: r["n"] for r in found.to_pylist()})
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert counts == {"ab": 1 << 23, "ba": (1 << 23) - 1}
    assert most < 200 << 20
