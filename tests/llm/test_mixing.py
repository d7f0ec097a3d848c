from __future__ import annotations

from collections import defaultdict

import pytest
from fixtures import SMALL, WORD, edges, empty, prose

from pyspark.sql import functions as F

from sediment.llm.mixing import mix_sources, mixed, op1_mix_sources


def targets(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped: set = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        free = sum(w[s] for s in order if s not in capped)
        new = {s for s in order if s not in capped and free and left * w[s] / free > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in capped else left * w[s] / free for s in order}
        capped |= new


def held(rows, close: float = 1.0) -> None:
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == r["copies"] * r["size"]
    wanted = targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(wanted[r["source"]], rel=1e-9)
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= close * max(largest[s], 1), (s, taken[s], wanted[s])


def test_targets_are_met(spark):
    rows = op1_mix_sources(spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == {d: len(WORD.findall(t or "")) for d, t in texts.items()}
    held(rows)


def test_reruns_agree(spark):
    docs = spark.createDataFrame([(i, f"s{i % 4}", prose(i, 5 + i % 70)) for i in range(400)], "doc_id long, source string, text string")
    one = sorted(mix_sources(docs).collect())
    two = sorted(mix_sources(docs.repartition(7)).collect())
    assert one == two
    held(one)


def test_a_source_with_a_third_of_all_rows_and_one_at_its_cap(spark):
    docs = spark.createDataFrame([(i, "hot" if i % 3 else f"s{i % 5}", prose(i, 40)) for i in range(300)] + [(1000, "a", "few words only")], "doc_id long, source string, text string")
    rows = mix_sources(docs).collect()
    held(rows)
    assert next(r for r in rows if r["doc_id"] == 1000)["copies"] == 3


def test_edges(spark):
    rows = mix_sources(edges(spark)).collect()
    assert len(rows) == 14
    assert all(r["taken"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    held(rows)
    assert mix_sources(empty(spark)).collect() == []
    assert mixed(empty(spark)).collect() == []


def test_the_mix_repeats_rows(spark):
    docs = edges(spark)
    counts = {}
    for r in mix_sources(docs.select("doc_id", "source", "text")).collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + r["copies"]
    got = {}
    out = mixed(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {d: n for d, n in counts.items() if n}


def test_equal_rows_do_not_move_together(spark):
    docs = spark.createDataFrame([(1, "a", "four words of text")] * 600 + [(i, "b", prose(i, 30)) for i in range(2, 60)] + [(i, "c", prose(i, 20)) for i in range(60, 130)], "doc_id long, source string, text string")
    rows = mix_sources(docs).collect()
    assert len(rows) == 728
    held(rows)
    got = sum(r["taken"] for r in rows if r["doc_id"] == 1)
    want = next(r["target"] for r in rows if r["doc_id"] == 1)
    assert abs(got - want) <= 4
    assert len({r["copies"] for r in rows if r["doc_id"] == 1}) == 2
    repeated = mixed(docs).groupBy("doc_id").count().collect()
    assert dict(repeated)[1] * 4 == got


def test_extra_columns_with_names_of_our_own_stay(spark):
    docs = edges(spark)
    for c in ("_d", "_g", "_k", "_copy", "_h", "_u", "_size", "copies", "rate", "SIZE_", "_s.t"):
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    out = mixed(docs)
    assert out.columns == docs.columns
    assert {tuple(r[docs.columns.index("_d") :]) for r in out.collect()} == {tuple(f"own {c}" for c in docs.columns[docs.columns.index("_d") :])}
