from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from fixtures import SMALL, edge_rows, edges, empty

from sediment.llm.sharding import cut_rows, op9_shard_documents, shard_documents


def held(rows, texts: list[tuple], shards: int) -> None:
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted((d is None, d or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts)
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < shards and r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_table(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    held(op9_shard_documents(spark, SMALL).collect(), texts, 40)


def test_groups_come_together(spark):
    texts = [(i, f"text of group {i % 30}" if i < 300 else f"single {i}") for i in range(2000)]
    sharded = shard_documents(spark.createDataFrame(texts, "doc_id long, text string"), shards=8)
    linked, cut = cut_rows(sharded, 8).first()
    assert linked == 300 and cut <= 20
    rows = sharded.collect()
    held(rows, texts, 8)
    of = {i: t for i, t in texts}
    groups = defaultdict(Counter)
    for r in rows:
        groups[of[r["doc_id"]]][r["shard"]] += 1
    whole = [g for g in groups.values() if sum(g.values()) > 1]
    assert sum(len(g) == 1 for g in whole) >= 0.9 * len(whole)


def test_one_group_larger_than_a_shard(spark):
    texts = [(i, "same" if i % 3 == 0 else f"single {i}") for i in range(900)]
    rows = shard_documents(spark.createDataFrame(texts, "doc_id long, text string"), shards=10).collect()
    held(rows, texts, 10)
    shards_of_group = {r["shard"] for r in rows if r["doc_id"] % 3 == 0}
    assert len(shards_of_group) <= 5


def test_edges(spark):
    held(shard_documents(edges(spark), shards=4).collect(), [(r[0], r[1]) for r in edge_rows()], 4)
    assert shard_documents(empty(spark)).collect() == []


def test_equal_rows_are_dealt_out(spark):
    texts = [(5, "one row")] * 500 + [(i, f"single {i}") for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    rows = shard_documents(docs, shards=6).collect()
    held(rows, texts, 6)
    linked, cut = cut_rows(shard_documents(docs, shards=6), 6).first()
    assert linked == 500 and cut <= 10
    assert cut_rows(shard_documents(empty(spark))).first() == (0, 0)
