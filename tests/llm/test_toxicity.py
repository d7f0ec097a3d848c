from __future__ import annotations

import zlib

import pytest
from fixtures import edge_rows, edges, empty
from pyspark.sql import functions as F

from sediment.llm.toxicity import op5_toxicity, toxicity, train

#: The smaller tables hold too few labelled toxic rows to learn from.
FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    return op5_toxicity(spark, FOLDER).collect()


def test_one_row_each(spark, scored):
    ids = sorted(r[0] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect())
    assert sorted(r["doc_id"] for r in scored) == ids
    for r in scored:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_held_out_accuracy(spark, scored):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    held = [(r["score"], labels[r["doc_id"]]) for r in scored if r["held_out"] and r["doc_id"] in labels]
    bad, good = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / (len(bad) * len(good))
    assert auc >= 0.85


def test_held_out_labels_are_not_read(spark, scored):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r["doc_id"]: r["score"] for r in toxicity(docs, train(docs, turned)).collect()} == {r["doc_id"]: r["score"] for r in scored}


def test_edges(spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 0), (None, 1), (6, None), (99, 1)], "doc_id long, toxic int")
    model = train(edges(spark), labels)
    rows = toxicity(edges(spark), model).collect()
    assert len(rows) == len(edge_rows())
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    assert toxicity(empty(spark), train(empty(spark), labels.limit(0))).collect() == []
