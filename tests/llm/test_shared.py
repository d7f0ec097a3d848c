from __future__ import annotations

import random

import pytest

from sediment.llm.shared import components, discard, with_rank, written


def test_ranks_are_gapless(spark):
    from pyspark.sql import functions as F

    df = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2).alias("g"), F.xxhash64(F.col("id") % 100).alias("h"))
    rows = with_rank(df, ["g"], "h", "r", ["id"]).collect()
    for g in (None, 0, 1):
        own = sorted((r for r in rows if r["g"] == g), key=lambda r: r["r"])
        assert [r["r"] for r in own] == list(range(len(own)))
        assert [(r["h"], r["id"]) for r in own] == sorted((r["h"], r["id"]) for r in own)


@pytest.mark.parametrize("kind", ["chain", "random", "none"])
def test_components(spark, kind):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(150)] if kind == "chain" else [(r.randrange(300), r.randrange(300)) for _ in range(200)] if kind == "random" else []
    found = {x["id"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(len(least)):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert found == least


def test_written_tables_can_go(spark):
    df = written(spark.range(10))
    files = df.inputFiles()
    assert df.count() == 10
    discard(df)
    import os

    assert not any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in files)
