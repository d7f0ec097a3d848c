"""Estimates over counted cells, intervals and rounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leave_one_out(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """(cluster, n, mean, change): the mean of ``value`` without each cluster, and how far that is from the mean of all.
    Sums are taken once a cluster; what is left is all sums less the cluster's own."""
    sums = df.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    every = sums.agg(F.sum("_n").alias("_all"), F.sum("_s").alias("_sum"))
    rest = (F.col("_sum") - F.col("_s")) / F.nullif(F.col("_all") - F.col("_n"), F.lit(0))
    return sums.crossJoin(every).select(cluster, (F.col("_all") - F.col("_n")).alias("n"), rest.alias("mean"), (rest - F.col("_sum") / F.col("_all")).alias("change"))  # one row


def concordance(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: concordant and discordant pairs of rows and the share of concordant ones; ties in either are dropped.

    Rows are counted into cells of (x, y) and running sums over the grid of distinct values name, for every cell, the
    rows below it on both scales, so no pair of rows is made. Both columns should have few distinct values."""
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    grid = cells.select("x").distinct().crossJoin(cells.select("y").distinct()).join(cells, ["x", "y"], "left").fillna(0, ["n"])  # distinct values only
    before = Window.partitionBy("y").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    left = grid.withColumn("left", F.coalesce(F.sum("n").over(before), F.lit(0)))
    below, above = (Window.partitionBy("x").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("y"), F.col("y").desc()))
    both = left.select(F.col("n"), F.coalesce(F.sum("left").over(below), F.lit(0)).alias("lower"), F.coalesce(F.sum("left").over(above), F.lit(0)).alias("higher"))
    sums = both.agg(F.sum(F.col("n") * F.col("lower")).alias("concordant"), F.sum(F.col("n") * F.col("higher")).alias("discordant"))
    return sums.withColumn("share", F.col("concordant") / F.nullif(F.col("concordant") + F.col("discordant"), F.lit(0)))


def timeline(df: DataFrame, period: Column, hit: Column) -> DataFrame:
    """(period, rows, hits, coverage): hits of each period and their share of the period's rows."""
    counts = df.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(hit, 1)).alias("hits"))
    return counts.withColumn("coverage", F.col("hits") / F.col("rows"))


def other_names(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(name, entity, other): one hop from an asked name to its entities and on to their other names, all valid at the time
    asked for. ``asked``: name, at; ``names``: entity, name, first, last (both ends included)."""
    valid = (F.col("first") <= F.col("at")) & (F.col("at") <= F.col("last"))
    entities = names.join(asked, "name").where(valid).select("name", "at", "entity").distinct()
    others = names.withColumnRenamed("name", "other")
    return entities.join(others, "entity").where(valid & (F.col("other") != F.col("name"))).select("name", "entity", "other").distinct()


def witness_distance(readings: DataFrame) -> DataFrame:
    """(a, b, shared, distance): 1000 times the weight of units that two witnesses read differently, by the units both have.
    ``readings``: unit, witness, reading, weight; a unit has one reading from each of few witnesses."""
    x = readings.select("unit", F.col("witness").alias("a"), F.col("reading").alias("ra"), "weight")
    y = readings.select("unit", F.col("witness").alias("b"), F.col("reading").alias("rb"))
    both = x.join(y, "unit").where("a < b")
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), (1000 * F.sum(F.when(F.col("ra") != F.col("rb"), F.col("weight")).otherwise(0.0)) / F.count(F.lit(1))).alias("distance"))


def dating(evidence: DataFrame, by: str) -> DataFrame:
    """(by, after, before, consistent) from (by, kind, at): not before the latest hard sign, not after the earliest bound."""
    ends = evidence.groupBy(by).agg(F.max(F.when(F.col("kind") == "after", F.col("at"))).alias("after"), F.min(F.when(F.col("kind") == "before", F.col("at"))).alias("before"))
    return ends.withColumn("consistent", F.coalesce(F.col("after") <= F.col("before"), F.lit(True)))


def weighted_coverage(df: DataFrame, by: str, weight: Column, credit: Column) -> DataFrame:
    """(by, coverage): credited weight by all weight; 0 where there is none."""
    sums = df.groupBy(by).agg(F.sum(weight * credit).alias("_c"), F.sum(weight).alias("_w"))
    return sums.select(by, F.coalesce(F.col("_c") / F.nullif(F.col("_w"), F.lit(0.0)), F.lit(0.0)).alias("coverage"))


def saturation(evidence: DataFrame, round_: str, item: str, source: str, share: float, few: int) -> DataFrame:
    """(round, items, new_items, new_sources, stop): a round adds what no earlier round had; it says stop when new items are
    under ``share`` of all so far and at most ``few`` sources are new. The window runs over rounds."""
    items = evidence.groupBy(item).agg(F.min(round_).alias(round_)).groupBy(round_).agg(F.count(F.lit(1)).alias("new_items"))
    sources = evidence.groupBy(source).agg(F.min(round_).alias(round_)).groupBy(round_).agg(F.count(F.lit(1)).alias("new_sources"))
    rounds = evidence.select(round_).distinct().join(items, round_, "left").join(sources, round_, "left").fillna(0, ["new_items", "new_sources"])
    upto = Window.orderBy(round_).rowsBetween(Window.unboundedPreceding, 0)
    sums = rounds.withColumn("items", F.sum("new_items").over(upto))
    return sums.select(round_, "items", "new_items", "new_sources", ((F.col("new_items") < share * F.col("items")) & (F.col("new_sources") <= few)).alias("stop"))


def hash_chain(df: DataFrame, by: str, order: list[str], payload: Column) -> DataFrame:
    """(by, n, digest): rows of ``by`` in order, each digest the sha256 of the one before it and the row's payload (from 64
    zeros on). A chain is a fold in order; sorted partitions stream through tasks that hold one digest."""
    rows = df.select(F.col(by).cast("string").alias("by"), *order, F.coalesce(payload.cast("string"), F.lit("")).alias("payload"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "by").sortWithinPartitions("by", *order, "payload").select("by", "payload")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count, digest, begun, out = None, 0, "0" * 64, False, []
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not begun or key != now:
                    if begun:
                        out.append((now, count, digest))
                    now, count, digest, begun = key, 0, "0" * 64, True
                count, digest = count + 1, hashlib.sha256((digest + value).encode()).hexdigest()
            if len(out) > 1000:
                yield _chains(out)
                out = []
        if begun:
            yield _chains([*out, (now, count, digest)])

    return dealt.mapInArrow(fold, "by string, n long, digest string")


def _chains(rows: list[tuple]) -> pa.RecordBatch:
    keys, counts, digests = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], names=["by", "n", "digest"])


def clusters(vectors: DataFrame, k: int, seed: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster) by k-means with k-means|| starts."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
    return model.transform(rows).select(key, F.col("cluster").cast("int").alias("cluster"))
