"""Graphs as edge tables: co-occurrence, link prediction, components, closure, rankings, communities."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.records import shared_folder


def _kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, so that loops don't grow their plans."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def link_prediction(edges: DataFrame) -> DataFrame:
    """(a, b, common, adamic_adar, allocation): unlinked pairs a < b with common neighbours; weights are ignored."""
    both = symmetric(edges)
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("deg")).withColumnRenamed("a", "mid")
    left, right = both.select("a", F.col("b").alias("mid")), both.select(F.col("a").alias("b"), F.col("b").alias("mid"))
    paths = left.join(right, "mid").where("a < b").join(degree, "mid")
    scored = paths.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.sum(1 / F.ln(F.col("deg") + 1)).alias("adamic_adar"), F.sum(1 / F.col("deg")).alias("allocation"))
    return scored.join(both, ["a", "b"], "left_anti")


def hits_at(predicted: DataFrame, truth: DataFrame, score: str, k: int) -> DataFrame:
    """One row: hits among the ``k`` best predictions and precision."""
    best = predicted.orderBy(F.desc(F.round(score, 9)), "a", "b").limit(k)
    found = best.join(truth, ["a", "b"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    return found.withColumn("precision", F.col("hits") / k)


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component): the smallest id that edges reach. Labels spread to neighbours and jump to their label's label;
    each round is written, and the loop ends when none changes, or with an error after ``rounds``."""
    both = _kept(symmetric(edges))
    labels = _kept(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels.id == near.a).select("id", "component", F.least("component", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("far"))
        moved = _kept(lower.join(jump, "low", "left").select("id", F.least("low", F.coalesce("far", "low")).alias("new"), "component"))
        done = moved.where("new <> component").isEmpty()
        labels = moved.select("id", F.col("new").alias("component"))
        if done:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def closure(edges: DataFrame, child: str, parent: str, depth: int = 60) -> DataFrame:
    """(child, ancestor, steps): every ancestor with the fewest steps to it; an error if there are more than ``depth``."""
    base = edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor")).distinct()
    reached = _kept(base.withColumn("steps", F.lit(1)))
    front = reached
    for step in range(2, depth + 1):
        up = base.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("further"))
        new = front.join(up, "ancestor").select("child", F.col("further").alias("ancestor")).distinct().join(reached, ["child", "ancestor"], "left_anti").withColumn("steps", F.lit(step))
        front = _kept(new)
        if front.isEmpty():
            return reached
        reached = reached.unionByName(front)
    raise RuntimeError(f"ancestors go on beyond {depth} steps")


def canon_score(citations: DataFrame) -> DataFrame:
    """(cited, citing, periods, volume, score) of (citing, cited, period, weight): 10 log2(1 + citing works) + 2 periods
    + 2 log2(1 + volume)."""
    out = citations.groupBy("cited").agg(F.countDistinct("citing").alias("citing"), F.countDistinct("period").alias("periods"), F.sum("weight").alias("volume"))
    return out.withColumn("score", 10 * F.log2(1 + F.col("citing")) + 2 * F.col("periods") + 2 * F.log2(1 + F.col("volume")))


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, label) after synchronous rounds on weighted edges (a, b, w): the label of the greatest weight among neighbours, ties
    to the smallest. It takes just ``rounds`` rounds, settled or not, and may end elsewhere than a sequential walk over nodes."""
    both = _kept(edges.select("a", "b", "w").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    labels = both.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id"), "label").agg(F.sum("w").alias("w"))
        top = votes.groupBy("id").agg(F.max("w").alias("top"))
        labels = _kept(votes.join(top, "id").where("w = top").groupBy("id").agg(F.min("label").alias("label")))
    return labels


def opposed(assertions: DataFrame) -> DataFrame:
    """(subject, key, left, right): pairs of sources whose signs for the same subject and key are opposite."""
    x = assertions.select("subject", "key", F.col("source").alias("left"), F.col("sign").alias("s"))
    y = assertions.select("subject", "key", F.col("source").alias("right"), F.col("sign").alias("t"))
    return x.join(y, ["subject", "key"]).where("left < right and s * t < 0").select("subject", "key", "left", "right")


def worst_status(checks: DataFrame, by: str) -> DataFrame:
    """(by, status): fail < pending < warn < pass < not_applicable; the lowest wins."""
    order = F.array(*[F.lit(s) for s in ("fail", "pending", "warn", "pass", "not_applicable")])
    return checks.groupBy(by).agg(F.min(F.array_position(order, F.col("status"))).alias("_r")).select(by, F.element_at(order, F.col("_r").cast("int")).alias("status"))


def intermediaries(edges: DataFrame) -> DataFrame:
    """(middle, paths): two-step paths citing -> middle -> cited whose ends are not joined themselves. The paths through a
    node are counted as pairs of its neighbours less those that are joined, each joined pair once for every middle."""
    e = edges.select("citing", "cited").distinct()
    into, out = e.groupBy(F.col("cited").alias("middle")).agg(F.count(F.lit(1)).alias("i")), e.groupBy(F.col("citing").alias("middle")).agg(F.count(F.lit(1)).alias("o"))
    back = e.join(e.select(F.col("citing").alias("cited"), F.col("cited").alias("citing")), ["citing", "cited"], "left_semi").groupBy(F.col("cited").alias("middle")).agg(F.count(F.lit(1)).alias("returns"))
    direct = e.select(F.col("citing").alias("a"), F.col("cited").alias("c"))
    closed = direct.join(e.select(F.col("citing").alias("a"), F.col("cited").alias("middle")), "a").join(e.select(F.col("citing").alias("middle"), F.col("cited").alias("c")), ["middle", "c"]).where("a <> c").groupBy("middle").agg(F.count(F.lit(1)).alias("closed"))
    pairs = into.join(out, "middle").join(back, "middle", "left").join(closed, "middle", "left")
    paths = F.col("i") * F.col("o") - F.coalesce("returns", F.lit(0)) - F.coalesce("closed", F.lit(0))
    return pairs.select("middle", paths.alias("paths")).where("paths > 0")
