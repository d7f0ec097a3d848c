"""Visits and events in order: transitions, sessions, patterns, bursts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.records import kept
from . import overlap


def transitions(visits: DataFrame) -> DataFrame:
    """(a, b, n, p, base, lift) over (case, visit, item), items once a visit: n counts a in a visit and b in the next one;
    p = n / visits with a that have a next one; base = share of next visits that hold b."""
    order = visits.select("case", "visit").distinct().withColumn("next_visit", F.lead("visit").over(Window.partitionBy("case").orderBy("visit"))).where("next_visit is not null")
    here = visits.join(order, ["case", "visit"]).select("case", "next_visit", F.col("item").alias("a"))
    there = visits.join(order.select("case", F.col("next_visit").alias("visit")), ["case", "visit"]).select("case", F.col("visit").alias("next_visit"), F.col("item").alias("b"))
    n = here.join(there, ["case", "next_visit"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    before, after = here.groupBy("a").agg(F.count(F.lit(1)).alias("na")), there.groupBy("b").agg(F.count(F.lit(1)).alias("nb"))
    out = n.join(before, "a").join(after, "b").crossJoin(order.agg(F.count(F.lit(1)).alias("steps")))
    p, base = F.col("n") / F.col("na"), F.col("nb") / F.col("steps")
    return out.select("a", "b", "n", p.alias("p"), base.alias("base"), (p / base).alias("lift"))


def prefixspan(visits: DataFrame, min_support: int, max_length: int = 4) -> DataFrame:
    """(pattern, support): sequences of items, each in a strictly later visit than the one before, in at least ``min_support``
    cases. Grows by one item a round: each case keeps the earliest visit where the pattern ends, which is all that later
    items need, so a round is one join and one aggregation."""
    items = visits.select("case", "visit", "item").distinct()
    ends = items.groupBy("case", "item").agg(F.min("visit").alias("at")).select("case", F.array("item").alias("pattern"), "at")
    found = None
    for length in range(1, max_length + 1):
        support = ends.groupBy("pattern").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= min_support)
        found = support if found is None else found.unionByName(support)
        if length < max_length:
            live = ends.join(support.select("pattern"), "pattern", "left_semi")
            ends = live.join(items, "case").where("visit > at").groupBy("case", F.array_append("pattern", F.col("item")).alias("pattern")).agg(F.min("visit").alias("at"))
    return found


def sessions(events: DataFrame, by: str, ts: str, gap: str) -> DataFrame:
    """(by, start, end, n): stretches of events no further apart than ``gap``."""
    return events.groupBy(by, F.session_window(F.col(ts), gap).alias("w")).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n")).drop("w")


def bursts(events: DataFrame, by: str, ts: str, seconds: int, least: int) -> DataFrame:
    """Events that have ``least`` or more of their group in the ``seconds`` up to them."""
    w = Window.partitionBy(by).orderBy("_s").rangeBetween(-seconds, 0)
    marked = events.withColumn("_s", F.unix_timestamp(F.col(ts).cast("timestamp"))).withColumn("in_window", F.count(F.lit(1)).over(w)).drop("_s")
    return marked.where(F.col("in_window") >= least)


def limited(events: DataFrame, by: str, ts: str, order: list[str], per_minute: int) -> DataFrame:
    """Adds ``allowed``: the first ``per_minute`` of each caller's minute."""
    minute = F.date_trunc("minute", F.col(ts))
    return events.withColumn("allowed", F.row_number().over(Window.partitionBy(by, minute).orderBy(*order)) <= per_minute)


def similar_cases(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, case, similarity): the ``k`` most similar cases by shared squared weights over the root of the products of their
    sums; weight ln((N + 1) / (df + 1)) + 1. ``items``: (case, item), each once; ``queries``: rows of it, of which the case is
    taken. All queries meet all cases, as tiles of matrices, and only the best of each tile are shuffled."""
    n = items.agg(F.countDistinct("case").alias("N"))
    weight = items.groupBy("item").agg(F.count(F.lit(1)).alias("df")).crossJoin(n).select("item", (F.ln((F.col("N") + 1) / (F.col("df") + 1)) + 1).alias("w"))
    weighted = items.join(weight, "item").withColumn("w2", F.col("w") * F.col("w"))
    held = kept(weighted.groupBy("case").agg(F.collect_list(F.struct(F.col("item").cast("string").alias("item"), "w2")).alias("x"), F.sum("w2").alias("size")).select("case", F.col("x.item").alias("items"), F.col("x.w2").alias("weights"), "size"), "cases")
    asked = held.join(queries.select("case").distinct(), "case", "left_semi").select(F.col("case").alias("query"), "items", "size")
    scored = overlap.best(asked, held, k, False).withColumnRenamed("score", "similarity")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), "case")
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("query", "case", "similarity")
