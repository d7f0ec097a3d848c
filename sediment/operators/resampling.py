"""Resampling by seeded hashes, so that every run, engine and partitioning draws the same samples; smoothing, rank tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.stats import _log_gamma
from ..sources.records import dealt, kept

#: Distribution function of the Poisson law with mean 1 at 0, 1, ..., 7.
POISSON = (0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)


def draw(*parts: Column | str) -> Column:
    """A number in [0, 2**32) from the digest of ``parts``."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def _hex(*parts: Column | str) -> Column:
    """``draw`` as its eight hexadecimal digits, which sort as the number does and cost no conversion."""
    return F.substring(F.md5(F.concat_ws("-", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])), 1, 8)


def relabelled(units: DataFrame, group: str, rounds: int, unit: str = "unit") -> DataFrame:
    """``units`` once a round with ``round`` and ``drawn``: as many rows are drawn as are in the group (a boolean), those with
    the smallest hashes of unit and round. Round 0 is the data as it is.

    Hashes are counted in 4,096 ranges a round, which tells in which range the last row drawn lies; rows under it are drawn,
    rows over it aren't, and only those in it are ranked. So no task holds the units of a round. Units are dealt before they
    are hashed, as a small file of them is one task's otherwise."""
    units = kept(units, "units")
    units = dealt(units, units.count() * rounds // 16, unit)  # rows are made one by one, few are held
    size = units.agg(F.count(F.when(F.col(group), 1)).alias("_k"))
    every = units.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("_h", _hex(unit, "round")).withColumn("_b", F.substring("_h", 1, 3))
    counts = every.groupBy("round", "_b").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy("round").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = counts.withColumn("_before", ahead).crossJoin(size).where((F.col("_before") <= F.col("_k")) & (F.col("_before") + F.col("_n") > F.col("_k")))  # one row
    edge = edge.select("round", F.col("_b").alias("_edge"), (F.col("_k") - F.col("_before")).alias("_more"))  # a row a round, none where all are drawn
    both = every.join(F.broadcast(edge), "round", "left")
    rank = F.row_number().over(Window.partitionBy("round").orderBy("_h", unit))
    inside = both.where(F.col("_b") == F.col("_edge")).withColumn("drawn", rank <= F.col("_more"))
    rest = both.where(~F.coalesce(F.col("_b") == F.col("_edge"), F.lit(False))).withColumn("drawn", F.coalesce(F.col("_b") < F.col("_edge"), F.lit(True)))
    seen = units.withColumn("round", F.lit(0)).withColumn("drawn", F.col(group))
    columns = [*units.columns, "round", "drawn"]
    return seen.select(*columns).unionByName(inside.select(*columns)).unionByName(rest.select(*columns))


def permutation_test(units: DataFrame, value: str, group: str, rounds: int = 200, unit: str = "unit") -> DataFrame:
    """One row: difference of means of the group and the rest, and the two-sided p of ``rounds`` relabellings."""
    mean = F.avg(F.when(F.col("drawn"), F.col(value))) - F.avg(F.when(~F.col("drawn"), F.col(value)))
    by = relabelled(units, group, rounds, unit).groupBy("round").agg(mean.alias("d"))
    seen = by.where("round = 0").select(F.col("d").alias("difference"))
    both = by.where("round > 0").crossJoin(seen)
    return both.groupBy("difference").agg(((F.count(F.when(F.abs("d") >= F.abs("difference") - 1e-9, 1)) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def max_statistic(items: DataFrame, units: DataFrame, group: str, rounds: int = 100, unit: str = "unit") -> DataFrame:
    """(item, gap, p): the gap between an item's share of units in the group and outside, and the share of relabellings whose
    largest gap over all items is as large."""
    sets = items.select(unit, "item").distinct().groupBy(unit).agg(F.collect_list("item").alias("items"))
    drawn = relabelled(units.select(unit, group).join(sets, unit, "left"), group, rounds, unit)
    sizes = drawn.groupBy("round").agg(F.count(F.when(F.col("drawn"), 1)).alias("n"), F.count(F.when(~F.col("drawn"), 1)).alias("m"))
    held = drawn.select("round", "drawn", F.explode("items").alias("item")).groupBy("round", "item").agg(F.count(F.when(F.col("drawn"), 1)).alias("a"), F.count(F.when(~F.col("drawn"), 1)).alias("b"))
    gaps = held.join(sizes, "round").withColumn("gap", F.abs(F.col("a") / F.col("n") - F.col("b") / F.col("m")))
    most = gaps.where("round > 0").groupBy("round").agg(F.max("gap").alias("most"))
    seen = gaps.where("round = 0").select("item", "gap")
    return seen.crossJoin(F.broadcast(most)).groupBy("item", "gap").agg(((F.count(F.when(F.col("most") >= F.col("gap") - 1e-9, 1)) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))  # a row a round


def bootstrap_mean(rows: DataFrame, value: str, cluster: str, rounds: int = 200, level: float = 0.95) -> DataFrame:
    """One row: clusters, mean, low, high: percentile interval of the mean when whole clusters are drawn again. Each round gives each
    cluster a Poisson(1) number of copies by its hash, so rounds are sums over clusters and nothing is ranked. With a key
    of its own for every row it is the plain bootstrap."""
    per = rows.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    u = draw(cluster, "round") / float(1 << 32)
    copies = sum((F.when(u >= p, 1).otherwise(0) for p in POISSON), F.lit(0))
    drawn = per.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("w", copies)
    means = drawn.groupBy("round").agg((F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("m"))
    ends = means.agg(F.percentile("m", (1 - level) / 2).alias("low"), F.percentile("m", (1 + level) / 2).alias("high"))
    return per.agg(F.count(F.lit(1)).alias("clusters"), (F.sum("s") / F.sum("n")).alias("mean")).crossJoin(ends)


def smoothed(points: DataFrame, x: str, y: str, near: int) -> DataFrame:
    """(x, y, fit): local straight lines with tricube weights over the ``near`` nearest points. ``points`` is a series (a row a
    period): each point meets all others."""
    a, b = points.select(F.col(x).cast("double").alias("x0"), F.col(y).alias("y0")), points.select(F.col(x).cast("double").alias("x1"), F.col(y).cast("double").alias("y1"))
    gap = F.abs(F.col("x1") - F.col("x0"))
    pairs = a.crossJoin(F.broadcast(b)).withColumn("gap", gap).withColumn("r", F.row_number().over(Window.partitionBy("x0").orderBy("gap", "x1"))).where(F.col("r") <= near)
    wide = F.max("gap").over(Window.partitionBy("x0")) * 1.000001
    u = F.col("gap") / F.col("wide")
    w = pairs.withColumn("wide", wide).withColumn("w", F.pow(1 - u * u * u, F.lit(3.0))).withColumn("dx", F.col("x1") - F.col("x0"))
    s = w.groupBy("x0", "y0").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("dx")).alias("sx"), F.sum(F.col("w") * F.col("dx") * F.col("dx")).alias("sxx"), F.sum(F.col("w") * F.col("y1")).alias("sy"), F.sum(F.col("w") * F.col("dx") * F.col("y1")).alias("sxy"))
    return s.select(F.col("x0").alias(x), F.col("y0").alias(y), ((F.col("sxx") * F.col("sy") - F.col("sx") * F.col("sxy")) / (F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"))).alias("fit"))


def average_precision(rows: DataFrame, by: str, order: list[Column], relevant: Column) -> DataFrame:
    """(by, n, relevant, average_precision) of each ranking."""
    w = Window.partitionBy(by).orderBy(*order)
    hit = F.when(relevant, 1).otherwise(0)
    ranked = rows.withColumn("_hit", hit).withColumn("_rank", F.row_number().over(w)).withColumn("_hits", F.sum("_hit").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("_hit").alias("relevant"), (F.sum(F.when(F.col("_hit") == 1, F.col("_hits") / F.col("_rank"))) / F.nullif(F.sum("_hit"), F.lit(0))).alias("average_precision"))


@F.pandas_udf(DoubleType())
def sign_test(more: pd.Series, less: pd.Series) -> pd.Series:
    """Two-sided binomial probability at one half of counts this uneven."""
    out = []
    for a, b in zip(more, less):
        n, low = a + b, np.arange(min(a, b) + 1, dtype=float)
        terms = _log_gamma(np.array([n + 1.0])) - _log_gamma(low + 1) - _log_gamma(n - low + 1) - n * np.log(2)
        out.append(min(1.0, float(2 * np.exp(terms).sum())))
    return pd.Series(out)
