"""Series over periods: drift, change points, switches of preferred names, lost associations, carried values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..sources.records import distinct, kept


def zero_filled(counts: DataFrame, periods: DataFrame, keys: DataFrame) -> DataFrame:
    """Counts (period, key, n) with 0 for absent pairs; both dimensions are small tables."""
    return periods.crossJoin(keys).join(counts, [*periods.columns, *keys.columns], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def adjacent_divergence(counts: DataFrame, period: str, item: str) -> DataFrame:
    """(previous, period, jsd): Jensen-Shannon divergence of each present period with the one before it."""
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(period)))
    order = counts.select(period).distinct().withColumn("previous", F.lag(period).over(Window.orderBy(period))).where("previous is not null")
    here = order.join(shares, period).select(period, "previous", item, F.col("share").alias("p"), F.lit(0.0).alias("q"))
    there = order.join(shares.select(F.col(period).alias("previous"), item, "share"), "previous").select(period, "previous", item, F.lit(0.0).alias("p"), F.col("share").alias("q"))
    both = here.unionByName(there).groupBy("previous", period, item).agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    return both.groupBy("previous", period).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum(stats.jensen_shannon_term(F.col("p"), F.col("q"))))).alias("jsd"))


def entropy(counts: DataFrame, by: str) -> DataFrame:
    """(by, entropy) in bits of counts (by, ..., n)."""
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(by))).groupBy(by).agg(F.sum(stats.entropy_term(F.col("p"))).alias("entropy"))


def change_point(counts: DataFrame, at: str, label: str, min_side: int) -> DataFrame:
    """One row: split (the midpoint of the neighbouring times) and score, where n1 n2 / n times the divergence of labels
    before and after is largest. ``counts`` (at, label, n): splits fall between distinct times only."""
    totals = counts.groupBy(label).agg(F.sum("n").alias("all"))
    times = counts.select(at).distinct()
    grid = times.crossJoin(totals).join(counts, [at, label], "left")  # distinct times x labels
    upto = Window.partitionBy(label).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    cells = grid.withColumn("x", F.sum(F.coalesce("n", F.lit(0))).over(upto)).withColumn("y", F.col("all") - F.col("x"))
    sides = cells.withColumns({"n1": F.sum("x").over(Window.partitionBy(at)), "n2": F.sum("y").over(Window.partitionBy(at))}).where((F.col("n1") >= min_side) & (F.col("n2") >= min_side))
    score = F.first("n1") * F.first("n2") / (F.first("n1") + F.first("n2")) * F.sum(stats.jensen_shannon_term(F.col("x") / F.col("n1"), F.col("y") / F.col("n2")))
    after = times.withColumn("following", F.lead(at).over(Window.orderBy(at)))
    best = sides.groupBy(at).agg(score.alias("score")).join(after, at).withColumn("split", (F.col(at) + F.col("following")) / 2)
    return best.orderBy(F.desc(F.round("score", 9)), at).limit(1).select("split", "score")


def preferred_names(uses: DataFrame, period: str, name: str, unit: str) -> DataFrame:
    """(period, preferred, share, switched): the name that most distinct units use in each period (ties: the last in
    alphabetical order), one-period blips smoothed, and whether the preference switched and holds. Repeated uses are put
    together by unit before they are counted."""
    counts = kept(distinct(uses.select(period, name, unit), unit).groupBy(period, name).agg(F.count(unit).alias("n")), "counts")
    total = counts.groupBy(period).agg(F.sum("n").alias("t"))
    best = counts.groupBy(period).agg(F.max(F.struct("n", name)).alias("m")).join(total, period).select(period, F.col(f"m.{name}").alias("raw"), (F.col("m.n") / F.col("t")).alias("share"))
    w = Window.orderBy(period)  # a row a period
    before, after = F.lag("raw").over(w), F.lead("raw").over(w)
    smooth = best.withColumn("preferred", F.when((before == after) & (before != F.col("raw")), before).otherwise(F.col("raw")))
    last, following = F.lag("preferred").over(w), F.lead("preferred").over(w)
    return smooth.withColumn("switched", (last != F.col("preferred")) & (following.isNull() | (following == F.col("preferred")))).select(period, "preferred", "share", F.coalesce("switched", F.lit(False)).alias("switched"))


def lost_associations(units: DataFrame, year: str, left: str, right: str, cluster: str, pivot, min_support: int = 1) -> DataFrame:
    """(left, right, support, score): pairs seen before ``pivot`` only, though both ends appear after it. Support counts
    distinct clusters; score = s / (s + 1) * min(1, (later left + later right) / 6)."""
    early, late = units.where(F.col(year) < pivot), units.where(F.col(year) >= pivot)
    pairs = early.groupBy(left, right).agg(F.countDistinct(cluster).alias("support")).where(F.col("support") >= min_support)
    gone = pairs.join(late.select(left, right).distinct(), [left, right], "left_anti")
    ends = gone.join(late.groupBy(left).agg(F.count(F.lit(1)).alias("later_left")), left).join(late.groupBy(right).agg(F.count(F.lit(1)).alias("later_right")), right)
    return ends.withColumn("score", F.col("support") / (F.col("support") + 1) * F.least(F.lit(1.0), (F.col("later_left") + F.col("later_right")) / 6))


def carry_forward(df: DataFrame, by: str, order: list[str], value: Column, to: str) -> DataFrame:
    """The last non-null ``value`` of the rows before."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(to, F.last(value, ignorenulls=True).over(w))


def runs(df: DataFrame, by: str, order: list[str], label: str) -> DataFrame:
    """(by, run, label, n, start, end): stretches of equal labels (gaps and islands)."""
    w = Window.partitionBy(by).orderBy(*order)
    new = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)), 0).otherwise(1)
    marked = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(by, "run", label).agg(F.count(F.lit(1)).alias("n"), F.min(order[0]).alias("start"), F.max(order[0]).alias("end"))


def top_overlap(counts: DataFrame, period: str, item: str, k: int) -> DataFrame:
    """(period, jaccard): overlap of each period's ``k`` most frequent items with the period before."""
    top = counts.withColumn("_r", F.row_number().over(Window.partitionBy(period).orderBy(F.desc("n"), item))).where(F.col("_r") <= k)
    lists = top.groupBy(period).agg(F.collect_list(item).alias("items"))  # k items
    both = lists.withColumn("before", F.lag("items").over(Window.orderBy(period))).where("before is not null")
    return both.select(period, (F.size(F.array_intersect("items", "before")) / F.size(F.array_union("items", "before"))).alias("jaccard"))


def style_distance(counts: DataFrame, unit: str, feature: str, top: int) -> DataFrame:
    """(a, b, delta): mean absolute difference of z-scores of the rates of the ``top`` features (Burrows' Delta)."""
    total = counts.groupBy(unit).agg(F.sum("n").alias("t"))
    chosen = counts.groupBy(feature).agg(F.sum("n").alias("_c")).orderBy(F.desc("_c"), feature).limit(top).select(feature)
    units = counts.select(unit).distinct()
    grid = units.crossJoin(chosen).join(counts, [unit, feature], "left").join(total, unit)  # units x top features
    rates = grid.withColumn("rate", 1000 * F.coalesce("n", F.lit(0)) / F.col("t"))
    spread = rates.groupBy(feature).agg(F.avg("rate").alias("m"), F.stddev_samp("rate").alias("s")).where("s > 0")
    z = rates.join(spread, feature).select(unit, feature, ((F.col("rate") - F.col("m")) / F.col("s")).alias("z"))
    return z.select(F.col(unit).alias("a"), feature, F.col("z").alias("za")).join(z.select(F.col(unit).alias("b"), feature, F.col("z").alias("zb")), feature).where("a < b").groupBy("a", "b").agg(F.avg(F.abs(F.col("za") - F.col("zb"))).alias("delta"))
