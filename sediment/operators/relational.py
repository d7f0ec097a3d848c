"""Views, splits, samples, lookups and top-k as plans over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scope(df: DataFrame, group: str | None = None, excluded: list | None = None, year: str | None = None, after: float | None = None, before: float | None = None) -> DataFrame:
    """The rows a reader may see: not of ``excluded`` groups, and after <= year < before. A predicate that reaches the scan."""
    keep = F.lit(True)
    if excluded is not None and group is not None:
        keep &= ~F.col(group).isin(excluded) if excluded else F.lit(True)
    if after is not None:
        keep &= F.col(year) >= after
    if before is not None:
        keep &= F.col(year) < before
    return df.where(keep)


def predicate(isin: dict[str, list] | None = None, year: str | None = None, after: float | None = None, before: float | None = None) -> Column:
    """A conjunction; an empty list lets nothing through."""
    out = F.lit(True)
    for name, values in (isin or {}).items():
        out &= F.col(name).isin(values) if values else F.lit(False)
    if after is not None:
        out &= F.col(year) >= after
    if before is not None:
        out &= F.col(year) < before
    return out


def time_split(df: DataFrame, start: str, end: str, cutoff) -> tuple[DataFrame, DataFrame]:
    """(wholly before, wholly from the cutoff on); rows that straddle it are in neither."""
    return df.where(F.col(end) < cutoff), df.where(F.col(start) >= cutoff)


def interval_order(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """before, after or undetermined (they overlap)."""
    return F.when(a_end < b_start, "before").when(b_end < a_start, "after").otherwise("undetermined")


def period(value: Column, edges: list[tuple[str, float, float]], edge: str = "none") -> Column:
    """The id of the half-open period that holds ``value``. ``edge``: none (outside is null), clamp_low (what lies before
    the first belongs to it) or clamp_both (and what lies after the last to the last)."""
    out = None
    for name, low, high in edges:
        hit = (value >= low) & (value < high)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    if edge in ("clamp_low", "clamp_both"):
        out = out.when(value < edges[0][1], edges[0][0])
    if edge == "clamp_both":
        out = out.when(value >= edges[-1][2], edges[-1][0])
    return out


def lookup(df: DataFrame, ids: DataFrame, key: str, position: str) -> DataFrame:
    """Rows for ``ids`` (key, position), to be read in the order asked for; ids that are absent give no row."""
    return ids.join(df, key).orderBy(position)


def neighbours(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Adds previous and next ``value`` within the group."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumns({"previous": F.lag(value).over(w), "next": F.lead(value).over(w)})


def following(df: DataFrame, group: str, order: str, value: str, n: int) -> DataFrame:
    """Adds the next ``n`` values as a list."""
    return df.withColumn("following", F.collect_list(value).over(Window.partitionBy(group).orderBy(order).rowsBetween(1, n)))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def keep_first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, by, order, 1).drop("rank")


def round_robin(df: DataFrame, kind: str, order: list[Column], k: int) -> DataFrame:
    """The best of each kind, then the second of each, ... up to ``k`` rows."""
    turn = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    return df.withColumn("turn", turn).orderBy("turn", kind).limit(k)


def even_sample(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """At most ``k`` rows of each group, evenly spaced, the first and the last among them."""
    w = Window.partitionBy(*by)
    at = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    slot = F.floor((F.col("_i") * (k - 1) + F.col("_n") - 2) / F.greatest(F.col("_n") - 1, F.lit(1)))
    earlier = F.floor(((F.col("_i") - 1) * (k - 1) + F.col("_n") - 2) / F.greatest(F.col("_n") - 1, F.lit(1)))
    return at.where((F.col("_n") <= k) | (F.col("_i") == 0) | (slot > earlier)).drop("_i", "_n")


def strided_sample(df: DataFrame, by: list[str], order: list[str], step: int) -> DataFrame:
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where((F.col("_i") - 1) % step == 0).drop("_i")


def stratified_frame(df: DataFrame, stratum: str, order: list[Column], total: int, floor: int) -> DataFrame:
    """The ``total`` best rows, and at least ``floor`` of every stratum where it has them."""
    best = df.orderBy(*order).limit(total)
    return best.unionByName(top_k(df, [stratum], order, floor).drop("rank")).distinct()


def hold_out(units: DataFrame, by: str, unit: str, fraction: float, seed: str) -> DataFrame:
    """Adds ``held``: in each group a fraction of units by seeded hash, at least one, and never the only one."""
    w = Window.partitionBy(by)
    n = F.count(F.lit(1)).over(w)
    place = F.row_number().over(w.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(unit).cast("string")), 256)))
    return units.withColumns({"_n": n, "_p": place}).withColumn("held", (F.col("_n") > 1) & (F.col("_p") <= F.greatest(F.lit(1), F.least(F.round(F.col("_n") * fraction), F.col("_n") - 1)))).drop("_n", "_p")


def within_budget(df: DataFrame, order: list[Column], size: str, cap: int) -> DataFrame:
    """Whole units in order as long as their sum stays in the budget. For tables of units, not of rows: one window."""
    return df.withColumn("running", F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("running") <= cap)


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def leaks(result: DataFrame, withheld: DataFrame, key: str) -> DataFrame:
    """Rows of a result that name withheld ids; there must be none."""
    return result.join(withheld.select(key).distinct(), key, "left_semi")


def facets(df: DataFrame, columns: list[str], unit: str) -> DataFrame:
    """(facet, value, n): distinct units for each value of each column, in one pass of grouping sets."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(F.col(unit), pairs.alias("f")).groupBy("f.facet", "f.value").agg(F.countDistinct(unit).alias("n"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).withColumn("only_in", F.lit("a")).unionByName(b.subtract(a).withColumn("only_in", F.lit("b")))


def signature(df: DataFrame, by: str, text: str) -> DataFrame:
    """(by, n, chars, digest): a fingerprint of each group that doesn't depend on the order of its rows."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text)).alias("chars"), F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")).alias("digest"))


def changed(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """Groups to work on again: (by, change) with added, removed or changed."""
    a, b = old.select(F.col(by), F.struct("n", "chars", "digest").alias("x")), new.select(F.col(by), F.struct("n", "chars", "digest").alias("y"))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "changed")
    return a.join(b, by, "full").select(by, change.alias("change")).where("change is not null")
