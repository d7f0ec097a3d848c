"""Description and comparison of tables: typing, numbers, categories, cross-tabs, groups, de-identification."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..sources.records import dealt, distinct, kept


def column_types(df: DataFrame, share: float = 0.9, few: int = 20) -> DataFrame:
    """(column, n, missing, distinct, type) of a table of strings: number or date where that share of values reads as
    one, category where there are few distinct short values, else text. One aggregation for all columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in df.columns]))
    v = F.trim("v")
    filled = F.col("v").isNotNull() & (v != "")
    number = v.rlike(r"^[+-]?[0-9][0-9,]*(\.[0-9]+)?%?$")
    date = v.rlike(r"^[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}([ T].*)?$")
    out = df.select(pairs.alias("p")).select("p.*").groupBy("column").agg(F.count(F.when(filled, 1)).alias("n"), F.count(F.when(~filled, 1)).alias("missing"), F.countDistinct(F.when(filled, v)).alias("distinct"), F.count(F.when(filled & number, 1)).alias("numbers"), F.count(F.when(filled & date, 1)).alias("dates"), F.max(F.length(v)).alias("longest"))
    kind = F.when((F.col("n") > 0) & (F.col("dates") >= share * F.col("n")), "date").when((F.col("n") > 0) & (F.col("numbers") >= share * F.col("n")), "number").when((F.col("distinct") <= few) & (F.col("longest") <= 30), "category").otherwise("text")
    return out.select("column", "n", "missing", "distinct", kind.alias("type"))


def describe_number(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, missing, mean, sd (n - 1), quartiles by linear interpolation, extremes and rows beyond Tukey's fences."""
    by = by or []
    summary = df.groupBy(*by).agg(F.count(value).alias("n"), F.count(F.when(F.col(value).isNull(), 1)).alias("missing"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("least"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max(value).alias("most"))
    summary = summary.select(*by, "n", "missing", "mean", "sd", "least", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "most")
    spread = F.col("q3") - F.col("q1")
    both = df.join(summary, by) if by else df.crossJoin(summary)  # one row
    beyond = both.where((F.col(value) < F.col("q1") - 1.5 * spread) | (F.col(value) > F.col("q3") + 1.5 * spread)).groupBy(*by).agg(F.count(F.lit(1)).alias("outliers"))
    joined = summary.join(beyond, by, "left") if by else summary.crossJoin(beyond)
    return joined.withColumn("outliers", F.coalesce("outliers", F.lit(0).cast("long")))


def nice_width(low: float, high: float, target: int = 10) -> float:
    """A bin width of 1, 2, 2.5, 5 or 10 times a power of ten that gives about ``target`` bins."""
    if high <= low:
        return 1.0
    raw = (high - low) / target
    power = 10.0 ** math.floor(math.log10(raw))
    return min((m * power for m in (1, 2, 2.5, 5, 10)), key=lambda w: (abs((high - low) / w - target), w))


def histogram(df: DataFrame, value: str, target: int = 10) -> DataFrame:
    """(bin_start, n) over bins of a nice width; the last one is closed. Two numbers come to the driver."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return df.groupBy(F.col(value).cast("double").alias("bin_start")).agg(F.count(F.lit(1)).alias("n")).where("false")
    width = nice_width(low, high, target)
    start = math.floor(low / width) * width
    last = max(0, math.ceil((high - start) / width) - 1)
    at = F.least(F.floor((F.col(value) - start) / width), F.lit(last))
    return df.where(F.col(value).isNotNull()).groupBy((F.lit(start) + at * width).alias("bin_start")).agg(F.count(F.lit(1)).alias("n"))


def frequencies(df: DataFrame, value: str, top: int) -> DataFrame:
    """(value, n, share of the non-missing), the ``top`` most frequent, ties by value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(counts.agg(F.sum("n").alias("_t"))).withColumn("share", F.col("n") / F.col("_t")).drop("_t").orderBy(F.desc("n"), "value").limit(top)


def crosstab(df: DataFrame, a: str, b: str, keep: int | None = None, other: str = "other") -> DataFrame:
    """(a, b, n); values of ``b`` beyond the ``keep`` most frequent become ``other``."""
    if keep is not None:
        common = frequencies(df, b, keep).select(F.col("value").alias("_v"))
        df = df.join(common, F.col(b) == F.col("_v"), "left").withColumn(b, F.when(F.col("_v").isNotNull(), F.col(b)).otherwise(other)).drop("_v")
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def chi2(table: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi2, df, cramer_v, least_expected, p of counts (a, b, n). Empty cells of the table count as 0."""
    rows, columns = table.groupBy(a).agg(F.sum("n").alias("r")), table.groupBy(b).agg(F.sum("n").alias("c"))
    total = table.agg(F.sum("n").alias("total"))
    cells = rows.crossJoin(columns).crossJoin(total).join(table, [a, b], "left")  # margins of a contingency table
    expected = F.col("r") * F.col("c") / F.col("total")
    seen = F.coalesce("n", F.lit(0))
    sums = cells.agg(F.sum((seen - expected) * (seen - expected) / expected).alias("chi2"), ((F.countDistinct(a) - 1) * (F.countDistinct(b) - 1)).alias("df"), F.least(F.countDistinct(a), F.countDistinct(b)).alias("side"), F.min(expected).alias("least_expected"), F.first("total").alias("total"))
    return sums.select("chi2", "df", F.sqrt(F.col("chi2") / (F.col("total") * F.greatest(F.col("side") - 1, F.lit(1)))).alias("cramer_v"), "least_expected", stats.chi2_tail("chi2", F.col("df").cast("double")).alias("p"))


def kruskal_wallis(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: h with ties corrected, groups, epsilon2, p."""
    ranked = stats.average_rank(df.where(F.col(value).isNotNull()), value)
    parts = ranked.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("r"))
    ties = ranked.groupBy(value).agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    sums = parts.agg(F.sum("n").alias("N"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.count(F.lit(1)).alias("groups")).crossJoin(ties)
    n = F.col("N").cast("double")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return sums.select(h.alias("h"), "groups", (h / (n - 1)).alias("epsilon2"), stats.chi2_tail(h, (F.col("groups") - 1).cast("double")).alias("p"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, rho, p (by t, from 4 rows on)."""
    both = stats.average_rank(stats.average_rank(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y), x, "rx"), y, "ry")
    out = both.agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("rho"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("rho") * F.col("rho"), F.lit(1e-300)))
    return out.select("n", "rho", F.when(F.col("n") >= 4, stats.t_two_sided(t, (F.col("n") - 2).cast("double"))).alias("p"))


def group_contrasts(units: DataFrame, group: str, min_units: int = 3, q: float = 0.05) -> DataFrame:
    """For every group and item of (unit, group, item): share inside and elsewhere, odds ratio, one-sided exact p, and the
    joint Benjamini-Hochberg mark. Items that are rarer inside than elsewhere have p = 1 and stay in the count. Repeated rows
    count once; they are put together by unit, once for all counts."""
    units = kept(distinct(units.select("unit", group, "item"), "unit"), "units")
    size = dealt(units.select("unit", group), units.count(), "unit").distinct().groupBy(group).agg(F.count(F.lit(1)).alias("g"))
    everyone = size.agg(F.sum("g").alias("N"))
    inside = units.groupBy(group, "item").agg(F.count("unit").alias("a")).where(F.col("a") >= min_units)
    overall = units.groupBy("item").agg(F.count(F.when(F.col("unit").isNotNull() & F.col(group).isNotNull(), 1)).alias("k"))
    rows = inside.join(size, group).join(overall, "item").crossJoin(everyone)
    a, b, c = F.col("a"), F.col("g") - F.col("a"), F.col("k") - F.col("a")
    d = F.col("N") - F.col("g") - c
    rows = rows.withColumns({"share": a / F.col("g"), "elsewhere": c / F.nullif(F.col("N") - F.col("g"), F.lit(0)), "odds_ratio": stats.odds_ratio(a, b, c, d)[0]})
    return stats.benjamini_hochberg(rows.withColumn("p", F.when(F.col("share") > F.col("elsewhere"), stats.fisher_greater(a, b, c, d)).otherwise(1.0)), "p", q)


def outcome_association(units: DataFrame, outcome: DataFrame, min_units: int = 3, q: float = 0.05) -> DataFrame:
    """For every item of (unit, item): its 2x2 table with ``outcome`` (unit, positive), odds ratio, the smaller one-sided p
    and the Benjamini-Hochberg mark on twice that. Items of too few or of all units are left out."""
    totals = outcome.agg(F.count(F.lit(1)).alias("units"), F.count(F.when(F.col("positive"), 1)).alias("positives"))
    items = units.select("unit", "item").distinct().join(outcome, "unit").groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("positive"), 1)).alias("a")).crossJoin(totals).where((F.col("n") >= min_units) & (F.col("n") < F.col("units")))
    a, b, c = F.col("a"), F.col("n") - F.col("a"), F.col("positives") - F.col("a")
    d = F.col("units") - F.col("n") - c
    rows = items.withColumns({"odds_ratio": stats.odds_ratio(a, b, c, d)[0], "p": F.least(stats.fisher_greater(a, b, c, d), stats.fisher_greater(b, a, d, c))})
    return stats.benjamini_hochberg(rows.withColumn("p2", F.least(F.lit(1.0), 2 * F.col("p"))), "p2", q)


#: Fixed patterns of identifiers, in the order in which they are masked.
MASKS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("id", r"\b[0-9]{17}[0-9Xx]\b|\b[0-9]{15,16}\b"),
    ("phone", r"\+?[0-9]{0,2} ?\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}\b"),
    ("address", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
)


def masked(df: DataFrame, text: str, to: str) -> DataFrame:
    """``df`` with ``to``, the text with identifiers replaced by [kind], and a column a kind (long), how many of it were. Each kind
    is looked for in what the kinds before it left, once."""
    out, now = df, text
    for i, (name, pattern) in enumerate(MASKS):
        after = to if i == len(MASKS) - 1 else f"_{to}{i}"
        out = out.withColumn(after, F.regexp_replace(now, pattern, f"[{name}]"))
        out = out.withColumn(name, F.regexp_count(now, F.lit(pattern)).cast("long"))
        now = after
    return out.drop(*[f"_{to}{i}" for i in range(len(MASKS) - 1)])


def pseudonyms(df: DataFrame, value: str, order: str, to: str, prefix: str = "P", width: int = 6) -> DataFrame:
    """Replaces each value by a number in order of first appearance. The window holds a row for each distinct value."""
    first = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("_o"))
    names = first.withColumn(to, F.concat(F.lit(prefix), F.lpad(F.row_number().over(Window.orderBy("_o", value)).cast("string"), width, "0"))).drop("_o")
    return df.join(names, value, "left")
