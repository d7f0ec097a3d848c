"""Statistics as column expressions; tails of distributions as pandas UDFs over aggregated rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.records import kept

Z95 = 1.96


def num(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def wilson(k: Column | str, n: Column | str, z: float = Z95) -> tuple[Column, Column]:
    """Wilson interval of k of n; (0, 1) where n is 0."""
    k, n = num(k), num(n)
    p, zz = k / F.nullif(n, F.lit(0.0)), z * z
    middle, spread, scale = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)), 1 + zz / n
    low = F.when(n > 0, F.greatest(F.lit(0.0), (middle - spread) / scale)).otherwise(0.0)
    high = F.when(n > 0, F.least(F.lit(1.0), (middle + spread) / scale)).otherwise(1.0)
    return low, high


def odds_ratio(a: Column, b: Column, c: Column, d: Column, z: float = Z95) -> tuple[Column, Column, Column]:
    """Odds ratio of [[a, b], [c, d]] with its log interval; half is added to every cell when any is 0."""
    add = F.when((a == 0) | (b == 0) | (c == 0) | (d == 0), 0.5).otherwise(0.0)
    a, b, c, d = (num(x) + add for x in (a, b, c, d))
    ratio = a * d / (b * c)
    spread = z * F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return ratio, F.exp(F.ln(ratio) - spread), F.exp(F.ln(ratio) + spread)


def association(k: Column, a: Column, b: Column, n: Column) -> dict[str, Column]:
    """Confidence both ways, lift, PMI and NPMI of two items: k baskets with both, a and b with each, n in all."""
    k, a, b, n = num(k), num(a), num(b), num(n)
    lift = k * n / (a * b)
    pmi = F.log2(lift)
    return {"confidence_ab": k / a, "confidence_ba": k / b, "lift": lift, "pmi": pmi, "npmi": F.when(k == n, 1.0).otherwise(pmi / F.nullif(-F.log2(k / n), F.lit(0.0)))}


def entropy_term(share: Column) -> Column:
    """-p log2 p, 0 at 0; its sum is the entropy in bits."""
    return F.when(share > 0, -share * F.log2(share)).otherwise(0.0)


def jensen_shannon_term(p: Column, q: Column) -> Column:
    """One item's part of the Jensen-Shannon divergence in bits."""
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) / 2 + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0) / 2


def _running(counts: DataFrame, value: str, by: list[str], n: str, to: str, cuts: int = 200) -> DataFrame:
    """``to``: the sum of ``n`` over rows of the group with values up to this one. A group's values are cut into ranges
    at approximate percentiles, sums run inside a range, and ranges before are added, so that no task holds a
    whole group."""
    edges = counts.groupBy(*by).agg(F.percentile_approx(value, F.array(*[F.lit(i / cuts) for i in range(1, cuts)]), 2000).alias("_edges"))
    both = counts.join(edges, by) if by else counts.crossJoin(F.broadcast(edges))  # one row
    placed = both.withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*by, "_range").agg(F.sum(n).alias("_s")).withColumn("_ahead", F.coalesce(F.sum("_s").over(ahead), F.lit(0))).drop("_s")
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn(to, F.sum(n).over(inside)).join(sums, [*by, "_range"]).withColumn(to, F.col(to) + F.col("_ahead")).drop("_range", "_ahead")


def average_rank(df: DataFrame, value: str, to: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Ranks from 1 with ties averaged, of the rows with a value. Ranks are worked out on distinct values (their counts
    are summed range by range) and joined back."""
    by = by or []
    counts = kept(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")), "counts")
    ranks = _running(counts, value, by, "_n", to).withColumn(to, F.col(to) - (F.col("_n") - 1) / 2).drop("_n")
    return df.join(ranks, [*by, value])


def benjamini_hochberg(df: DataFrame, p: str, q: float = 0.05, to: str = "significant", by: list[str] | None = None) -> DataFrame:
    """Marks the rows that the step-up procedure keeps at rate ``q`` (within ``by``), from distinct p-values with their
    counts, range by range."""
    by = by or []
    df = kept(df, "tested")  # p-values are worked out once
    counts = kept(df.groupBy(*by, p).agg(F.count(F.lit(1)).alias("_n")), "counts")
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_m"))
    running = _running(counts, p, by, "_n", "_i")
    ranked = running.join(total, by) if by else running.crossJoin(total)  # one row
    limit = ranked.groupBy(*by).agg(F.max(F.when(F.col(p) <= q * F.col("_i") / F.col("_m"), F.col(p))).alias("_limit"))
    both = df.join(limit, by) if by else df.crossJoin(limit)  # one row
    return both.withColumn(to, F.coalesce(F.col(p) <= F.col("_limit"), F.lit(False))).drop("_limit")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):  # up to 8 or more, where the series is exact to machine precision
        low = y < 9
        shift[low] += np.log(y[low])
        y[low] += 1
    s = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + s - shift


def _log_table(a, b, c, d) -> np.ndarray:
    g = _log_gamma
    return g(a + b + 1) + g(c + d + 1) + g(a + c + 1) + g(b + d + 1) - g(a + 1) - g(b + 1) - g(c + 1) - g(d + 1) - g(a + b + c + d + 1)


@F.pandas_udf(DoubleType())
def fisher_greater(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """One-sided exact test of [[a, b], [c, d]]: probability of a table with as large a first cell or a larger one. Terms are added
    until they change the sum no more."""
    a, b, c, d = (x.to_numpy(float) for x in (a, b, c, d))
    term = np.exp(_log_table(a, b, c, d))
    total = term.copy()
    x, y, z, w = a.copy(), b.copy(), c.copy(), d.copy()
    live = np.minimum(y, z) > 0
    while live.any():
        term[live] *= y[live] * z[live] / ((x[live] + 1) * (w[live] + 1))
        x[live], y[live], z[live], w[live] = x[live] + 1, y[live] - 1, z[live] - 1, w[live] + 1
        total[live] += term[live]
        falls = y * z < (x + 1) * (w + 1)
        live &= (np.minimum(y, z) > 0) & ~(falls & (term < total * 1e-18))
    return pd.Series(np.minimum(1.0, total))


@F.pandas_udf(DoubleType())
def fisher_two_sided(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided exact test: all tables with these margins that are no likelier than the observed one. Beyond 40 standard
    deviations from the mean, and not near the observed table, tables add nothing that a double could tell."""
    out = []
    for p, q, r, s in zip(*(x.astype(float) for x in (a, b, c, d))):
        low, high, n = max(0.0, p - s), min(p + q, p + r), p + q + r + s
        mean = (p + q) * (p + r) / n if n else 0.0
        wide = 50 + 40 * math.sqrt(mean * (q + s) * (r + s) / (n * max(1.0, n - 1))) if n else 50.0
        near = [np.arange(max(low, math.floor(x - w)), min(high, math.ceil(x + w)) + 1) for x, w in ((mean, wide), (p, 200.0))]
        first = np.unique(np.concatenate(near))
        chance = np.exp(_log_table(first, p + q - first, p + r - first, s - p + first))
        seen = chance[np.searchsorted(first, p)]
        equal = 1 + max(1e-7, 1e-13 * n)  # as near as logarithms of factorials of n can tell
        out.append(min(1.0, float(chance[chance <= seen * equal].sum())))
    return pd.Series(out)


def _chi2_above(x: float, df: int) -> float:
    """The tail is a finite sum: Poisson terms for an even number of degrees, and for an odd one the normal tail and
    terms at half steps."""
    if x <= 0 or df <= 0:
        return 1.0
    y, odd = x / 2, df % 2
    steps = np.arange(df // 2) + odd / 2
    terms = np.exp(steps * math.log(y) - y - _log_gamma(steps + 1))
    return float(min(1.0, terms.sum() + (math.erfc(math.sqrt(y)) if odd else 0.0)))


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """Probability that chi-squared with a whole number ``df`` of degrees of freedom is above x."""
    return pd.Series([_chi2_above(float(v), int(d)) if v == v and d == d else None for v, d in zip(x.astype(float), df.astype(float))], dtype=float)


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """Probability that a standard normal is as far from 0."""
    return pd.Series([math.erfc(abs(v) / math.sqrt(2)) for v in z], dtype=float)


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Probability that Student's t with ``df`` degrees of freedom is as far from 0 (trapezoids on the density)."""
    out = []
    for v, n in zip(t, df):
        angle = np.linspace(0, np.arctan(abs(v) / np.sqrt(n)), 4001)
        scale = np.exp(_log_gamma(np.array([(n + 1) / 2]))[0] - _log_gamma(np.array([n / 2]))[0]) / np.sqrt(np.pi)
        out.append(float(min(1.0, max(0.0, 1 - 2 * scale * np.trapezoid(np.cos(angle) ** (n - 1), angle)))))
    return pd.Series(out)
