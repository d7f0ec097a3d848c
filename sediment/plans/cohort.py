"""Cohort specifications compiled to plans: population, exposure, washout, follow-up, risk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats


@dataclass(frozen=True)
class Cohort:
    """Kinds of events: who enters (first ``index`` event), who is exposed (first ``exposure`` at or after it), what is counted
    (``outcome`` within ``follow_up`` days from the start), and how long before the start it must not have occurred."""

    index: str
    exposure: str
    outcome: str
    washout: int
    follow_up: int


def compiled(events: DataFrame, spec: Cohort) -> DataFrame:
    """(person, arm, t0, events): one row a person that the washout lets in. Exposed persons start at their exposure, others at
    their index event."""
    rows = events.select("person", "kind", "day")
    population = rows.where(F.col("kind") == spec.index).groupBy("person").agg(F.min("day").alias("i"))
    exposed = rows.where(F.col("kind") == spec.exposure).join(population, "person").where("day >= i").groupBy("person").agg(F.min("day").alias("x"))
    arms = population.join(exposed, "person", "left").select("person", F.when(F.col("x").isNotNull(), "exposed").otherwise("unexposed").alias("arm"), F.coalesce("x", "i").alias("t0"))
    outcomes = rows.where(F.col("kind") == spec.outcome).select("person", "day")
    prior = arms.join(outcomes, "person").where((F.col("day") < F.col("t0")) & (F.datediff("t0", "day") <= spec.washout)).select("person").distinct()
    later = arms.join(outcomes, "person").where((F.col("day") >= F.col("t0")) & (F.datediff("day", "t0") <= spec.follow_up)).groupBy("person").agg(F.count(F.lit(1)).alias("n"))
    return arms.join(prior, "person", "left_anti").join(later, "person", "left").select("person", "arm", "t0", F.coalesce("n", F.lit(0).cast("long")).alias("events"))


def risk(cohort: DataFrame) -> DataFrame:
    """(arm, persons, cases, risk, low, high) with Wilson intervals."""
    counts = cohort.groupBy("arm").agg(F.count(F.lit(1)).alias("persons"), F.count(F.when(F.col("events") > 0, 1)).alias("cases"))
    low, high = stats.wilson("cases", "persons")
    return counts.select("arm", "persons", "cases", (F.col("cases") / F.col("persons")).alias("risk"), low.alias("low"), high.alias("high"))


def risk_ratio(risks: DataFrame) -> DataFrame:
    """One row: ratio, low, high by the log method."""
    one = risks.agg(*[F.max(F.when(F.col("arm") == a, F.col(c))).alias(f"{c}_{a[0]}") for a in ("exposed", "unexposed") for c in ("persons", "cases")])
    a, n, b, m = (F.col(x) for x in ("cases_e", "persons_e", "cases_u", "persons_u"))
    ratio = (a / n) / F.nullif(b / m, F.lit(0.0))
    spread = stats.Z95 * F.sqrt(1 / F.nullif(a, F.lit(0)) - 1 / n + 1 / F.nullif(b, F.lit(0)) - 1 / m)
    return one.select(ratio.alias("ratio"), F.exp(F.ln(ratio) - spread).alias("low"), F.exp(F.ln(ratio) + spread).alias("high"))
