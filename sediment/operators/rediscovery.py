"""Do rankings of a past find what came later: links held back at cutoffs, rankers, precision, and what beats chance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.records import kept
from .graphs import link_prediction
from .resampling import sign_test

RANKERS = ("common", "adamic_adar", "allocation", "popularity", "chance")


def rediscovery(links: DataFrame, cutoffs: list, k: int = 10) -> DataFrame:
    """(cutoff, ranker, candidates, truths, hits, precision): for every cutoff, the links first seen before it make a graph, its
    unlinked pairs with a neighbour in common are candidates, and ``hits`` counts those of a ranker's ``k`` best that are first
    seen from the cutoff on. ``links``: a, b, at (either way round, repeats allowed; nulls and loops say nothing).

    Rankers: neighbours in common, their Adamic-Adar and resource-allocation weights, the product of the degrees, and a
    hash of the pair, which is chance. Equal scores go by a, then b. ``truths`` are candidates that came true. Nothing
    from after a cutoff is looked at for its ranking. A graph is written once a cutoff; ranking is a top-k a ranker."""
    first = links.where("a <> b and at is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "at")
    first = kept(first.groupBy("a", "b").agg(F.min("at").alias("at")), "links")
    out = None
    for cutoff in cutoffs:
        past = first.where(F.col("at") < F.lit(cutoff)).select("a", "b")
        degree = past.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("d"))
        x, y = (degree.select(F.col("n").alias(c), F.col("d").alias(f"d{c}")) for c in "ab")
        scored = link_prediction(past).join(x, "a").join(y, "b")
        true = first.where(F.col("at") >= F.lit(cutoff)).select("a", "b", F.lit(1).alias("true"))
        scored = scored.join(true, ["a", "b"], "left").select("a", "b", "common", *(F.round(c, 9).alias(c) for c in ("adamic_adar", "allocation")), (F.col("da") * F.col("db")).alias("popularity"), F.conv(F.substring(F.md5(F.concat_ws("-", "a", "b")), 1, 8), 16, 10).cast("long").alias("chance"), F.coalesce("true", F.lit(0)).alias("true"))
        scored = kept(scored, "scored")
        sizes = scored.agg(F.count(F.lit(1)).alias("candidates"), F.coalesce(F.sum("true"), F.lit(0)).alias("truths"))
        for ranker in RANKERS:
            best = scored.orderBy(F.desc(ranker), "a", "b").limit(k).agg(F.coalesce(F.sum("true"), F.lit(0)).alias("hits"), F.count(F.lit(1)).alias("n"))
            row = best.crossJoin(sizes).select(F.lit(str(cutoff)).alias("cutoff"), F.lit(ranker).alias("ranker"), "candidates", "truths", "hits", (F.col("hits") / F.nullif("n", F.lit(0))).alias("precision"))  # one row
            out = row if out is None else out.unionByName(row)
    return out


def ranker_summary(results: DataFrame) -> DataFrame:
    """(ranker, cutoffs, mean_precision, better, worse, p): of ``rediscovery``'s rows: the mean over cutoffs with candidates, at how many
    a ranker does better and worse than chance, and the two-sided sign test of that."""
    rows = kept(results.where("precision is not null"), "results")
    chance = rows.where("ranker = 'chance'").select("cutoff", F.col("precision").alias("base"))
    both = rows.join(chance, "cutoff")
    sums = both.groupBy("ranker").agg(F.count(F.lit(1)).alias("cutoffs"), F.avg("precision").alias("mean_precision"), F.count(F.when(F.col("precision") > F.col("base"), 1)).alias("better"), F.count(F.when(F.col("precision") < F.col("base"), 1)).alias("worse"))
    return sums.withColumn("p", sign_test(F.col("better"), F.col("worse")))
