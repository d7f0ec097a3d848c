"""Pairs, rules, triples, families and neighbours of baskets (basket, item)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..sources.records import dealt, kept
from . import overlap

#: Sets of up to so many items are met by their parts; how many items a query may leave out at first (a row one more); and how
#: many products of a tile take as long as a row of a part.
PARTS, LEFT, PRODUCTS = 12, 1, 200


def total(baskets: DataFrame) -> DataFrame:
    """One row: n, the number of baskets."""
    return baskets.agg(F.countDistinct("basket").alias("n"))


def pair_counts(baskets: DataFrame) -> DataFrame:
    """(a, b, k): baskets with both items, a < b. ``baskets`` holds each (basket, item) once."""
    left, right = baskets.withColumnRenamed("item", "a"), baskets.withColumnRenamed("item", "b")
    return left.join(right, "basket").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))


def pair_table(baskets: DataFrame, min_support: int = 1) -> DataFrame:
    """(a, b, k, na, nb, n) and the measures of ``association`` with odds ratio and its interval."""
    single = baskets.groupBy("item").agg(F.count(F.lit(1)).alias("c"))
    pairs = pair_counts(baskets).where(F.col("k") >= min_support)
    pairs = pairs.join(single.select(F.col("item").alias("a"), F.col("c").alias("na")), "a").join(single.select(F.col("item").alias("b"), F.col("c").alias("nb")), "b").crossJoin(total(baskets))
    k, a, b, n = (F.col(x) for x in ("k", "na", "nb", "n"))
    ratio, low, high = stats.odds_ratio(k, a - k, b - k, n - a - b + k)
    return pairs.withColumns({**stats.association(k, a, b, n), "odds_ratio": ratio, "or_low": low, "or_high": high})


def with_tests(pairs: DataFrame, q: float = 0.05) -> DataFrame:
    """Adds the one-sided exact p and whether Benjamini-Hochberg keeps the pair."""
    k, a, b, n = (F.col(x) for x in ("k", "na", "nb", "n"))
    return stats.benjamini_hochberg(pairs.withColumn("p", stats.fisher_greater(k, a - k, b - k, n - a - b + k)), "p", q)


def rules(pairs: DataFrame, min_confidence: float) -> DataFrame:
    """Both directions of every pair that reach ``min_confidence``: (lhs, rhs, support, confidence, lift)."""
    both = F.explode(F.array(F.struct(F.col("a").alias("lhs"), F.col("b").alias("rhs"), F.col("confidence_ab").alias("confidence")), F.struct(F.col("b").alias("lhs"), F.col("a").alias("rhs"), F.col("confidence_ba").alias("confidence"))))
    return pairs.select(both.alias("r"), F.col("k").alias("support"), "lift").select("r.lhs", "r.rhs", "support", "r.confidence", "lift").where(F.col("confidence") >= min_confidence)


def association_rules(baskets: DataFrame, min_support: int, min_confidence: float, lhs: Column | None = None, rhs: Column | None = None) -> DataFrame:
    """Rules with one or two items on the left: (lhs, rhs, support, confidence, lift). ``lhs`` and ``rhs`` are
    conditions on ``item``; a right-hand item is never on the left."""
    sides = baskets if lhs is None else baskets.where(lhs)
    one = sides.select("basket", F.array("item").alias("left"))
    two = sides.select("basket", F.col("item").alias("x")).join(sides.select("basket", F.col("item").alias("y")), "basket").where("x < y").select("basket", F.array("x", "y").alias("left"))
    sets = one.union(two)
    right = baskets if rhs is None else baskets.where(rhs)
    n_left = sets.groupBy("left").agg(F.count(F.lit(1)).alias("sx")).where(F.col("sx") >= min_support)
    n_right = right.groupBy("item").agg(F.count(F.lit(1)).alias("sy"))
    both = sets.join(right, "basket").where(~F.array_contains("left", F.col("item"))).groupBy("left", "item").agg(F.count(F.lit(1)).alias("sxy")).where(F.col("sxy") >= min_support)
    out = both.join(n_left, "left").join(n_right, "item").crossJoin(total(baskets))
    confidence = F.col("sxy") / F.col("sx")
    return out.select(F.concat_ws("+", "left").alias("lhs"), F.col("item").alias("rhs"), F.col("sxy").alias("support"), confidence.alias("confidence"), (confidence / (F.col("sy") / F.col("n"))).alias("lift")).where(F.col("confidence") >= min_confidence)


def triples(baskets: DataFrame, target, min_support: int = 5) -> DataFrame:
    """(a, b, k): pairs in baskets that also hold ``target``."""
    held = baskets.where(F.col("item") == target).select("basket")
    rest = baskets.where(F.col("item") != target).join(held, "basket", "left_semi")
    return pair_counts(rest).where(F.col("k") >= min_support)


def family(baskets: DataFrame, core: list, min_share: float, max_extra: int) -> DataFrame:
    """(basket, held, missing, extra): baskets with at least ``min_share`` of ``core`` and at most ``max_extra`` items besides."""
    inside = F.col("item").isin(core)
    counted = baskets.groupBy("basket").agg(F.count(F.when(inside, 1)).alias("held"), F.count(F.when(~inside, 1)).alias("extra"))
    return counted.where((F.col("held") >= min_share * len(core)) & (F.col("extra") <= max_extra)).withColumn("missing", F.lit(len(core)) - F.col("held"))


def parts_made(sets: DataFrame, left: int) -> int:
    """How many rows ``parts`` makes."""
    sizes = sets.groupBy(F.size("items").alias("c")).count().collect()
    return sum(n * sum(math.comb(c, k) for k in range(min(left, c - 1) + 1)) for c, n in sizes)


def parts(sets: DataFrame, key: str, left: int, rows: int) -> DataFrame:
    """A row for each non-empty part of ``items`` (array of distinct strings) that leaves out at most ``left`` of them: _h and part, hash
    and items of the part as one string, and _n, their number. Dealt by the part, ``rows`` being those of the larger side."""
    names = F.transform("items", lambda x: F.concat(F.length(x), F.lit(":"), x))  # lengths keep ["a", "b"] and ["ab"] apart
    masks = F.filter(F.sequence(F.lit(1), F.expr("shiftleft(1, size(items)) - 1")), lambda m: F.bit_count(m) >= F.size("items") - left)
    each = dealt(sets, rows, key).withColumn("_names", names).withColumn("_m", F.explode(masks))
    each = each.withColumn("part", F.array_join(F.filter("_names", lambda x, i: F.getbit("_m", i) == 1), ""))
    return dealt(each.select(key, "size", F.xxhash64("part").alias("_h"), "part", F.bit_count("_m").alias("_n")), rows, "_h", "part")


def best_by_parts(asked: DataFrame, held: DataFrame, left: int) -> DataFrame:
    """(query, case, shared, score): for each query (query, items, size) rows of ``held`` (case, items, size) that have a part in common with it, of
    which the query leaves out at most ``left`` items and the row one more; among them the best one of all such, ties to the smallest.

    Of the rows that hold a part the smallest is the most similar, so two rows a part are enough (one may be the query's own)."""
    rows = max(parts_made(asked, left), parts_made(held, left + 1))
    rank = F.row_number().over(Window.partitionBy("_h", "part").orderBy("size", "case"))
    least = parts(held, "case", left + 1, rows).withColumn("_r", rank).where("_r <= 2").select("_h", "part", "case", F.col("size").alias("_size"))
    near = parts(asked, "query", left, rows).join(least, ["_h", "part"]).where("query != case")
    return near.select("query", "case", F.col("_n").cast("double").alias("shared"), (F.col("_n") / (F.col("size") + F.col("_size") - F.col("_n"))).alias("score"))


def nearest(baskets: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(query, basket, shared, jaccard): for each basket of ``queries`` (of all, if none are given) the most similar other basket, ties to
    the smallest. ``queries``: rows of ``baskets``, of which the basket is taken.

    Baskets of the same items are one set with its two smallest baskets. A query whose set has another basket is done with that.
    The others are held against sets by the parts that leave out few items: a query that has found better than what the rest
    could be to it is done. Those left are held against all sets, by tiles if they are few, else by all parts (sets of more
    than ``PARTS`` items in tiles). Null items make a basket larger and are in common with none."""
    held = baskets.groupBy("basket").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"), F.count(F.lit(1)).alias("size"))
    held = kept(held.where("basket is not null and size(items) > 0"), "baskets")
    order = Window.partitionBy("items", "size").orderBy("basket")
    two = held.withColumn("_r", F.row_number().over(order)).where("_r <= 2")
    sets = kept(two.groupBy("items", "size").agg(F.min("basket").alias("case"), F.nullif(F.max("basket"), F.min("basket")).alias("second")), "sets")
    asked = held if queries is None else held.join(queries.select("basket").distinct(), "basket", "left_semi")
    met = kept(asked.withColumnRenamed("basket", "query").join(sets, ["items", "size"]), "met")
    other = F.when(F.col("query") != F.col("case"), F.col("case")).otherwise(F.col("second"))
    n, size = F.size("items"), F.col("size")
    done = F.col("second").isNotNull() & (size == n)
    same = met.where(done).select("query", other.alias("basket"), size.alias("shared"), F.lit(1.0).alias("jaccard"))
    lone = met.where(~done).select("query", "items", "size")
    some = sets.withColumn("case", F.explode(F.when(size == n, F.array("case")).otherwise(F.array("case", "second")))).where("case is not null").select("case", "items", "size")

    def chosen(found: DataFrame) -> DataFrame:
        return found.groupBy("query").agg(F.max(F.struct("score", -F.col("case"), "shared")).alias("m"))

    def tiles(asked: DataFrame, held: DataFrame) -> DataFrame:
        return overlap.best(asked, held.withColumn("weights", F.array_repeat(F.lit(1.0), n)), 1, True)

    few = n <= PARTS
    first = chosen(best_by_parts(lone.where(few), some.where(n <= PARTS + LEFT + 1), LEFT))
    first = kept(lone.join(first, "query", "left"), "first")
    beyond = F.greatest((n - LEFT - 1) / size, n / (size + LEFT + 2))  # no pair that the parts left out is more similar
    sure = F.coalesce(F.col("m.score") > beyond, F.lit(False))
    best = first.where(sure).select("query", "m")
    rest = first.where(~sure).select("query", "items", "size")
    asking = rest.count()
    if asking:
        large = some.where(~few)
        if asking * some.count() <= PRODUCTS * (parts_made(rest.where(few), PARTS) + parts_made(some.where(few), PARTS)):
            found = tiles(rest, some)
        else:
            found = best_by_parts(rest.where(few), some.where(few), PARTS)
            if not large.isEmpty():
                found = found.unionByName(tiles(rest.where(few), large)).unionByName(tiles(rest.where(~few), some))
        best = best.unionByName(chosen(found))
    return same.unionByName(best.select("query", (-F.col("m.col2")).alias("basket"), F.col("m.shared").cast("long").alias("shared"), F.col("m.score").alias("jaccard")))


def partners(pairs: DataFrame, item, top: int) -> DataFrame:
    """The ``top`` items most often with ``item``: (partner, k, lift)."""
    other = F.when(F.col("a") == item, F.col("b")).otherwise(F.col("a"))
    return pairs.where((F.col("a") == item) | (F.col("b") == item)).select(other.alias("partner"), "k", "lift").orderBy(F.desc("k"), "partner").limit(top)


def forbidden_pairs(baskets: DataFrame, rules: DataFrame) -> DataFrame:
    """(a, b, k): how many baskets hold both items of each rule (a, b)."""
    left = rules.join(baskets.select("basket", F.col("item").alias("a")), "a")
    return left.join(baskets.select("basket", F.col("item").alias("b")), ["basket", "b"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))


def share_by_period(rows: DataFrame, period: str, hit: Column) -> DataFrame:
    """(period, n, k, share, low, high) with Wilson intervals."""
    counts = rows.groupBy(period).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(hit, 1)).alias("k"))
    low, high = stats.wilson("k", "n")
    return counts.select(period, "n", "k", (F.col("k") / F.col("n")).alias("share"), low.alias("low"), high.alias("high"))


def trend(shares: DataFrame, order: str) -> DataFrame:
    """One row: Cochran-Armitage z of (n, k) over groups scored 0, 1, ... by ``order``."""
    scored = shares.withColumn("s", F.row_number().over(Window.orderBy(order)) - 1)
    sums = scored.agg(F.sum("n").alias("N"), F.sum("k").alias("K"), F.sum(F.col("s") * F.col("n")).alias("ns"), F.sum(F.col("s") * F.col("s") * F.col("n")).alias("nss"), F.sum(F.col("s") * F.col("k")).alias("ks"), F.count(F.lit(1)).alias("groups"))
    p = F.col("K") / F.col("N")
    spread = p * (1 - p) * (F.col("nss") - F.col("ns") * F.col("ns") / F.col("N"))
    return sums.select("groups", "N", "K", F.when((F.col("groups") >= 3) & (spread > 0), (F.col("ks") - p * F.col("ns")) / F.sqrt(spread)).alias("z"))
