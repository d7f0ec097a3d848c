"""Statements, cases and profiles: what texts claim, which records meet stated facets, which profiles fit what was seen."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.records import dealt, distinct, kept

#: Joints of a stated relation between two words, and the words before it that deny it.
JOINTS, DENIALS = ("of", "in", "for", "from", "with"), ("not", "no", "nor", "was")


def statements(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, subject, relation, object, denied): word, joint, word, as often as the lower-cased text says so; leftmost, not
    overlapping. A denial stands right before the subject. Null texts say nothing."""
    pattern = rf"((?:(?:{'|'.join(DENIALS)}) )?[a-z]+ (?:{'|'.join(JOINTS)}) [a-z]+)"
    said = docs.select(key, F.explode(F.regexp_extract_all(T.lower(F.col(text)), F.lit(pattern), F.lit(1))).alias("said"))
    parts = F.split("said", " ")
    n = F.size(parts)
    return said.select(key, F.get(parts, n - 3).alias("subject"), F.get(parts, n - 2).alias("relation"), F.get(parts, n - 1).alias("object"), (n == 4).alias("denied"))


def stated(claims: DataFrame, relations: list[str] | None = None, all_of: list[str] | None = None, any_of: list[str] | None = None, after: int | None = None, before: int | None = None) -> DataFrame:
    """Claims (relation, terms, year) that meet every condition given: one of the relations, all and any of the terms,
    ``after`` <= year < ``before``. None leaves a condition out; an empty list of relations or of ``any_of`` meets nothing."""
    keep = F.lit(True)
    if relations is not None:
        keep &= F.col("relation").isin(relations) if relations else F.lit(False)
    for term in all_of or []:
        keep &= F.array_contains("terms", term)
    if any_of is not None:
        keep &= F.arrays_overlap("terms", F.array(*[F.lit(t) for t in any_of])) if any_of else F.lit(False)
    if after is not None:
        keep &= F.col("year") >= after
    if before is not None:
        keep &= F.col("year") < before
    return claims.where(keep)


def with_facets(cases: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """Cases that meet all facets, with ``why``: facet to the value that met it. A facet is a column, null where not met."""
    why = F.create_map(*[x for name, value in facets.items() for x in (F.lit(name), value.cast("string"))])
    met = F.lit(True)
    for value in facets.values():
        met &= value.isNotNull()
    return cases.where(met).withColumn("why", why)


def nested_rows(cases: DataFrame, key: str) -> DataFrame:
    """(key, visit, item) of cases with ``visits``: array of arrays of items. Cases without visits and visits without items
    keep a row with nulls."""
    visits = cases.select(key, F.posexplode_outer("visits").alias("visit", "items"))
    return visits.select(key, "visit", F.explode_outer("items").alias("item"))


def changes(visits: DataFrame, case: str, order: list[str]) -> DataFrame:
    """Visits (case, items) with what each adds to and takes from the visit before (nulls at the first)."""
    before = F.lag("items").over(Window.partitionBy(case).orderBy(*order))
    return visits.withColumn("before", before).withColumn("added", F.array_except("items", "before")).withColumn("removed", F.array_except("before", "items"))


def cross_links(left: DataFrame, right: DataFrame, unit: str, least: int) -> DataFrame:
    """(a, b, k, na, nb, n, lift, npmi): items of the left that meet items of the right in ``least`` units or more. Both are
    (unit, item); repeated rows count once; counts are summed before they are shuffled."""
    left, right = left.select(unit, F.col("item").alias("a")).distinct(), right.select(unit, F.col("item").alias("b")).distinct()
    n = left.select(unit).union(right.select(unit)).agg(F.countDistinct(unit).alias("n"))
    na, nb = left.groupBy("a").agg(F.count(F.lit(1)).alias("na")), right.groupBy("b").agg(F.count(F.lit(1)).alias("nb"))
    k = left.join(right, unit).groupBy("a", "b").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least)
    lift = F.col("k") * F.col("n") / (F.col("na") * F.col("nb"))
    out = k.join(na, "a").join(nb, "b").crossJoin(n).withColumn("lift", lift)
    return out.withColumn("npmi", F.when(F.col("k") < F.col("n"), F.ln("lift") / -F.ln(F.col("k") / F.col("n"))).otherwise(F.lit(1.0)))


def profile_fits(seen: DataFrame, profiles: DataFrame, case: str, top: int) -> DataFrame:
    """(case, profile, coverage, precision, fit, place): the ``top`` profiles of each case. ``seen`` is (case, feature),
    ``profiles`` (profile, feature); a feature weighs ln(1 + profiles / profiles with it). Coverage is the share of a profile's
    weight that was seen, precision the share of the seen weight that the profile explains, fit their mean. Seen features
    that no profile knows weigh nothing. Ties go to the smaller profile. Profiles go to all tasks; cases are dealt by the rows
    that they make with them."""
    profiles, seen = profiles.select("profile", "feature").distinct(), distinct(seen.select(case, "feature"), case)
    n = profiles.agg(F.countDistinct("profile").alias("n"))
    weights = profiles.groupBy("feature").agg(F.count(F.lit(1)).alias("df")).crossJoin(n).select("feature", "df", F.ln(1 + F.col("n") / F.col("df")).alias("w"))
    weighed, known = profiles.join(weights, "feature"), kept(seen.join(F.broadcast(weights), "feature"), "known")
    met = known.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]  # one number: rows of cases and profiles with a feature in common
    known = dealt(known, met, case)
    whole, mass = F.broadcast(weighed.groupBy("profile").agg(F.sum("w").alias("whole"))), known.groupBy(case).agg(F.sum("w").alias("mass"))
    both = known.join(F.broadcast(profiles), "feature").groupBy(case, "profile").agg(F.sum("w").alias("met"))
    fits = both.join(whole, "profile").join(mass, case).withColumn("coverage", F.col("met") / F.col("whole")).withColumn("precision", F.col("met") / F.col("mass"))
    fits = fits.withColumn("fit", F.round((F.col("coverage") + F.col("precision")) / 2, 6))
    place = F.row_number().over(Window.partitionBy(case).orderBy(F.desc("fit"), "profile"))
    return fits.withColumn("place", place).where(F.col("place") <= top).select(case, "profile", "coverage", "precision", "fit", "place")


def sense(tokens: Column, cues: dict[str, tuple[list[str], list[str]]]) -> Column:
    """The sense whose cues the tokens hold most, anti-cues counted twice against it; null unless one is above nought and
    alone at the top. ``cues`` is sense to (cues, anti-cues)."""

    def of(x: Column) -> Column:
        def held(some: list[str]) -> Column:
            return F.size(F.array_intersect(x, F.array(*[F.lit(s) for s in some]).cast("array<string>")))

        return F.array(*[F.struct((held(yes) - 2 * held(no)).alias("score"), F.lit(name).alias("sense")) for name, (yes, no) in cues.items()])

    def best_of(scored: Column) -> Column:
        best = F.array_max(F.transform(scored, lambda s: s["score"]))
        first = F.filter(scored, lambda s: s["score"] == best)
        return F.when((best > 0) & (F.size(first) == 1), F.get(first, F.lit(0))["sense"])

    # bound once each, so that the words are not split again for every cue
    return F.transform(F.transform(F.array(tokens), of), best_of).getItem(0)


def first_rule(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first rule (name, pattern) that the text meets."""
    out = None
    for name, pattern in rules:
        met = text.rlike(pattern)
        out = F.when(met, name) if out is None else out.when(met, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def substitutions(docs: DataFrame, rules: list[tuple[str, str, str, int]], by: str, text: str = "text") -> DataFrame:
    """(by, rule, since, original, substitute, verdict) for rules (rule, original, substitute, since): how often a group's texts
    hold each form, and whether it avoids the original. Texts are summed before they are shuffled. Avoided: three
    substitutes or more and 0.8 of all; kept: three originals or more and 0.2 or less; else mixed, or none."""

    def times(form: str) -> Column:
        return F.sum((F.length(text) - F.length(F.replace(F.col(text), F.lit(form), F.lit("")))) / len(form)).cast("long")

    counts = [F.struct(F.lit(name).alias("rule"), F.lit(since).alias("since"), F.coalesce(times(a), F.lit(0)).alias("original"), F.coalesce(times(b), F.lit(0)).alias("substitute")) for name, a, b, since in rules]
    rows = docs.groupBy(by).agg(F.array(*counts).alias("rows")).select(by, F.explode("rows").alias("r")).select(by, "r.*")
    whole = F.col("original") + F.col("substitute")
    share = F.col("substitute") / F.nullif(whole, F.lit(0))
    verdict = F.when(whole == 0, "none").when((F.col("substitute") >= 3) & (share >= 0.8), "avoided").when((F.col("original") >= 3) & (share <= 0.2), "kept").otherwise("mixed")
    return rows.withColumn("verdict", verdict)


def earliest_floor(verdicts: DataFrame, by: str) -> DataFrame:
    """(by, floor): no text of the group is older than the latest avoidance that it shows; null where it shows none."""
    return verdicts.groupBy(by).agg(F.max(F.when(F.col("verdict") == "avoided", F.col("since"))).alias("floor"))


def agreement(units: DataFrame, unit: str, witness: str, reading: str) -> DataFrame:
    """(pattern, n): which witnesses agree where readings differ. A pattern lists the groups of witnesses in order; units
    where all agree or one witness stands alone have none."""
    groups = units.groupBy(unit, reading).agg(F.array_join(F.sort_array(F.collect_set(F.col(witness).cast("string"))), "").alias("g"))
    patterns = groups.groupBy(unit).agg(F.count(F.lit(1)).alias("readings"), F.array_join(F.sort_array(F.collect_list("g")), "|").alias("pattern")).where("readings > 1")
    return patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def shared_innovations(units: DataFrame, unit: str, witness: str, reading: str) -> DataFrame:
    """(witnesses, n): groups of two witnesses or more that share a reading which fewer than half of the unit's have."""
    groups = units.groupBy(unit, reading).agg(F.sort_array(F.collect_set(F.col(witness).cast("string"))).alias("g"))
    most = groups.withColumn("of", F.sum(F.size("g")).over(Window.partitionBy(unit)))
    minor = most.where((F.size("g") >= 2) & (2 * F.size("g") < F.col("of")))
    return minor.groupBy(F.array_join("g", "").alias("witnesses")).agg(F.count(F.lit(1)).alias("n"))


def equivalents(forms: DataFrame, group: str, form: str) -> DataFrame:
    """(form, common, n): every form of a group but the commonest, mapped to it; ties go to the smaller form."""
    n = forms.groupBy(group, form).agg(F.count(F.lit(1)).alias("n"))
    first = F.first(form).over(Window.partitionBy(group).orderBy(F.desc("n"), form))
    return n.withColumn("common", first).where(F.col(form) != F.col("common")).select(form, "common", "n")


def disagreements(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, left, right): what two catalogues say differently; a field named ``key`` marks rows that one lacks."""
    sides = a.select(key, F.struct(*fields).alias("x")).join(b.select(key, F.struct(*fields).alias("y")), key, "full")
    said = [F.struct(F.lit(f).alias("field"), F.col(f"x.{f}").cast("string").alias("left"), F.col(f"y.{f}").cast("string").alias("right")) for f in fields]
    here = F.struct(F.lit(key).alias("field"), F.when(F.col("x").isNotNull(), F.col(key).cast("string")).alias("left"), F.when(F.col("y").isNotNull(), F.col(key).cast("string")).alias("right"))
    found = F.when(F.col("x").isNull() | F.col("y").isNull(), F.array(here)).otherwise(F.filter(F.array(*said), lambda s: ~s["left"].eqNullSafe(s["right"])))
    return sides.select(key, F.explode(found).alias("s")).select(key, "s.*")


def linked_by_key(records: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """(key, work, place): the work of the first of a record's ``keys`` (array, in order of trust) that the index (alias,
    work) knows; of works that share an alias, the smallest."""
    asked = records.select(key, F.posexplode("keys").alias("place", "alias"))
    known = index.groupBy("alias").agg(F.min("work").alias("work"))
    hits = asked.join(known, "alias")
    return hits.groupBy(key).agg(F.min(F.struct("place", "work")).alias("h")).select(key, "h.work", "h.place")


def constraint(said: str, year: Column) -> Column:
    """A condition on years from words: "before 1998", "after 1995", "1995 to 1998" (both ends in), "in 1996"."""
    years = [int(y) for y in re.findall(r"\d{1,4}", said)]
    words = said.lower().split()
    if "before" in words and len(years) == 1:
        return year < years[0]
    if "after" in words and len(years) == 1:
        return year > years[0]
    if len(years) == 2 and ("to" in words or "between" in words):
        return year.between(*sorted(years))
    if "in" in words and len(years) == 1:
        return year == years[0]
    raise ValueError(f"no period in {said!r}")


def fitted(items: DataFrame, group: str, order: str, size: Column, most: int) -> DataFrame:
    """Items of each group, in order, as long as their sizes together stay within ``most``."""
    so_far = F.sum(size).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("so_far", so_far).where(F.col("so_far") <= most)


def layers(docs: DataFrame, cut: dict[str, str], text: str = "text") -> DataFrame:
    """``docs`` with one array column a layer of pieces cut out by its pattern, in turn, and ``body``: the text that is left."""
    out = docs.withColumn("body", F.coalesce(F.col(text), F.lit("")))
    for name, pattern in cut.items():
        out = out.withColumn(name, F.regexp_extract_all("body", F.lit(f"({pattern})"), F.lit(1))).withColumn("body", F.regexp_replace("body", pattern, ""))
    return out


def best_split(points: DataFrame, feature: str, at: str, value: str, least: int = 2) -> DataFrame:
    """(at, ss): the one split of a series with several features that leaves the least squared distance from the two
    sides' means; ``at`` opens the second side, and each side has ``least`` points or more. The series has one row a
    feature and place, every feature at each place, so it is as long as there are periods."""
    sofar = Window.partitionBy(feature).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy(feature).orderBy(at).rowsBetween(0, Window.unboundedFollowing)

    def spread(w: Window) -> Column:
        return F.sum(F.col(value) * F.col(value)).over(w) - F.sum(value).over(w) * F.sum(value).over(w) / F.count(value).over(w)

    cut = points.withColumn("ss", spread(sofar) + spread(rest)).withColumn("left", F.count(value).over(sofar)).withColumn("right", F.count(value).over(rest))
    sums = cut.where((F.col("left") >= least) & (F.col("right") >= least)).groupBy(at).agg(F.round(F.sum("ss"), 6).alias("ss"))
    return sums.agg(F.min(F.struct("ss", at)).alias("b")).select(f"b.{at}", "b.ss")


def transmission(edges: DataFrame, by: list[str], mode: str, modes: list[str], at: str) -> DataFrame:
    """One row a group: how many edges of each stated mode, and where (``at``) each mode is first seen (null if never)."""
    counts = [F.count(F.when(F.col(mode) == m, 1)).alias(f"n_{m.lower()}") for m in modes]
    firsts = [F.min(F.when(F.col(mode) == m, F.col(at))).alias(f"first_{m.lower()}") for m in modes]
    return edges.groupBy(*by).agg(*counts, *firsts)


def holding(baskets: DataFrame, targets: list[str], basket: str = "basket", item: str = "item") -> DataFrame:
    """(basket, members) of baskets that hold every target; repeated items count once."""
    hit = F.countDistinct(F.when(F.col(item).isin(targets), F.col(item)))
    sums = baskets.groupBy(basket).agg(F.countDistinct(item).alias("members"), hit.alias("hit"))
    return sums.where(F.col("hit") == len(set(targets))).select(basket, "members")


def harvest(docs: DataFrame, pattern: str, least: int, least_docs: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(candidate, n, docs): what the pattern's first group finds in lower-cased texts, with enough places and texts behind it."""
    found = docs.select(key, F.explode(F.regexp_extract_all(T.lower(F.col(text)), F.lit(pattern), F.lit(1))).alias("candidate"))
    one = found.groupBy("candidate", key).agg(F.count(F.lit(1)).alias("k"))
    return one.groupBy("candidate").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("docs")).where((F.col("n") >= least) & (F.col("docs") >= least_docs))


def in_grams(doses: DataFrame, units: list[tuple[str, int, int, float]], dose: str = "dose", year: str = "year") -> DataFrame:
    """``doses`` with ``amount``, ``unit`` and ``grams``: a dose reads "12 unit", and a unit (unit, since, until, grams) weighs what it
    did in that year. Null where the dose does not parse or no unit of that name held then."""
    spark = doses.sparkSession
    table = F.broadcast(spark.createDataFrame(units, "unit string, since int, until int, each double"))  # a stated list
    read = doses.withColumn("amount", F.regexp_extract(dose, r"^([0-9]+(?:\.[0-9]+)?) ?([a-z]+)$", 1).try_cast("double")).withColumn("unit", F.nullif(F.regexp_extract(dose, r"^([0-9]+(?:\.[0-9]+)?) ?([a-z]+)$", 2), F.lit("")))
    held = (read["unit"] == table["unit"]) & (read[year] >= table["since"]) & (read[year] < table["until"])
    return read.join(table, held, "left").select(*[read[c] for c in read.columns], (F.col("amount") * F.col("each")).alias("grams"))


def located(probes: DataFrame, docs: DataFrame, n: int, top: int, probe: str = "item_id", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(probe, key, hits, place): the ``top`` texts that hold most of a noisy text's distinct word runs. Both sides meet on hashed
    runs; ties go to the smaller key; probes without a common run have no row."""
    asked, held = (x.select(k, F.explode(F.array_distinct(F.transform(T.word_ngrams(T.words(F.col(text)), n), lambda r: F.xxhash64(r)))).alias("run")) for x, k in ((probes, probe), (docs, key)))
    hits = asked.join(held, "run").groupBy(probe, key).agg(F.count(F.lit(1)).alias("hits"))
    place = F.row_number().over(Window.partitionBy(probe).orderBy(F.desc("hits"), key))
    return hits.withColumn("place", place).where(F.col("place") <= top)


def clozes(docs: DataFrame, term: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, card): each sentence that holds the term as a word between blanks, with the term blanked out."""
    sentences = docs.select(key, F.explode(F.split(text, "[.!?\n]")).alias("s")).where(F.contains("s", F.lit(f" {term} ")))
    return sentences.select(key, F.replace("s", F.lit(f" {term} "), F.lit(" ___ ")).alias("card"))


def accepted(measures: DataFrame, group: str, criteria: dict[str, Column]) -> DataFrame:
    """(group, verdict, failed): a group is accepted if all its rows meet all criteria, undecided if one is null and none
    fails; ``failed`` names the criteria that fail, in the order given."""
    met = measures.groupBy(group).agg(*[F.bool_and(F.coalesce(c, F.lit(True))).alias(f"_ok{i}") for i, c in enumerate(criteria.values())], *[F.bool_or(c.isNull()).alias(f"_no{i}") for i, c in enumerate(criteria.values())])
    failed = F.array_compact(F.array(*[F.when(~F.col(f"_ok{i}"), name) for i, name in enumerate(criteria)]))
    unknown = F.greatest(*[F.col(f"_no{i}") for i in range(len(criteria))], F.lit(False), F.lit(False))
    return met.select(group, F.when(F.size(failed) > 0, "failed").when(unknown, "undecided").otherwise("accepted").alias("verdict"), failed.alias("failed"))


def divergence(counts: DataFrame, group: str, token: str, n: str) -> DataFrame:
    """(group, jsd): Jensen-Shannon divergence in bits of each group's counts (group, token, n) from all others' together. A
    group alone has null."""
    whole = counts.groupBy(token).agg(F.sum(n).alias("all"))
    own = counts.groupBy(group).agg(F.sum(n).alias("own"), F.count(F.lit(1)).alias("kinds"))
    rest = counts.agg(F.sum(n).alias("total"))
    # tokens that the group lacks add q / 2 each: what is left of the others' mass
    rows = counts.join(whole, token).join(own, group).crossJoin(rest)
    p, q = F.col(n) / F.col("own"), (F.col("all") - F.col(n)) / F.nullif(F.col("total") - F.col("own"), F.lit(0))
    m = (p + q) / 2
    part = p * F.log2(p / m) / 2 + F.when(q > 0, q * F.log2(q / m) / 2).otherwise(0.0)
    sums = rows.groupBy(group).agg(F.sum(part).alias("s"), F.sum(q).alias("q"))
    return sums.select(group, (F.col("s") + (1 - F.col("q")) / 2).alias("jsd"))
