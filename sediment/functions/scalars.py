"""Scalar functions beyond text: hashes, JSON, numerals, cycles, confidence, formats; all but silhouettes are columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# Letters with marks and without, the ten stems and twelve branches, and the numerals' digits and units.
MARKED, PLAIN = "äöüáàâéèêíîóôúûñç", "aouaaaeeeiioouunc"
STEMS, BRANCHES = "甲乙丙丁戊己庚辛壬癸", "子丑寅卯辰巳午未申酉戌亥"
DIGITS = "〇一二三四五六七八九"


def folded(text: Column) -> Column:
    """Lower-cased with marks taken off, letter for letter, so offsets stay."""
    return F.translate(T.lower(text), MARKED, PLAIN)


def letters_with_places(text: Column) -> tuple[Column, Column]:
    """ASCII letters alone, and where each stood (from 0)."""
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.struct(F.substring(text, i, F.lit(1)).alias("c"), (i - 1).alias("i")))
    kept = F.filter(every, lambda x: x["c"].rlike("^[A-Za-z]$"))
    return F.array_join(F.transform(kept, lambda x: x["c"]), ""), F.transform(kept, lambda x: x["i"])


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of an ASCII text."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * 16777619) % 4294967296)


def fitted_long(record: Column, name: str, default: int) -> tuple[Column, Column]:
    """Whether a JSON record's field is a whole number, and its value as one, or ``default``."""
    raw = F.get_json_object(record, f"$.{name}")
    return F.coalesce(raw.rlike("^-?[0-9]+$"), F.lit(False)), F.coalesce(raw.try_cast("long"), F.lit(default).cast("long"))


def first_json(text: Column) -> Column:
    """The first object without objects inside it that a text holds and that reads as JSON; null if none does."""
    found = F.filter(F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\})"), F.lit(1)), lambda x: F.json_object_keys(x).isNotNull())
    return F.get(found, F.lit(0))


def merged(one: Column, two: Column) -> Column:
    """Maps of maps merged key by key on both levels; ``two`` wins."""
    return F.map_zip_with(one, two, lambda k, a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_zip_with(a, b, lambda i, x, y: F.coalesce(y, x))))


def any_of(p: Column) -> Column:
    """Aggregate: the chance that at least one of independent findings holds."""
    return 1 - F.exp(F.sum(F.ln(1 - p)))


def cycle_name(year: Column) -> Column:
    """A year's name in the cycle of sixty (years from 4 on)."""
    return F.concat(F.substring(F.lit(STEMS), ((year - 4) % 10 + 1).cast("int"), F.lit(1)), F.substring(F.lit(BRANCHES), ((year - 4) % 12 + 1).cast("int"), F.lit(1)))


def numeral(n: Column) -> Column:
    """1 to 99 in numerals with a unit of ten."""
    tens, ones = F.floor(n / 10).cast("int"), (n % 10).cast("int")
    digit = lambda x: F.substring(F.lit(DIGITS), x + 1, F.lit(1))
    return F.concat(F.when(tens > 1, digit(tens)).otherwise(""), F.when(tens > 0, "十").otherwise(""), F.when(ones > 0, digit(ones)).otherwise(""))


def read_numeral(text: Column) -> Column:
    """The number of a numeral up to ninety-nine; null where it is none."""
    left, right = F.substring_index(text, "十", 1), F.substring_index(text, "十", -1)
    digit = lambda x: F.when(x == "", 0).otherwise(F.nullif(F.instr(F.lit(DIGITS), x), F.lit(0)) - 1)
    return F.when(text.contains("十"), F.when(left == "", 1).otherwise(digit(left)) * 10 + digit(right)).when(F.length(text) == 1, digit(text))


def p_text(p: Column) -> Column:
    return F.when(p < 0.001, "<0.001").otherwise(F.format_string("%.3f", p))


def three_valued(held: Column) -> Column:
    """confirmed, refuted, or open where nothing is known."""
    return F.when(held.isNull(), "open").when(held, "confirmed").otherwise("refuted")


def words_found(wanted: dict[str, str]) -> Column:
    """In how many of the columns their word stands, whatever the case."""
    return sum((F.when(F.lower(c).contains(w.lower()), 1).otherwise(0) for c, w in wanted.items()), F.lit(0))


def centre_silhouette(vectors: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(label, n, silhouette): mean of (b - a) / max(a, b) with the distances to the own and the nearest other centre. Each
    vector meets the centres, which are a row a label."""
    parts = vectors.select(key, label, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    centres = parts.groupBy(F.col(label).alias("_l"), "i").agg(F.avg("x").alias("m")).groupBy("_l").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    gap = F.sqrt(F.aggregate(F.zip_with(F.col(vector), "centre", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v))
    met = vectors.crossJoin(F.broadcast(centres)).withColumn("d", gap)
    a, b = F.min(F.when(F.col("_l") == F.col(label), F.col("d"))).alias("a"), F.min(F.when(F.col("_l") != F.col(label), F.col("d"))).alias("b")
    return met.groupBy(key, label).agg(a, b).groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))
