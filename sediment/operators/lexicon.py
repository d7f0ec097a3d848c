"""Lexicons over text: longest match, nearest entries, typed mentions and their resolution, collocates, word pairs."""

from __future__ import annotations

from collections.abc import Iterator

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.records import kept

#: Patterns of typed mentions, in the order in which overlapping ones of equal length are kept.
MENTIONS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    ("number", r"[0-9]+"),
    ("name", r"[A-Z][a-z]+"),
)


def matches(text: Column, entries: list[str]) -> Column:
    """The entries that stand in the text as an array: leftmost, the longest at each place, not overlapping. The lexicon is
    a stated list of a few thousand entries at most, as it becomes one pattern."""
    pattern = "|".join(re.escape(e) for e in sorted(set(entries), key=lambda e: (-len(e), e)))
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def _parts(words: DataFrame, column: str, most: int, probe: bool) -> DataFrame:
    """(column, size, part, piece) for words: an entry of ``size`` letters is cut into ``most`` + 1 pieces, of which ``most`` edits leave
    one whole, moved by ``most`` places at the most; a word that is asked for names all pieces it may share with an entry.
    Entries of no more than ``most`` letters have one empty piece."""

    def cuts(size: int) -> list[tuple[int, int]]:
        if size <= most:
            return [(0, 0)]
        return [(i * size // (most + 1), (i + 1) * size // (most + 1)) for i in range(most + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for word in batch.column(0).to_pylist():
                n = len(word)
                for size in range(max(0, n - most), n + most + 1) if probe else (n,):
                    for part, (lo, hi) in enumerate(cuts(size)):
                        for at in range(max(0, lo - most), min(n - (hi - lo), lo + most) + 1) if probe and hi > lo else (lo,):
                            rows.add((word, size, part, word[at : at + hi - lo]))
            cols = list(zip(*sorted(rows))) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.string()))], names=[column, "size", "part", "piece"])

    return words.where(F.col(column).isNotNull()).select(F.col(column).cast("string")).mapInArrow(run, f"{column} string, size int, part int, piece string")


def nearest(asked: DataFrame, entries: DataFrame, k: int, most: int = 3) -> DataFrame:
    """(asked, entry, distance): for each word the ``k`` entries of least edit distance up to ``most``; equally near ones by their
    letters. Words and entries meet where they share a piece (see ``_parts``), and are compared once. Null ones are left
    out, repeated ones count once."""
    words, held = asked.select("asked").distinct(), entries.select("entry").distinct()
    met = _parts(words, "asked", most, True).join(_parts(held, "entry", most, False), ["size", "part", "piece"]).select("asked", "entry").distinct()
    both = met.withColumn("distance", F.levenshtein("asked", "entry")).where(F.col("distance") <= most)
    w = Window.partitionBy("asked").orderBy("distance", "entry")
    return both.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("asked", "entry", "distance")


def mentions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, mention, n): typed mentions, by all patterns."""

    def typed(kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), F.lit(1))
        return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("mention")))

    kinds = [typed(kind, p) for kind, p in MENTIONS]
    return docs.select(key, F.explode(F.concat(*kinds)).alias("m")).select(key, "m.*").groupBy(key, "kind", "mention").agg(F.count(F.lit(1)).alias("n"))


def resolved(spans: DataFrame, by: str) -> DataFrame:
    """Spans (by, start, end) that no longer one overlaps, and of equal ones the first: each span's overlaps are those that
    start within the longest span's length before it."""
    w = Window.partitionBy(by)
    x = spans.withColumn("_most", F.max(F.col("end") - F.col("start")).over(w))
    other = spans.select(F.col(by).alias("_by"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = (F.col(by) == F.col("_by")) & (F.col("_s") < F.col("end")) & (F.col("start") < F.col("_e")) & (F.col("_s") > F.col("start") - F.col("_most"))
    longer = (F.col("_e") - F.col("_s") > F.col("end") - F.col("start")) | ((F.col("_e") - F.col("_s") == F.col("end") - F.col("start")) & (F.col("_s") < F.col("start")))
    return x.join(other, hit & longer, "left_anti").drop("_most")


def collocates(docs: DataFrame, term: str, distance: int, by: str, top: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(by, token, n): words within ``distance`` words of ``term``, the ``top`` of each group. Words are counted in a range
    window over a document's positions."""
    at = docs.where(T.lower(F.col(text)).contains(term)).select(key, by, F.posexplode(T.words(F.col(text))).alias("pos", "token"))
    around = Window.partitionBy(key).orderBy("pos").rangeBetween(-distance, distance)
    near = at.withColumn("n", F.count(F.when(F.col("token") == term, 1)).over(around)).where((F.col("token") != term) & (F.col("n") > 0))
    sums = near.groupBy(by, "token").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), "token")
    return sums.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")


def bigram_model(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pairs, mean_log): mean log probability of a word after the one before it, with one added to every count.

    Pairs and first words go once each to where they are counted, a row a document, as hashes of 64 bits; back goes a sum a
    document and task."""
    words = T.words(F.col(text))

    def counted(hashes: Column) -> Column:
        # how often each value stands in an array: where runs of equal ones begin once it is sorted
        def of(s: Column) -> Column:
            begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
            return F.transform(F.array(begins), lambda b: F.transform(b, lambda i, at: F.struct(F.get(s, i).alias("x"), (F.coalesce(F.get(b, at + 1), F.size(s)) - i).alias("n")))).getItem(0)

        return F.transform(F.array(F.sort_array(hashes)), of).getItem(0)

    def met(w: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.xxhash64(F.slice(w, i, n)))

    some = docs.select(key, words.alias("w")).where(F.size("w") > 1)

    def rows(n: int) -> DataFrame:
        found = F.transform(F.array("w"), lambda w: counted(met(w, n))).getItem(0)
        return some.select(key, F.inline(found)).withColumn("c", F.sum("n").over(Window.partitionBy("x")))

    pairs, heads = rows(2), rows(1)
    size = docs.select(F.explode(words).alias("w")).agg(F.countDistinct("w").alias("v"))
    sums = pairs.select(key, "n", (F.col("n") * F.ln(F.col("c") + 1)).alias("s")).unionByName(heads.crossJoin(size).select(key, F.lit(0).alias("n"), (-F.col("n") * F.ln(F.col("c") + F.col("v"))).alias("s")))
    return sums.groupBy(key).agg(F.sum("n").alias("pairs"), (F.sum("s") / F.sum("n")).alias("mean_log"))


def hashed_vectors(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, slot, weight): words hashed into ``width`` slots with a sign, 1 + ln tf, length one; empty slots are left out."""
    digest = F.md5("token")
    slot = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % width
    sign = F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    tf = docs.select(key, F.explode(T.words(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))
    raw = tf.groupBy(key, slot.alias("slot")).agg(F.sum(sign * (1 + F.ln("tf"))).alias("w"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).where("abs(w) > 1e-9").select(key, "slot", (F.col("w") / F.col("norm")).alias("weight"))


def reuse_features(docs: DataFrame, sources: DataFrame, n: int = 3, key: str = "doc_id", source: str = "item_id") -> DataFrame:
    """(source, key, shared, covered, span, in_order): how a document takes up a source: distinct runs of ``n`` words they share,
    their share of the source's, words from the first to the last of them in the document, and the share of
    neighbouring ones that come in the source's order. Runs are placed where they stand first; those that no source has
    are left out where they are read."""

    def runs(df: DataFrame, of: str) -> DataFrame:
        return df.select(of, F.posexplode(T.word_ngrams(T.words(F.col("text")), n)).alias("pos", "_g")).select(of, "pos", F.xxhash64("_g").alias("gram"))

    asked = kept(runs(sources, source).groupBy(source, "gram").agg(F.min("pos").alias("q")), "asked")
    held = runs(docs, key).join(asked.select("gram").distinct(), "gram", "left_semi").groupBy(key, "gram").agg(F.min("pos").alias("p"))
    size = asked.groupBy(source).agg(F.count(F.lit(1)).alias("runs"))
    before = F.lag("q").over(Window.partitionBy(source, key).orderBy("p", "q"))
    both = held.join(asked, "gram").withColumn("before", before)
    out = both.groupBy(source, key).agg(F.count(F.lit(1)).alias("shared"), (F.max("p") - F.min("p") + n).alias("span"), F.count(F.when(F.col("q") > F.col("before"), 1)).alias("up"), F.count("before").alias("steps"))
    return out.join(size, source).select(source, key, "shared", (F.col("shared") / F.col("runs")).alias("covered"), "span", F.when(F.col("steps") > 0, F.col("up") / F.col("steps")).otherwise(1.0).alias("in_order"))


def reuse_type(covered: Column, in_order: Column, shared: Column) -> Column:
    """verbatim, adapted, reordered, echo or chance, by how much is covered and whether it comes in order."""
    return F.when((covered >= 0.9) & (in_order >= 0.9), "verbatim").when((covered >= 0.4) & (in_order >= 0.7), "adapted").when(covered >= 0.4, "reordered").when(shared >= 2, "echo").otherwise("chance")
