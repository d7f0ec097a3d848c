"""Text reuse: shingle samples, containment, duplicate verdicts, weighted overlap, TF-IDF, keyness."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T
from ..sources.records import dealt, kept
from . import overlap

#: Documents that may share a shingle before it no longer makes pairs.
COMMON = 64
#: Documents of a case, and pairs that are passed on together.
MEMBERS, TOLD = 1 << 10, 1 << 17


def shingle_sample(docs: DataFrame, n: int = 5, one_in: int = 8, key: str = "doc_id") -> DataFrame:
    """(key, shingle): hashes of the distinct word shingles whose digest falls in the sample; the same shingle is in it wherever
    it occurs. Shingles outside the sample are left out before rows are made of them. The sample is written, as whoever
    takes it reads it more than once."""
    runs = T.word_ngrams(T.words(F.col("text")), n)

    def drawn(s: Column) -> Column:
        if 16 % one_in == 0:  # the last of the four digits says it all
            return F.substring(F.md5(s), 4, 1).isin([f"{d:x}" for d in range(0, 16, one_in)])
        return F.conv(F.substring(F.md5(s), 1, 4), 16, 10).cast("int") % one_in == 0

    hashes = F.array_distinct(F.transform(F.filter(runs, drawn), lambda s: F.xxhash64(s)))
    return kept(docs.select(key, F.explode(hashes).alias("shingle")), "shingles")


def containment(candidates: DataFrame, held: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, other, shared, of_key, of_other) for all pairs that share a shingle, however few: as many pairs as there
    are; ``contained`` is the way with a threshold. Shingles are counted once a pair."""
    size = candidates.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    other = held.withColumnRenamed(key, "other")
    other_size = other.groupBy("other").agg(F.count(F.lit(1)).alias("m"))
    shared = candidates.join(other, "shingle").where(F.col(key) != F.col("other")).groupBy(key, "other").agg(F.count(F.lit(1)).alias("shared"))
    return shared.join(size, key).join(other_size, "other").select(key, "other", "shared", (F.col("shared") / F.col("n")).alias("of_key"), (F.col("shared") / F.col("m")).alias("of_other"))


def _cases(sampled: DataFrame, common: int, key: str) -> DataFrame:
    """(case, of, m, rare, often, made): the different sets of shingles that documents share with others.

    Shingles that one document alone has are left out before sets are made, so documents that differ in these only are one case:
    ``of`` holds the number of all their shingles and their ids, smallest first (``MEMBERS`` at most; more make another case of
    the same set), ``m`` says how many shingles the set has. ``rare`` and ``often`` are those that other cases have too, up to
    ``common`` cases and more, rarest first; ``made`` is how many cases the rare ones meet. Null ids are in no case."""
    hashed = sampled.where(F.col(key).isNotNull()).select(key, "shingle")
    rows = hashed.count()
    by_shingle = dealt(hashed, rows, "shingle")
    again = kept(by_shingle.join(by_shingle.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shingle").select(key, "shingle"), "again")
    size = hashed.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    sets = dealt(again, again.count(), key).groupBy(key).agg(F.sort_array(F.collect_set("shingle")).alias("c")).join(size, key)
    equal = sets.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("n", F.col(key).alias("id")))).alias("of"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("of") - 1) / MEMBERS).cast("int")), lambda i: F.slice("of", i * MEMBERS + 1, MEMBERS))
    cases = kept(equal.select("c", F.explode(parts).alias("of")).withColumn("case", F.col("of")[0]["id"]), "cases")
    rows = cases.agg(F.coalesce(F.sum(F.size("c")), F.lit(0))).first()[0]  # one number
    items = dealt(cases.select("case", F.explode("c").alias("shingle")), rows, "shingle")
    ranked = items.join(items.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shingle")
    ranked = dealt(ranked, rows, "case").groupBy("case").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("x"))
    both = cases.select("case", "of", F.size("c").cast("long").alias("m")).join(ranked, "case", "left").withColumn("x", F.coalesce("x", F.array().cast(ranked.schema["x"].dataType)))
    few, many = F.filter("x", lambda s: s["df"] <= common), F.filter("x", lambda s: s["df"] > common)
    made = F.aggregate(few, F.lit(0).cast("long"), lambda n, s: n + s["df"] - 1)
    return kept(both.select("case", "of", "m", F.transform(few, lambda s: s["shingle"]).alias("rare"), F.transform(many, lambda s: s["shingle"]).alias("often"), made.alias("made")), "sets")


def _rare_pairs(cases: DataFrame, *along: str) -> DataFrame:
    """(a, b, r): pairs of cases, a before b, and how many rare shingles they share, with the columns ``along`` of each as a_ and b_."""
    rows, made = cases.agg(F.coalesce(F.sum(F.size("rare")), F.lit(0)), F.coalesce(F.sum("made"), F.lit(0))).first()  # two numbers
    rare = dealt(cases.select("case", F.explode("rare").alias("shingle")), max(rows, made // 2), "shingle")
    met = rare.withColumnRenamed("case", "a").join(rare.withColumnRenamed("case", "b"), "shingle").where("a < b").select("a", "b")
    return dealt(met, made // 2, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("r"))


def best_containment(sampled: DataFrame, common: int = COMMON, key: str = "doc_id") -> DataFrame:
    """(key, of_key): the largest share of a document's shingles that one other document holds, for every document that
    has a shingle in common with another. ``sampled``: key, shingle, each once.

    Documents that are one case share all they can. Pairs of the other cases are made from shingles of at most ``common`` cases, so
    their number grows as the rows do; what a pair shares of commoner ones comes from the cases' own sets. Cases that share
    commoner shingles alone are not paired: equal sets of these are one, and a set that only one case has is held against
    those with one of its rarest, as many as a set that shares more than is known already can't do without."""
    cases = _cases(sampled, common, key)
    often = cases.where(F.size("often") > 0).select("case", "often")
    pairs = kept(_rare_pairs(cases), "pairs")
    both = pairs.join(often.select(F.col("case").alias("a"), F.col("often").alias("x")), "a", "left").join(often.select(F.col("case").alias("b"), F.col("often").alias("y")), "b", "left")
    shared = both.select(F.explode(F.array("a", "b")).alias("case"), (F.col("r") + F.coalesce(F.size(F.array_intersect("x", "y")), F.lit(0))).alias("shared"))
    near = kept(shared.groupBy("case").agg(F.max("shared").alias("shared")), "near")
    alike = cases.where(F.size("of") > 1).select("case", F.col("m").alias("shared"))
    sets = often.groupBy("often").agg(F.min("case").alias("first"), F.count(F.lit(1)).alias("cases"))
    met = kept(often.join(sets, "often"), "often")
    same = met.where("cases > 1").select("case", F.size("often").cast("long").alias("shared"))
    known = near.unionByName(alike).groupBy("case").agg(F.max("shared").alias("known"))
    asked = met.where("case = first").join(known, "case", "left")
    wanted = F.when(F.col("cases") == 1, F.size("often") - F.coalesce("known", F.lit(0))).otherwise(0)  # how many of the rarest
    held = asked.select("case", F.col("often").alias("x"), wanted.alias("_wanted"), F.posexplode("often").alias("_at", "shingle")).select("case", "x", F.col("_at").alias("at"), "shingle", (F.col("_at") < F.col("_wanted")).alias("asks"))

    def most(there: overlap.Held, here: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists, at, found = here["x"], here["at"].to_pylist(), []
        for row, place in enumerate(there.own(here["case"]).tolist()):
            tail = lists[row].values.to_numpy()[at[row] :]  # who has a rarer one meets there
            told = there.answers.get(tail.tobytes())
            if told is None:
                n = np.bincount(there.having(tail), minlength=max(2, there.rows.num_rows))
                told = there.answers[tail.tobytes()] = np.partition(n, -2)[-2:].tolist()
            found.append(told[place < 0])  # a set's own tail is the largest
        yield pa.RecordBatch.from_arrays([here["case"], pa.array(found, pa.int64())], names=["case", "shared"])

    rest = overlap.by_items(held, most, f"case {dict(cases.dtypes)['case']}, shared long").where("shared > 0")
    every = near.unionByName(alike).unionByName(same).unionByName(rest).groupBy("case").agg(F.max("shared").alias("shared"))
    return cases.select("case", "of").join(every, "case").select("shared", F.inline("of")).select(F.col("id").alias(key), (F.col("shared") / F.col("n")).alias("of_key"))


def contained(sampled: DataFrame, least: float, key: str = "doc_id", common: int = COMMON) -> DataFrame:
    """(key, other, shared, of_key, of_other) for pairs with ``of_key`` of ``least`` or more.

    Documents that are one case share its shingles. Cases that have a shingle of at most ``common`` cases in common are paired by these and
    counted, and what they share of commoner ones comes from their own sets. All others meet under the rarest shingle that
    they share, which stands among the rarest n - ceil(least * n) + 1 of who asks, so a shingle that very many have is
    asked for by hardly any. Pairs go between tasks only where they share a rare shingle; they are made into pairs of
    documents where they are found, in the end.
    """
    cases = _cases(sampled, common, key)
    kind = dict(cases.dtypes)["case"]
    ways = [F.col(c) for c in ("key", "other", "shared", "n", "o")]

    def told(df: DataFrame, a: str, b: str) -> DataFrame:
        """Pairs of documents of two cases: ``a`` and ``b`` hold the numbers of shingles and ids, ``shared`` what they share."""
        some = F.filter(a, lambda d: F.col("shared") / d["n"] >= least)
        asked = df.select("shared", F.explode(some).alias("p"), F.col(b).alias("_b")).select("shared", "p", F.explode("_b").alias("q"))
        return asked.select(F.col("p.id").alias("key"), F.col("q.id").alias("other"), "shared", F.col("p.n").alias("n"), F.col("q.n").alias("o"))

    alike = told(cases.where(F.size("of") > 1).select("of", F.col("m").alias("shared")), "of", "of").where("key <> other")
    some = cases.select("case", F.col("of")[0]["n"].alias("n"), F.size("often").alias("o"))
    pairs = _rare_pairs(cases)
    for side in "ab":
        pairs = pairs.join(some.toDF(side, f"{side}n", f"{side}o"), side)
    pairs = kept(pairs.where((F.col("r") + F.least("ao", "bo")) / F.least("an", "bn") >= least).select("a", "b", "r"), "pairs")
    many = pairs.count()
    both = pairs
    for side in "ab":
        both = dealt(both, many, side).join(dealt(cases.select(F.col("case").alias(side), F.col("of").alias(f"{side}of"), F.col("often").alias(f"{side}x")), many, side).hint("shuffle_hash"), side)
    both = both.select("aof", "bof", (F.col("r") + F.size(F.array_intersect("ax", "bx"))).alias("shared"))
    both = both.select("shared", F.inline(F.array(F.struct(F.col("aof").alias("x"), F.col("bof").alias("y")), F.struct(F.col("bof").alias("x"), F.col("aof").alias("y")))))
    near = told(both, "x", "y")
    need = F.ceil(F.col("of")[0]["n"] * least - 1e-9)
    held = cases.where(F.size("often") > 0).select("case", "of", "rare", "often", need.alias("_need"), F.posexplode("often").alias("_at", "shingle"))
    held = held.select("case", F.concat("rare", "often").alias("x"), (F.size("rare") + F.col("_at")).alias("at"), (F.size("often") - F.col("_at") >= F.col("_need")).alias("asks"), F.transform("of", lambda d: d["n"]).alias("n"), F.transform("of", lambda d: d["id"]).alias("ids"), "shingle")

    def sharing(there: overlap.Held, here: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, sizes = there.rows["ids"].chunk(0), there.rows["n"].chunk(0)
        first, ids, sizes = ids.offsets.to_numpy(), ids.values, sizes.values
        out, told = [], 0
        for row, place in enumerate(there.own(here["case"]).tolist()):
            x, at = here["x"][row].values.to_numpy(), here["at"][row].as_py()
            n = np.bincount(there.having(x[at:]), minlength=there.rows.num_rows)
            n[there.having(x[:at])] = 0  # these meet under a rarer one
            if place >= 0:
                n[place] = 0
            for own, size in zip(here["ids"][row].values, here["n"][row].values.to_numpy().tolist()):
                to = np.flatnonzero((n > 0) & (n / size >= least))
                if not len(to):
                    break  # the others have as many shingles or more
                long = first[to + 1] - first[to]
                docs = np.repeat(first[to] - (long.cumsum() - long), long) + np.arange(long.sum())
                out.append((own, ids.take(pa.array(docs)), np.repeat(n[to], long), size, sizes.take(pa.array(docs))))
                told += len(docs)
                if told >= TOLD:
                    yield lists(out)
                    out, told = [], 0
        if out:
            yield lists(out)

    def lists(out: list) -> pa.RecordBatch:
        own, ids, shared, size, sizes = zip(*out)
        ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([x.as_py() for x in own], ids[0].type), pa.ListArray.from_arrays(ends, pa.concat_arrays(ids)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(shared), pa.int64())), pa.array(size, pa.int64()), pa.ListArray.from_arrays(ends, pa.concat_arrays(sizes))],
            names=["key", "others", "of", "n", "os"],
        )

    rest = overlap.by_items(held, sharing, f"key {kind}, others array<{kind}>, of array<long>, n long, os array<long>")
    rest = rest.select("key", "n", F.inline(F.arrays_zip("others", "of", "os"))).select("key", F.col("others").alias("other"), F.col("of").alias("shared"), "n", F.col("os").alias("o"))
    every = alike.select(*ways).unionByName(near.select(*ways)).unionByName(rest.select(*ways))
    return every.select(F.col("key").alias(key), "other", "shared", (F.col("shared") / F.col("n")).alias("of_key"), (F.col("shared") / F.col("o")).alias("of_other"))


def union_contained(sampled: DataFrame, least: float, key: str = "doc_id") -> DataFrame:
    """(key, n, elsewhere, of_union, covered): how many of a document's shingles all others hold together. Shingles are
    counted, no documents are paired."""
    hashed = sampled.select(key, "shingle")
    df = hashed.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    out = hashed.join(df, "shingle").groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("df") > 1, 1)).alias("elsewhere"))
    return out.withColumn("of_union", F.col("elsewhere") / F.col("n")).withColumn("covered", F.col("of_union") >= least)


def verdict(contained: DataFrame, duplicate: float = 0.85, overlap: float = 0.3, key: str = "doc_id") -> DataFrame:
    """(key, best, verdict): duplicate, overlap or new by the best containment."""
    best = contained.groupBy(key).agg(F.max("of_key").alias("best"))
    return best.withColumn("verdict", F.when(F.col("best") >= duplicate, "duplicate").when(F.col("best") >= overlap, "overlap").otherwise("new"))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(first, n): groups of equal texts by digest, more than one row each."""
    return docs.groupBy(F.sha2(text, 256).alias("digest"), F.length(text).alias("chars")).agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("first", "n", "chars")


def tfidf(counts: DataFrame, unit: str) -> DataFrame:
    """(unit, token, w) of (unit, token, tf): (1 + ln tf) * ln(N / df), length one."""
    n = counts.agg(F.countDistinct(unit).alias("N"))
    df = counts.groupBy("token").agg(F.countDistinct(unit).alias("df"))
    raw = counts.join(df, "token").crossJoin(n).withColumn("w", (1 + F.ln("tf")) * F.ln(F.col("N") / F.col("df"))).where("w > 0")
    norm = raw.groupBy(unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, unit).select(unit, "token", (F.col("w") / F.col("norm")).alias("w"))


def cosine(weights: DataFrame, unit: str) -> DataFrame:
    """(a, b, cosine) of units that share a token."""
    x, y = weights.select(F.col(unit).alias("a"), "token", F.col("w").alias("x")), weights.select(F.col(unit).alias("b"), "token", F.col("w").alias("y"))
    return x.join(y, "token").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))


def keyness(a: DataFrame, b: DataFrame, weight: float = 10.0) -> DataFrame:
    """(token, ya, yb, z) of counts (token, n): log-odds with an informative prior taken from both sides."""
    both = a.select("token", F.col("n").alias("ya")).join(b.select("token", F.col("n").alias("yb")), "token", "full").select("token", F.coalesce("ya", F.lit(0)).alias("ya"), F.coalesce("yb", F.lit(0)).alias("yb"))
    sums = both.agg(F.sum("ya").alias("na"), F.sum("yb").alias("nb"))
    rows = both.crossJoin(sums)
    prior = weight * (F.col("ya") + F.col("yb")) / (F.col("na") + F.col("nb"))

    def odds(y: Column, n: Column) -> Column:
        return F.ln((y + prior) / (n + weight - y - prior))

    z = (odds(F.col("ya"), F.col("na")) - odds(F.col("yb"), F.col("nb"))) / F.sqrt(1 / (F.col("ya") + prior) + 1 / (F.col("yb") + prior))
    return rows.select("token", "ya", "yb", z.alias("z"))


def scores(found: Column, wanted: Column) -> list[Column]:
    """Aggregates of a classification: true and false positives and negatives, precision, recall, F1, accuracy."""
    tp, fp = F.count(F.when(found & wanted, 1)), F.count(F.when(found & ~wanted, 1))
    fn, tn = F.count(F.when(~found & wanted, 1)), F.count(F.when(~found & ~wanted, 1))
    precision, recall = tp / F.nullif(tp + fp, F.lit(0)), tp / F.nullif(tp + fn, F.lit(0))
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), precision.alias("precision"), recall.alias("recall"), (2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0))).alias("f1"), ((tp + tn) / F.nullif(tp + fp + fn + tn, F.lit(0))).alias("accuracy")]


def admission(text: Column) -> Column:
    """admit, review or exclude by densities per 10,000 characters: marks of junk, links, digits."""
    junk, digits = T.density(text, r"[#*$%&|<>]"), T.density(text, r"[0-9]")
    return F.when(junk >= 300, "exclude").when((junk >= 50) | (digits >= 500), "review").otherwise("admit")


__all__ = ["admission", "best_containment", "contained", "containment", "cosine", "exact_groups", "keyness", "scores", "shingle_sample", "stats", "tfidf", "union_contained", "verdict"]
