"""Claims held against evidence, and equations of old terms with modern ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.records import kept

#: Verdicts from the worst to the best.
VERDICTS = ("contradicted", "contested", "unsupported", "related", "supported")
#: Words that equate what stands before and after them, and words that take an equation back.
JOINTS = ("is", "are", "was", "means", "ist", "sind", "est", "sont", "es", "son")
HEDGES = ("perhaps", "maybe", "like", "probably", "vielleicht", "wie", "peut", "comme", "quizá", "como")


def audited(claims: DataFrame, evidence: DataFrame, key: str = "claim") -> DataFrame:
    """``claims`` (key, subject, relation, object, denied, at) with ``verdict``, ``pro``, ``contra`` and ``related``.

    ``evidence``: source, subject, relation, object, denied, at. Sources that say the same, up to the claim's time, are ``pro``,
    those that say the opposite ``contra`` (each source once), those that have another object for its subject and
    relation ``related``. supported: some pro and no contra; contested: both; contradicted: contra alone; related:
    neither, but others have something of the kind; unsupported: nothing. A claim without a time takes all evidence,
    evidence without one is taken by such claims alone; nulls elsewhere meet nothing. A claim's own source counts too,
    unless it is left out of ``evidence``. Evidence is counted by statement and source before it meets claims."""
    held = kept(evidence.groupBy("source", "subject", "relation", "object", "denied").agg(F.min("at").alias("seen"), F.max(F.col("at").isNull()).alias("_timeless")), "evidence")
    asked = kept(claims.withColumn("_id", F.xxhash64(*[F.col(c).cast("string") for c in claims.columns])), "claims")
    some = asked.select("_id", "subject", "relation", F.col("object").alias("_o"), F.col("denied").alias("_d"), F.col("at").alias("_at")).distinct()
    met = some.join(held, ["subject", "relation"]).where(F.col("_at").isNull() | (F.col("seen") <= F.col("_at")))
    same = F.col("object") == F.col("_o")
    distinct = lambda c: F.count_distinct(F.when(c, F.col("source")))
    found = met.groupBy("_id").agg(distinct(same & (F.col("denied") == F.col("_d"))).alias("pro"), distinct(same & (F.col("denied") != F.col("_d"))).alias("contra"), distinct(~same).alias("related"))
    both = asked.join(found, "_id", "left").fillna(0, ["pro", "contra", "related"]).drop("_id")
    pro, contra = F.col("pro") > 0, F.col("contra") > 0
    return both.withColumn("verdict", F.when(pro & contra, "contested").when(pro, "supported").when(contra, "contradicted").when(F.col("related") > 0, "related").otherwise("unsupported"))


def overall(verdicts: DataFrame, key: str) -> DataFrame:
    """(key, claims, supported, verdict): the worst verdict of each text's claims, and how many are supported."""
    order = F.array(*map(F.lit, VERDICTS))
    worst = F.min(F.array_position(order, F.col("verdict")))
    out = verdicts.groupBy(key).agg(F.count(F.lit(1)).alias("claims"), F.count(F.when(F.col("verdict") == "supported", 1)).alias("supported"), worst.alias("_w"))
    return out.select(key, "claims", "supported", F.element_at(order, F.col("_w").cast("int")).alias("verdict"))


def _placed(docs: DataFrame, key: str) -> DataFrame:
    """(key, sentence, words) of sentences, numbered from 0."""
    return docs.where("text is not null").select(key, F.posexplode(T.sentences(F.col("text"))).alias("sentence", "s")).select(key, "sentence", T.words(F.col("s")).alias("w"))


def equations(docs: DataFrame, terms: DataFrame, within: int = 6, key: str = "doc_id") -> DataFrame:
    """(key, sentence, old, modern, n): sentences that equate a term of old texts with a modern one: both stand in it, in either order and
    no more than ``within`` words apart, a word of ``JOINTS`` between them, and no word of ``HEDGES`` in the sentence.

    ``terms``: term (one lower-cased word), modern (boolean); null ones are left out, a term that is both counts as modern.
    Only sentences with a joint, no hedge and both kinds of terms are gone into; their terms are joined by sentence. Null
    texts say nothing; repeated documents with one key count together."""
    known = terms.where("term is not null and modern is not null").groupBy("term").agg(F.max("modern").alias("modern"))
    lists = [F.array(*map(F.lit, x)) for x in (JOINTS, HEDGES)]
    some = kept(_placed(docs, key).where(F.arrays_overlap("w", lists[0]) & ~F.arrays_overlap("w", lists[1])), "sentences")
    at = some.withColumn("_row", F.monotonically_increasing_id())
    at = kept(at.select(key, "sentence", "_row", F.transform("w", lambda x, i: F.struct(i.alias("i"), x.alias("term"), F.array_contains(lists[0], x).alias("joint"))).alias("w")), "placed")
    joints = at.select("_row", F.transform(F.filter("w", lambda x: x["joint"]), lambda x: x["i"]).alias("joints"))
    hits = kept(at.select(key, "sentence", "_row", F.explode("w").alias("x")).select(key, "sentence", "_row", "x.i", "x.term").join(known, "term"), "terms")
    old = hits.where("not modern").select(key, "sentence", "_row", F.col("i").alias("a"), F.col("term").alias("old"))
    new = hits.where("modern").select(F.col("_row").alias("_r"), F.col("i").alias("b"), F.col("term").alias("modern"))
    pairs = old.join(new, (F.col("_row") == F.col("_r")) & (F.abs(F.col("a") - F.col("b")) <= within)).join(joints, "_row")
    between = F.exists("joints", lambda j: (j > F.least("a", "b")) & (j < F.greatest("a", "b")))
    return pairs.where(between).groupBy(key, "sentence", "old", "modern").agg(F.count(F.lit(1)).alias("n"))
