"""Lexicons and aliases in the document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import matching as M
from ..registry import query, table
from .text import TOKENS, WORDS

LEXICON = "e AS (SELECT DISTINCT entry FROM (SELECT unnest(" + WORDS.format("text") + ") AS entry FROM benchmark) WHERE length(entry) >= 4)"


def texts(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def lexicon(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(T.words(F.col("text"))).alias("entry"))
    return words.where("length(entry) >= 4").distinct()


@query(257, 286, sql=f"WITH {TOKENS}, {LEXICON} SELECT doc_id, count(*) AS mentions, count(DISTINCT token) AS entries FROM t JOIN e ON e.entry = t.token GROUP BY 1")
def lexicon_mentions(spark, d):
    found = M.matches(texts(spark, d), lexicon(spark, d), window=0, whole=True)
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("entry").alias("entries"))


@query(257)
def lexicon_longest_mentions(spark, d):
    found = M.longest(M.matches(texts(spark, d), lexicon(spark, d), window=0))
    return found.groupBy("entry").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(166, sql=f"""WITH {TOKENS.replace('unnest(ts) AS token', 'unnest(ts) AS token, unnest(range(0, len(ts))) AS at')}, {LEXICON},
r AS (SELECT entry, CASE WHEN length(entry) % 2 = 0 THEN ['the', 'die', 'la', 'de'] END AS needs, CASE WHEN length(entry) % 3 = 0 THEN ['of', 'und', 'et', 'y'] END AS never FROM e),
m AS (SELECT t.doc_id, t.at, t.token, needs, never, list_concat(ts[greatest(t.at - 2, 1):t.at], ts[t.at + 2:t.at + 4]) AS near FROM t JOIN r ON r.entry = t.token JOIN w USING (doc_id)),
g AS (SELECT token AS entry, CASE WHEN list_has_any(near, never) THEN 'blocked' WHEN needs IS NOT NULL AND NOT list_has_any(near, needs) THEN 'context' ELSE 'accepted' END AS gate FROM m)
SELECT entry, gate, count(*) AS n FROM g GROUP BY 1, 2""")
def gated_mentions(spark, d):
    entry = lexicon(spark, d)
    size = F.length("entry")
    words = [F.array(*map(F.lit, x)) for x in (("the", "die", "la", "de"), ("of", "und", "et", "y"))]
    none = F.lit(None).cast("int")
    rules = entry.select("entry", F.col("entry").alias("entity"), F.lit(True).alias("whole"), F.when(size % 2 == 0, words[0]).alias("needs"), F.when(size % 3 == 0, words[1]).alias("never"), none.alias("first"), none.alias("last"))
    found = M.gated(M.matches(texts(spark, d), entry, whole=True), rules)
    return found.groupBy("entry", "gate").agg(F.count(F.lit(1)).alias("n"))


def name_pairs(spark, d):
    """Parts that one order has together are said to be the same, if their names begin alike."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.substring("p_name", 1, 2).alias("head")), "l_partkey")
    x, y = (line.select("l_orderkey", "head", F.col("name").alias(n)) for n in "ab")
    return x.join(y, ["l_orderkey", "head"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


@query(167)
def alias_groups(spark, d):
    pairs = name_pairs(spark, d)
    # the same name at two brands whose numbers end alike is no alias
    names = table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("n"), "p_name", F.substring("p_brand", -1, 1).alias("last")).distinct()
    x, y = (names.select("p_name", "last", F.col("n").alias(c)) for c in "ab")
    return M.alias_layer(pairs, x.join(y, ["p_name", "last"]).where("a < b").select("a", "b"))
