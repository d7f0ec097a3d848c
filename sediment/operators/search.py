"""Search over documents: postings, BM25, phrase and proximity search, rank fusion, dense retrieval, quotation checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.records import kept
from .matching import holding


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, token, tf)."""
    return docs.select(key, F.explode(T.words(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def bm25(docs: DataFrame, query: list[str], key: str = "doc_id", text: str = "text", k1: float = 1.4, b: float = 0.75) -> DataFrame:
    """(key, score). A query token that occurs twice counts twice. Only the query's postings are joined; lengths and their mean
    come from the same scan."""
    tokens = T.words(F.col(text))
    counted = docs.select(key, tokens.alias("ts")).select(key, F.size("ts").alias("dl"), "ts")
    stats = counted.agg(F.count(F.lit(1)).alias("N"), F.avg("dl").alias("mean"))
    asked = docs.sparkSession.createDataFrame([(t, float(query.count(t))) for t in sorted(set(query))], "token string, times double")
    wanted = F.filter("ts", lambda t: t.isin(*query))
    tf = counted.select(key, "dl", F.explode(wanted).alias("token")).groupBy(key, "dl", "token").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rows = tf.join(df, "token").join(asked, "token").crossJoin(stats)
    idf = F.ln(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("mean")))
    return rows.groupBy(key).agg(F.sum(part).alias("score"))


def ranked(scores: DataFrame, k: int, key: str = "doc_id", score: str = "score") -> DataFrame:
    """The ``k`` best with their ranks, ties by key; the rank runs over k rows."""
    best = scores.orderBy(F.desc(F.round(score, 9)), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round(score, 9)), key)))


def containing(docs: DataFrame, phrases: list[str], every: bool = True, text: str = "text") -> DataFrame:
    low = T.lower(F.col(text))
    keep = F.lit(every)
    for p in phrases:
        keep = (keep & low.contains(p)) if every else (keep | low.contains(p))
    return docs.where(keep)


def near(docs: DataFrame, left: str, right: str, distance: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pairs): documents where two words stand within ``distance`` words, and how many pairs do. Positions of the two
    words are sorted once and counted in a range window, so no pair is made."""
    low = T.lower(F.col(text))
    at = docs.where(low.contains(left) & low.contains(right)).select(key, F.posexplode(T.words(F.col(text))).alias("pos", "token")).where(F.col("token").isin(left, right))
    around = Window.partitionBy(key).orderBy("pos").rangeBetween(-distance, distance)
    counted = at.withColumn("n", F.count(F.when(F.col("token") == right, 1)).over(around)).where((F.col("token") == left) & (F.col("n") > 0))
    return counted.groupBy(key).agg(F.sum("n").alias("pairs"))


def fused(routes: list[tuple[DataFrame, float]], key: str = "doc_id", constant: int = 60) -> DataFrame:
    """(key, score): reciprocal-rank fusion of routes (key, rank) with weights."""
    parts = [r.select(key, (F.lit(w) / (constant + F.col("rank"))).alias("s")) for r, w in routes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.sum("s").alias("score"))


def interleaved(main: DataFrame, side: DataFrame, k: int, num: int = 3, den: int = 10) -> DataFrame:
    """(place, key): the side queue takes the places where floor(num * place / den) steps up. Both have (key, rank)."""
    side = side.withColumn("place", F.ceil(F.col("rank") * den / num)).where(F.col("place") <= k)
    taken = F.floor((F.col("rank") - 1) * F.lit(num) / (den - num))
    main = main.withColumn("place", F.col("rank") + taken)
    return main.select("place", *[c for c in main.columns if c not in ("rank", "place")], F.lit("main").alias("queue")).unionByName(side.select("place", *[c for c in side.columns if c not in ("rank", "place")], F.lit("side").alias("queue"))).where(F.col("place") <= k)


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, floor: float = 0.05, key: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """(query, key, similarity, rank): exact cosine of each query with every vector but itself.

    Both sides are dealt into blocks of about ``block`` rows by hash; every pair of blocks meets once, as two matrices,
    and keeps the ``k`` best of each query, so a task holds two blocks and only k rows a query and block are shuffled on.
    """
    some = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows, columns = max(1, -(-some.count() // block)), max(1, -(-asked.count() // block))

    def dealt(df: DataFrame, own: int, other: int, names: tuple[str, str]) -> DataFrame:
        return df.withColumn(names[0], F.pmod(F.xxhash64("id"), F.lit(own)).cast("int")).withColumn(names[1], F.explode(F.sequence(F.lit(0), F.lit(other - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            (ids, held), (queries_, wanted) = _matrix(left), _matrix(right)
            similarity = wanted @ held.T
            similarity[queries_[:, None] == ids[None, :]] = -2
            for i, row in enumerate(similarity):
                at = np.flatnonzero(row > floor)
                if len(at) > k:
                    least = np.partition(np.round(row[at], 9), -k)[-k]
                    at = at[np.round(row[at], 9) >= least]  # ties with the last stay, and the window decides
                out[0] += [queries_[i]] * len(at)
                out[1] += ids[at].tolist()
                out[2] += row[at].tolist()
        return pa.table({"query": pa.array(out[0], pa.int64()), key: pa.array(out[1], pa.int64()), "similarity": pa.array(out[2], pa.float64())})

    left, right = dealt(some, rows, columns, ("a", "b")).groupBy("a", "b"), dealt(asked, columns, rows, ("b", "a")).groupBy("a", "b")
    scored = left.cogroup(right).applyInArrow(meet, f"query long, {key} long, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of length one (zero vectors stay zero)."""
    v = np.stack([np.asarray(x, float) for x in table["v"].to_pylist()])
    return table["id"].to_numpy(), v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)


def quote_levels(docs: DataFrame, quotes: DataFrame, quote_key: str = "item_id", key: str = "doc_id") -> DataFrame:
    """(quote, key, level) of quotes whose words stand in a text one after another: verbatim, normalised (lower case,
    single spaces) or plain (the words alone). One automaton of all quotes' words goes over the words of each text
    once; only texts that hold a quote are looked at as they are written. Quotes without words are in no text."""

    def normal(x: Column) -> Column:
        return F.trim(F.regexp_replace(T.lower(x), r"[\x20\x09-\x0D]+", " "))

    def plain(x: Column) -> Column:
        return F.concat(F.lit(" "), F.concat_ws(" ", T.words(x)), F.lit(" "))

    asked = kept(quotes.select(quote_key, F.col("text").alias("quote"), plain(F.col("text")).alias("entry")).where("length(entry) > 2").distinct(), "quotes")
    found = kept(holding(docs.select(F.col(key).alias("doc_id"), plain(F.col("text")).alias("text")), asked.select("entry")), "found")
    pairs = found.withColumnRenamed("doc_id", key).join(asked, "entry").select(quote_key, key, "quote").distinct().join(docs.select(key, "text"), key)
    level = F.when(F.col("text").contains(F.col("quote")), "verbatim").when(normal(F.col("text")).contains(normal(F.col("quote"))), "normalised").otherwise("plain")
    return pairs.select(quote_key, key, level.alias("level"))
