"""Punctuation in the document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boundaries as B
from ..registry import query, table
from .text import r6


@query(290)
def punctuation_model(spark, d):
    """Fitted on the documents that aren't held out, and scored on those that are."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return B.scored(docs, B.fitted(docs)).select("method", "gaps", "marks", "predicted", "hits", *r6("precision", "recall", "f1"))


@query(290, sql=r"""WITH t AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, regexp_extract_all(x, '[a-z0-9\x{80}-\x{10ffff}]+') AS ws, regexp_extract_all(regexp_replace(regexp_replace(x, '^[^a-z0-9\x{80}-\x{10ffff}]+', ''), '[^a-z0-9\x{80}-\x{10ffff}]+$', ''), '[^a-z0-9\x{80}-\x{10ffff}]+') AS gs FROM t)
SELECT doc_id, len(gs) AS gaps, len(list_filter(gs, lambda g: regexp_matches(g, '[.,;:!?]'))) AS marks FROM s WHERE len(ws) > 1""")
def marks_between_words(spark, d):
    """What the model learns from: gaps between words, and those with a mark."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("x"))
    between = F.regexp_extract_all(F.regexp_replace(F.regexp_replace("x", r"^[^a-z0-9\u0080-\x{10ffff}]+", ""), r"[^a-z0-9\u0080-\x{10ffff}]+$", ""), F.lit(r"([^a-z0-9\u0080-\x{10ffff}]+)"), F.lit(1))
    found = docs.select("doc_id", F.size(F.regexp_extract_all("x", F.lit(r"([a-z0-9\u0080-\x{10ffff}]+)"), F.lit(1))).alias("n"), between.alias("g")).where("n > 1")
    return found.select("doc_id", F.size("g").cast("long").alias("gaps"), F.size(F.filter("g", lambda g: g.rlike("[.,;:!?]"))).cast("long").alias("marks"))
