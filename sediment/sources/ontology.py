"""Ontologies in the plain stanza format, read as one row a term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _all(tag: str, value: str) -> Column:
    return F.regexp_extract_all("value", F.lit(rf"(?m)^{tag}: {value}"), F.lit(1))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, parents, synonyms, alt_ids) of the terms in one or many files. Files are split at stanzas, so large ones
    are read by many tasks; stanzas of other kinds and terms marked obsolete are left out."""
    stanzas = spark.read.option("lineSep", "\n[").text(path)
    terms = stanzas.where(F.col("value").rlike(r"^\[?Term\]") & ~F.col("value").rlike(r"(?m)^is_obsolete: true"))
    return terms.select(
        F.regexp_extract("value", r"(?m)^id: (\S+)", 1).alias("id"),
        F.regexp_extract("value", r"(?m)^name: (.+?)\s*$", 1).alias("name"),
        _all("is_a", r"(\S+)").alias("parents"),
        _all("synonym", r'"([^"]*)"').alias("synonyms"),
        _all("alt_id", r"(\S+)").alias("alt_ids"),
    )
