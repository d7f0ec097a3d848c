"""A training corpus from raw documents, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sediment.llm import packing, quality
from sediment.llm.decontamination import decontaminated
from sediment.llm.jaccard import one_of_each
from sediment.llm.mixing import mixed
from sediment.llm.shared import discard, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and wordless texts go; long texts are read whole; each
    repeated row is judged alike; no rows give none; extra columns stay as they are, whatever their names."""
    return quality.passing(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the smallest doc_id, with all rows
    that repeat it. Null and empty texts and null ids are no duplicates and stay; no rows give none; extra
    columns stay as they are."""
    return one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none and stay; repeated rows are judged alike;
    an empty table or benchmark takes nothing away; extra columns stay as they are."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Null and wordless texts are taken never; null is a source; repeated
    rows are mixed like others; no rows give none; extra columns stay as they are."""
    return mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: one row a document taken (repeats too; null and empty texts have the end id
    alone; no rows give none). Only doc_id and text are read."""
    return packing.read_token_files(packing.write_token_files(docs))


STAGES = [("quality rules", keep_quality), ("n-gram Jaccard join", one_of_each_group), ("benchmark decontamination", without_benchmark), ("mixing", mix), ("token files", token_files)]

#: Newton steps, similarity trees and binary files have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage returns is written and read again, as each reads its input more than once, and
    deleted when the last stage has written its files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    between = []
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
        between.append(docs)
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(*between)
    return out
