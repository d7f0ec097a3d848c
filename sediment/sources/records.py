"""Records in files: JSON lines in date trees, delimited text with a byte order mark, and sets of files written back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (tests on one machine).
LOCAL_SHARED = "file:///tmp/checkpoints/sediment"
#: Rows of a task where tasks sort or hash what they read.
TASK_ROWS = 1 << 18


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session. A session on one machine may
    leave it out; a cluster may not."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = LOCAL_SHARED
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """``df`` written to the shared folder and read again: its work is done once, and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` by the hash of ``by``, in as many parts as give a task about ``TASK_ROWS`` of ``rows`` rows (those it holds or makes), so that
    its memory does not grow with the input."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *by)


def distinct(df: DataFrame, *by: str) -> DataFrame:
    """The distinct rows of ``df``, dealt by ``by``, so that no task holds more than its part of them."""
    some = kept(df, "rows")
    return dealt(some, some.count(), *by).distinct()


def read_json_lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Every line of every file under ``paths``, at any depth. Lines that are no JSON object come as nulls."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(paths)


def write_json_lines(df: DataFrame, path: str, by: list[str]) -> str:
    """One folder a value of ``by`` (the columns stay in the records too); rows are dealt by ``by`` and a salt, so that a large
    value has several files."""
    copies = {f"_{c}": F.col(c) for c in by}
    dealt = df.withColumns(copies).repartition(*[f"_{c}" for c in by], F.pmod(F.xxhash64(*df.columns), F.lit(8)))
    dealt.write.partitionBy(*[f"_{c}" for c in by]).option("ignoreNullFields", "false").json(path)
    return path


def read_delimited(spark: SparkSession, path: str, schema: str, delimiter: str = ",", encoding: str = "UTF-8", several: dict[str, str] | None = None) -> DataFrame:
    """Delimited text with a header; ``several`` names columns whose cells hold many values, with their separators: these become
    arrays of trimmed, non-empty values."""
    df = spark.read.schema(schema).option("header", "true").option("sep", delimiter).option("encoding", encoding).option("quote", '"').option("escape", '"').csv(path)
    for column, separator in (several or {}).items():
        parts = F.transform(F.split(F.col(column), "[" + separator + "]"), lambda x: F.trim(x))
        df = df.withColumn(column, F.filter(parts, lambda x: F.length(x) > 0))
    return df


def write_dataset(df: DataFrame, path: str, kind: str = "parquet") -> DataFrame:
    """Writes ``df`` as ``kind`` (parquet, orc, json, csv) and returns one row: path, kind, rows, columns, digest. The digest is
    the sum of row hashes, the same for the same rows in any order."""
    writer = df.write.option("header", "true") if kind == "csv" else df.write
    writer.format(kind).save(path)
    made = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("digest"))
    return made.select(F.lit(path).alias("path"), F.lit(kind).alias("kind"), "rows", F.lit(",".join(df.columns)).alias("columns"), "digest")
