"""A collection kept as Parquet: works, their passages and postings, in buckets by work, changed by overwriting whole buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .records import kept

BUCKETS = 16


def bucket(work: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(work), F.lit(buckets)).cast("int")


class Store:
    """Tables ``works`` (work, ...), ``passages`` (work, seq, text) and ``postings`` (work, token, n) under ``path``.

    A change reads the buckets it touches, works out their new content and overwrites just them, so its cost is that
    of the works it is about. Each table is written to a new folder beside the old one first and then put in its
    place, as a job can't overwrite what it reads. A change that fails half-way is done again with the same result:
    every step is the whole new content of its buckets. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, works: str, passages: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.schemas = {"works": works, "passages": passages, "postings": "work string, token string, n long"}

    def read(self, name: str) -> DataFrame:
        schema = f"{self.schemas[name]}, bucket int"
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _exists(self, name: str) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def _put(self, name: str, rows: DataFrame, touched: list[int]) -> None:
        """Overwrites ``touched`` buckets of a table by ``rows``; those that end up without rows are emptied."""
        fresh = f"{self.path}/_next-{name}"
        rows.write.mode("overwrite").parquet(fresh)
        new = self.spark.read.schema(rows.schema).parquet(fresh)
        held = {r[0] for r in new.select("bucket").distinct().collect()}  # bucket numbers
        new.repartition("bucket", F.pmod(F.xxhash64(*new.columns), F.lit(4))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")
        files = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for b in set(touched) - held:
            place = files.Path(f"{self.path}/{name}/bucket={b}")
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    def _changed(self, name: str, gone: DataFrame, added: DataFrame | None, touched: list[int]) -> None:
        kept = self.read(name).where(F.col("bucket").isin(touched)).join(gone, "work", "left_anti")
        self._put(name, kept if added is None else kept.select(*added.columns).unionByName(added), touched)

    def _touched(self, works: DataFrame) -> list[int]:
        return sorted(r[0] for r in works.select(bucket(F.col("work"), self.buckets).alias("b")).distinct().collect())  # bucket numbers

    def index(self, passages: DataFrame) -> DataFrame:
        """Postings of passages: (work, token, n)."""
        return passages.select("work", F.explode(T.words(F.col("text"))).alias("token")).groupBy("work", "token").agg(F.count(F.lit(1)).alias("n"))

    def upsert(self, works: DataFrame, passages: DataFrame) -> None:
        """Puts works in, with their passages and postings, in place of works of the same name."""
        touched = self._touched(works)
        if not touched:
            return
        gone, at = works.select("work").distinct(), bucket(F.col("work"), self.buckets)
        own = passages.join(gone, "work", "left_semi")
        self._changed("postings", gone, self.index(own).withColumn("bucket", at), touched)
        self._changed("passages", gone, own.withColumn("bucket", at), touched)
        self._changed("works", gone, works.withColumn("bucket", at), touched)

    def append(self, passages: DataFrame) -> None:
        """Adds passages to works that are there, in place of passages of the same work and seq, and their words to the postings;
        passages of unknown works are left out, of several with one work and seq one stays. Passages are put in first,
        and the postings of the works at hand are made anew from them, so an append that failed at any step can be repeated."""
        known = passages.join(self.read("works").select("work"), "work", "left_semi").dropDuplicates(["work", "seq"])
        known = kept(known, "append")  # one choice among repeats, whatever runs again
        touched = self._touched(known)
        if not touched:
            return
        at = bucket(F.col("work"), self.buckets)
        old = self.read("passages").where(F.col("bucket").isin(touched))
        own = known.select("work", "seq")
        left = old.join(own, (old["work"] == own["work"]) & old["seq"].eqNullSafe(own["seq"]), "left_anti")
        self._put("passages", left.unionByName(known.withColumn("bucket", at).select(*left.columns)), touched)
        works = known.select("work").distinct()
        new = self.read("passages").where(F.col("bucket").isin(touched)).join(works, "work", "left_semi")
        self._changed("postings", works, self.index(new).withColumn("bucket", at), touched)

    def delete(self, works: DataFrame) -> None:
        """Takes works out, with their passages and postings."""
        touched = self._touched(works)
        for name in ("postings", "passages", "works") if touched else ():
            self._changed(name, works.select("work").distinct(), None, touched)

    def reindex(self) -> None:
        """Postings anew from all passages."""
        every = list(range(self.buckets))
        self._put("postings", self.index(self.read("passages")).withColumn("bucket", bucket(F.col("work"), self.buckets)), every)


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): JSON lines of a graph, a node {"id", "label"} or an edge {"from", "to", "weight"} each."""
    return nodes.select(F.to_json(F.struct("id", "label")).alias("line")).unionByName(edges.select(F.to_json(F.struct("from", "to", "weight")).alias("line")))


def features(rows: DataFrame, x: str, y: str, properties: list[str]) -> DataFrame:
    """(line): a GeoJSON point feature each."""
    point = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))).alias("line"))


def ledger_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line): rows as CSV, every field quoted and quotes doubled."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    return rows.select(F.concat_ws(",", *quoted).alias("line"))


def chunks(rows: DataFrame, key: str, size: int, columns: list[str]) -> DataFrame:
    """(chunk, n, digest): rows in chunks of ``size`` consecutive whole numbers of ``key``, each with the digest of its lines in
    order. A chunk is what one task holds."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    held = rows.groupBy(F.floor(F.col(key) / size).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct(key, line.alias("line")))).alias("l"))
    return held.select("chunk", F.size("l").cast("long").alias("n"), F.md5(F.array_join(F.transform("l", lambda x: x["line"]), "\n").cast("binary")).alias("digest"))


def read_text_sets(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(file, seq, heading, text) of a folder of texts. ``tab``: lines of heading, tab, text; ``markdown``: paragraphs under the
    last heading (# to ######). Files are read whole, as headings reach down over lines."""
    if kind not in ("tab", "markdown"):
        raise ValueError("tab or markdown")
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    if kind == "tab":
        lines = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("seq", "line")).where(F.length("line") > 0)
        return lines.select("file", F.col("seq").cast("long").alias("seq"), F.substring_index("line", "\t", 1).alias("heading"), F.expr("substr(line, instr(line, '\t') + 1)").alias("text"))
    w = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    title = F.when(F.col("line").rlike("^#{1,6} "), F.trim(F.regexp_replace("line", "^#+ ", "")))
    parts = lines.withColumn("title", title).withColumn("heading", F.coalesce(F.last("title", ignorenulls=True).over(w), F.lit("")))
    parts = parts.withColumn("seq", F.sum(F.when(F.col("title").isNotNull() | (F.trim("line") == ""), 1).otherwise(0)).over(w)).where(F.col("title").isNull() & (F.trim("line") != ""))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.trim("line").alias("line")))), lambda x: x["line"]), " ")
    return parts.groupBy("file", "seq", "heading").agg(text.alias("text")).select("file", F.col("seq").cast("long").alias("seq"), "heading", "text")
