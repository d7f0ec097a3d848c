"""What every operator here needs: the shared folder, written tables, exact ranks, components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and has no machine but this one (tests).
LOCAL_SHARED = "file:///tmp/checkpoints/sediment"
#: Rows of a table that may be broadcast (a few numbers each).
SMALL = 200_000
_SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session. A session on one machine
    may leave it out; a cluster may not."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = LOCAL_SHARED
    return found.rstrip("/")


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, lengthened until none of them is (but for case) among ``columns``."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named(columns: list[str]) -> list[F.Column]:
    """Columns of any names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ...: mapInArrow can't read all names (dots); ``toDF`` gives the old ones back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; when its task ends, the worker gives free memory back to the machine, as Spark keeps
    idle workers."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return runs


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df`` (a written table) marked for broadcast if it has no more than ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table", by: list[str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage ends here and every later
    use reads the files, also after executors are lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of tables made by ``written`` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/" in folder and folder.startswith(("file:", "hdfs:", "s3", "gs:", "abfs", "viewfs")):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, key: str, to: str) -> DataFrame:
    """``df`` with ``to``: 0, 1, ... among rows that share the long hash ``key`` (rows that share it are taken to be
    equal, so which one gets which number is the same to all). Keys that occur once cost one count;
    rows of the others are written, salted, and numbered inside a salt after the salts before it."""
    salt, salt2, n, before, key2 = fresh([*df.columns, to], "_salt", "_salt2", "_n", "_before", "_key2")
    many = written(df.groupBy(F.col(key).alias(key2)).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1).select(key2), "repeated")
    if many.isEmpty():
        discard(many)
        return df.withColumn(to, F.lit(0).cast("long"))
    some = small(many)
    rows = written(df.join(some, df[key] == some[key2], "left_semi").withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS))), "repeated")
    sums = rows.groupBy(F.col(key).alias(key2), F.col(salt).alias(salt2)).agg(F.count(F.lit(1)).alias(n))
    ahead = Window.partitionBy(key2).orderBy(salt2).rowsBetween(Window.unboundedPreceding, -1)
    sums = written(sums.select(key2, salt2, F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(before)), "salts")
    inside = rows.withColumn(to, F.row_number().over(Window.partitionBy(key, salt).orderBy(F.lit(0))) - 1)
    ranked = inside.join(sums, (F.col(key) == F.col(key2)) & (F.col(salt) == F.col(salt2))).withColumn(to, (F.col(to) + F.col(before)).cast("long"))
    once = df.join(some, df[key] == some[key2], "left_anti").withColumn(to, F.lit(0).cast("long"))
    return once.unionByName(ranked.select(*named(once.columns)))


def with_rank(df: DataFrame, keys: list[str], order: str, to: str, ties: list[str] | None = None) -> DataFrame:
    """Gapless rank from 0 within ``keys`` by the long hash column ``order`` (then ``ties``).

    No group meets in one task: the hash is cut into ranges, ranges are counted (partial sums), and
    rows are numbered within a range of a group and moved up by the ranges before it. Equal hashes meet in
    one range, so ``order`` should tell rows apart.
    """
    n = max(8, partitions(df.sparkSession))
    at = F.shiftright((F.shiftright(order, 32) + F.lit(1 << 31).cast("long")) * F.lit(n).cast("long"), 32).cast("int")
    cut = df.withColumn("_cut", at)
    sums = cut.groupBy(*keys, "_cut").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_cut").orderBy(order, *(ties or []))
    ranked = cut.withColumn("_at", F.row_number().over(inside) - 1)
    cond = [ranked[k].eqNullSafe(sums[k]) for k in [*keys, "_cut"]]
    both = ranked.join(sums, cond)
    return both.select(*[ranked[c] for c in df.columns], (F.col("_at") + F.col("_before")).cast("long").alias(to))


def components(edges: DataFrame, src: str = "a", dst: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over ``edges``, for every id with an edge.

    Every round takes the smallest label among neighbours (aggregated before the shuffle) and then
    jumps to the label's own label, so long chains shorten by halves. Each round is a written table.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    both = written(pairs.union(pairs.select("v", "u")).distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("id")).agg(F.least(F.first("u"), F.min("v")).alias("component")), "labels")
    for _ in range(rounds):
        told = both.join(labels, both.v == labels.id).groupBy("u").agg(F.min("component").alias("near"))
        nearer = labels.join(told, labels.id == told.u, "left").select("id", F.least("component", F.coalesce("near", "component")).alias("near"), F.col("component").alias("old"))
        up = labels.select(F.col("id").alias("_up"), F.col("component").alias("_far"))
        moved = nearer.join(up, nearer.near == up._up, "left").select("id", F.least("near", F.coalesce("_far", "near")).alias("component"), "old")
        moved = written(moved, "labels")
        changed = moved.where("component <> old").limit(1).count()
        discard(labels)
        labels = moved.select("id", "component")
        if not changed:
            discard(both)
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
