"""Structured Streaming: windows with watermarks, an event-sourced fold, and runs that end when input ends."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.records import kept, shared_folder


def event_stream(spark: SparkSession, path: str, schema, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A file stream of events with a watermark on ``ts``."""
    return spark.readStream.schema(schema).parquet(path).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(events: DataFrame, ts: str, width: str, by: list[str]) -> DataFrame:
    return events.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sliding(events: DataFrame, ts: str, width: str, step: str, by: list[str]) -> DataFrame:
    return events.groupBy(F.window(ts, width, step).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def finished(stream: DataFrame, mode: str = "append", base: str | None = None) -> DataFrame:
    """Runs a stream over the input that is there now and returns what it wrote. Checkpoint and output lie in the
    shared folder; a run over the same ``base`` goes on where the last one stopped."""
    spark = stream.sparkSession
    base = base or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def updated(stream: DataFrame, by: str, base: str | None = None) -> DataFrame:
    """Runs a stream in update mode over the input that is there now and returns the last row of each key. Every batch is
    written as a folder of its number, so a batch that runs again after a failure overwrites itself; a
    run over the same ``base`` goes on where the last one stopped."""
    spark = stream.sparkSession
    base = base or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    rows = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out")
    last = rows.groupBy(by).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (by, "batch")]), "batch").alias("last"))
    return last.select(by, "last.*")


def folded(events: DataFrame, by: str, columns: list[str], output: str, state: str, step: Callable[[tuple, tuple], tuple], start: tuple) -> DataFrame:
    """State of each key after every micro-batch: ``step(state, row)`` over its events in the order of ``columns``. The state is
    a tuple of the columns of ``state``; a row of ``output`` is the key and the state."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else start
        rows = pd.concat([f[columns] for f in frames]).sort_values(columns)
        for row in rows.itertuples(index=False, name=None):
            now = step(now, row)
        held.update(now)
        yield pd.DataFrame([(*key, *now)], columns=[c.split()[0] for c in output.split(", ")])

    return events.groupBy(by).applyInPandasWithState(fold, output, state, "update", GroupStateTimeout.NoTimeout)


def replayed(events: DataFrame, by: str, order: list[str], kinds: list[str]) -> DataFrame:
    """The same fold in batch for counting folds: (by, one count a kind, last kind)."""
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds]
    return events.groupBy(by).agg(*counts, F.max_by("kind", F.struct(*order)).alias("last_kind"))


def counted(kinds: list[str]) -> tuple[Callable[[tuple, tuple], tuple], tuple]:
    """(step, start) of the counting fold for ``folded`` over columns ts, seq, kind: one count a kind, then the last kind."""

    def step(state: tuple, row: tuple) -> tuple:
        kind = row[2]
        return (*(n + (kind == k) for n, k in zip(state, kinds)), kind)

    return step, (*[0] * len(kinds), "")


def snapshot(events: DataFrame, by: str, order: list[str], kinds: list[str]) -> DataFrame:
    """``replayed`` with ``last_at``, the place of the last event in the order, so that the fold can be carried on."""
    at = events.groupBy(by).agg(F.max(F.struct(*order)).alias("last_at"))
    return replayed(events, by, order, kinds).join(at, by)


def restored(events: DataFrame, held: DataFrame, by: str, order: list[str], kinds: list[str]) -> DataFrame:
    """The counting fold from a ``snapshot`` and the events that came after it was taken; those that are older than its last
    event count, and leave the last kind as it is."""
    later = snapshot(events, by, order, kinds)
    both = held.select(by, *[F.col(k).alias(f"old_{k}") for k in kinds], F.col("last_kind").alias("old_last"), F.col("last_at").alias("old_at")).join(later, by, "full")
    sums = [(F.coalesce(k, F.lit(0)) + F.coalesce(f"old_{k}", F.lit(0))).cast("long").alias(k) for k in kinds]
    last = F.when(F.col("old_at").isNull() | (F.col("last_at") >= F.col("old_at")), F.col("last_kind")).otherwise(F.col("old_last"))
    return both.select(by, *sums, last.alias("last_kind"))


def differing(one: DataFrame, two: DataFrame) -> int:
    """Rows of either table that the other one lacks: 0 if a restored state is the replayed one."""
    return one.exceptAll(two).count() + two.exceptAll(one).count()


def escalated(events: DataFrame, by: str, ts: str, strike: F.Column, memory: str = "1 day", first: int = 3600, most: int = 86400) -> DataFrame:
    """Rows that are strikes with ``strikes`` (those of the key within ``memory`` up to this one) and ``blocked_until``: a block
    of ``first`` seconds that doubles with every further strike, up to ``most``."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    window = Window.partitionBy(by).orderBy("_t").rangeBetween(-_micros(memory), 0)
    hits = events.where(strike).withColumn("_t", seconds)
    counted_ = hits.withColumn("strikes", F.count(F.lit(1)).over(window))
    length = F.least(F.lit(float(most)), first * F.pow(F.lit(2.0), F.col("strikes") - 1))
    return counted_.withColumn("blocked_until", F.timestamp_micros((F.col("_t") + length * 1_000_000).cast("long"))).drop("_t")


def _micros(interval: str) -> int:
    n, unit = interval.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1_000_000


def retracted(derived: DataFrame, withdrawn: DataFrame, child: str, parent: str, depth: int = 60) -> DataFrame:
    """(id, steps): everything that rests, at any remove, on an id of ``withdrawn`` (id), which are there with 0 steps; steps are
    the fewest. From the withdrawn down, a round of joins a step, so the work is that of what falls; an error beyond ``depth``."""
    below = kept(derived.select(F.col(parent).alias("id"), F.col(child).alias("next")).distinct(), "derived")
    front = reached = kept(withdrawn.select("id").distinct().withColumn("steps", F.lit(0)), "retracted")
    for step in range(1, depth + 1):
        new = front.join(below, "id").select(F.col("next").alias("id")).distinct().join(reached, "id", "left_anti")
        front = kept(new.withColumn("steps", F.lit(step)), "retracted")
        if front.isEmpty():
            return reached
        reached = reached.unionByName(front)
    raise RuntimeError(f"what rests on it goes on beyond {depth} steps")


def committed(events: DataFrame, tx: str = "tx") -> DataFrame:
    """Rows of transactions that have their commit marker; a torn tail falls away."""
    return events.join(events.where(F.col("kind") == "commit").select(tx).distinct(), tx, "left_semi")


def forked(events: DataFrame, session: str, at: int, new: str, by: str = "session", seq: str = "seq") -> DataFrame:
    """A new session with the events of ``session`` up to ``at``."""
    return events.where((F.col(by) == session) & (F.col(seq) <= at)).withColumn(by, F.lit(new))
