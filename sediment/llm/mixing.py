"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, fresh, named, numbered, small, with_rank, written

#: A word of the size measure.
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """(source, source_size, target, capped) for ``sizes`` (source, size, and n: rows of that size).

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all sizes; no
    target exceeds ``most`` times its source's size, and the excess is shared again by weight. The loop
    aggregates the table of sources (a row a source, numbered in one window) and keeps two numbers on the
    driver. An empty table gives no rows; a source without words has target 0.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    per = written(per.withColumn("weight", weight), "sources")
    cap = F.lit(float(most)) * F.col("source_size")
    share = None
    while True:
        free = F.lit(True) if share is None else F.lit(share) * F.col("weight") <= cap
        left, weigh, total = per.agg(F.sum(F.when(free, 0.0).otherwise(cap)), F.sum(F.when(free, F.col("weight")).otherwise(0.0)), F.sum("source_size")).first()
        if not total or not weigh:
            share = share or 0.0
            break
        new = (total - left) / weigh
        if share is not None and abs(new - share) <= 1e-12 * new:
            break
        share = new
    target = F.least(F.lit(share) * F.col("weight"), cap)
    out = written(per.select("source", "source_size", target.alias("target"), (F.lit(share) * F.col("weight") >= cap).alias("capped")), "targets")
    discard(per)
    return out


def _rate(tilt: str, most: int) -> F.Column:
    lean = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -F.col(tilt) * F.col("size") / F.col("mean")))
    return F.lit(float(most)) / (1 + (most - 1) * F.exp(lean))


def tilts(bins: DataFrame, targets: DataFrame, most: int, rounds: int = 60) -> DataFrame:
    """(source, source_size, target, capped, mean, tilt): Newton steps on the dual of all sources at once, one
    aggregation of ``bins`` (source, size, n) a step. A bracket keeps a step inside the interval of the root."""
    counts = bins.groupBy(F.col("source").alias("_s")).agg(F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("docs"))
    mean = F.when(F.col("docs") > 0, F.col("source_size") / F.col("docs"))
    state = targets.join(counts, targets.source.eqNullSafe(counts._s)).select("source", "source_size", "target", "capped", mean.alias("mean"), F.lit(0.0).alias("tilt"), F.lit(-700.0).alias("low"), F.lit(700.0).alias("high"), (F.col("capped") | (F.col("source_size") == 0)).alias("done"))
    state = written(state, "tilt")
    rate = _rate("tilt", most)
    for _ in range(rounds):
        now = small(state.where("not done").withColumnRenamed("source", "_s"))
        slope = rate * (1 - rate / most) * F.col("size") / F.col("mean")
        words = F.col("size") * F.col("n")
        sums = bins.join(now, bins.source.eqNullSafe(F.col("_s"))).groupBy("_s").agg(F.sum(words * rate).alias("got"), F.sum(words * slope).alias("slope"))
        both = state.join(sums, state.source.eqNullSafe(sums._s), "left")
        over = F.col("got") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("tilt")), F.when(over, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - (F.col("got") - F.col("target")) / F.greatest("slope", F.lit(1e-300))
        inside = F.when((step > low) & (step < high), step).otherwise((low + high) / 2)
        near = F.col("got").isNull() | (F.abs(F.col("got") - F.col("target")) <= 1e-7 * F.greatest("target", F.lit(1.0)))
        moved = both.select("source", "source_size", "target", "capped", "mean", F.when(near, F.col("tilt")).otherwise(inside).alias("tilt"), F.when(near, F.col("low")).otherwise(low).alias("low"), F.when(near, F.col("high")).otherwise(high).alias("high"), near.alias("done"))
        moved = written(moved, "tilt")
        discard(state)
        state = moved
        if state.where("not done").isEmpty():
            break
    return state


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole copies for bins (source, size, n, rate, ...) that come by source, the largest size first: ``extra`` of a
    bin's rows get one copy more than ``whole``, so that words taken so far stay nearest to what rates ask for."""
    last, owed = object(), 0.0
    for batch in batches:
        sources, sizes, counts, rates = (batch.column(i).to_pylist() for i in range(4))
        whole, extra = [], []
        for source, size, n, rate in zip(sources, sizes, counts, rates):
            if source != last:
                last, owed = source, 0.0
            down = int(rate)
            owed += size * n * (rate - down)
            more = min(n, max(0, int(np.floor(owed / size + 0.5)))) if size and rate > down else 0
            owed -= size * more
            whole.append(down)
            extra.append(more)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(whole, pa.int64()), pa.array(extra, pa.int64())], names=[*batch.schema.names, "whole", "extra"])


def _plan(rows: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """(source, size, source_size, target, rate, whole, below) for every source and size of ``rows`` (source, size, _u):
    rows with ``_u`` under ``below`` (none if null) are taken whole + 1 times."""
    bins = written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "bins")
    targets = source_targets(bins, weights, most)
    state = tilts(bins, targets, most)
    exact = F.when(F.col("size") == 0, 0.0).when(F.col("capped"), F.lit(float(most))).otherwise(F.round(F.least(_rate("tilt", most), F.lit(float(most))), 9))
    rounded = state.withColumn("tilt", F.round("tilt", 9)).withColumnRenamed("source", "_s")
    rated = bins.join(small(rounded), bins.source.eqNullSafe(F.col("_s"))).select("source", "size", "n", exact.alias("rate"), "source_size", "target")
    # a source's sizes pass through one task in order, streamed; there are no more of them than words in its longest text
    ordered = rated.repartition("source").sortWithinPartitions("source", F.desc("size"))
    dealt = written(ordered.mapInArrow(_dealt, "source string, size long, n long, rate double, source_size long, target double, whole long, extra long"), "dealt")
    open_ = dealt.where("extra > 0 and extra < n").select(F.col("source").alias("_s"), F.col("size").alias("_z"), "extra")
    some = rows.join(small(written(open_, "open")), rows.source.eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).select("source", "size", "_u", "extra")
    edge = with_rank(some, ["source", "size"], "_u", "_r").where("_r = extra").select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_u").alias("_edge"))
    edge = written(edge, "edges")
    both = dealt.join(edge, dealt.source.eqNullSafe(edge._s) & (dealt["size"] == edge._z), "left")
    below = F.when(F.col("extra") == F.col("n"), F.lit((1 << 63) - 1)).otherwise(F.col("_edge"))
    plan = written(both.select("source", "size", "source_size", "target", "rate", "whole", below.alias("below")), "plan")
    discard(bins, targets, state, dealt, edge)
    return plan


def _copies(most: int, whole: str = "whole", below: str = "below", u: str = "_u") -> F.Column:
    return F.least(F.col(whole) + F.when(F.col(u) < F.col(below), 1).otherwise(0), F.lit(most)).cast("long")


def _size() -> F.Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: int = 3, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Copies of every document so that sources meet target token counts.

    ``docs`` has ``keys``, ``source`` and ``text``. Returns keys, source, size, source_size, target, rate, copies,
    taken (= copies * size).

    Entropy balancing with rates between 0 and ``most``: of all rates that meet the constraint
    sum(rate * size) = target in a source, those nearest in entropy to rate 1 are
    most / (1 + (most - 1) * exp(-lambda * size / mean size)). The dual in lambda is convex; Newton steps
    for all sources run together on the table of (source, size, rows), a step an aggregation. Rates become
    whole copies size by size, the largest first: the part of a size's rows (by hash) that gets one copy more
    is the one that keeps the words taken nearest to what the rates ask for, so a source misses its target by
    about half its shortest document.

    Null text has size 0 and is taken 0 times; sources may be null; repeated rows count each and are told apart
    by number, so they need not move together; an empty table gives an empty result. A source at its cap is
    taken ``most`` times whole. Other columns are not read. The result reads two tables in the shared folder;
    all others are deleted.
    """
    rows = docs.select(*keys, F.col("source").cast("string").alias("source"), _size().alias("size"), F.xxhash64(*keys, "source", "text").alias("_h"))
    rows = written(rows, "sizes")
    rows = numbered(rows, "_h", "_nth").withColumn("_u", F.xxhash64("_h", "_nth"))
    plan = _plan(rows, weights, most).withColumnsRenamed({"source": "_s", "size": "_z"})
    out = rows.join(small(plan), rows.source.eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).withColumn("copies", _copies(most))
    return out.select(*keys, "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: int = 3) -> DataFrame:
    """The mix itself: rows of ``docs`` (doc_id, source, text and any other columns, which keep names and values), each
    as often as it is taken.

    Copies follow from a row's source, size and hash by one small table, so texts are mapped and not shuffled (only
    repeated rows are, to be numbered). Null texts and texts without words are taken never; null sources are a
    source; repeated rows are mixed like others; an empty table gives no rows.
    """
    columns = docs.columns
    h, size, nth, u, source, s, z, whole, below, times = fresh(columns, "_h", "_size", "_nth", "_u", "_source", "_s", "_z", "_whole", "_below", "_times")
    rows = docs.withColumns({source: F.col("source").cast("string"), size: _size(), h: F.xxhash64("doc_id", "source", "text")})
    light = written(rows.select(F.col(source).alias("source"), F.col(size).alias("size"), F.col(h).alias("_h")), "sizes")
    plan = _plan(numbered(light, "_h", "_nth").withColumn("_u", F.xxhash64("_h", "_nth")), weights, most)
    plan = plan.where("whole > 0 or below is not null").select(F.col("source").alias(s), F.col("size").alias(z), F.col("whole").alias(whole), F.col("below").alias(below))
    rows = numbered(rows, h, nth).withColumn(u, F.xxhash64(h, nth))
    both = rows.join(small(plan), F.col(source).eqNullSafe(F.col(s)) & (F.col(size) == F.col(z)))
    discard(light)
    return both.withColumn(times, F.explode(F.sequence(F.lit(1), _copies(most, whole, below, u)))).where(F.col(times) > 0).select(*named(columns))


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")
