"""Groups of vectors by direction, and whether a grouping says more than shuffled columns do."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.records import kept

#: Numbers in the centres of all restarts or shuffles together; they go to every task and back to the driver each round.
CENTRES = 2_000_000


def _rows(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(), float).reshape(len(column), -1)


def _summed(points: DataFrame, centres: np.ndarray, cosine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, numbers, gains) of the points nearest to each centre, for every run at once: one pass and one aggregation.
    ``points``: run (null: of every run), vector; ``centres``: run x k x width. Gains are similarities, or squared distances."""
    runs, k, width = centres.shape

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, numbers, gains = np.zeros((runs, k, width)), np.zeros((runs, k)), np.zeros((runs, k))
        for batch in batches:
            run, x = batch.column(0).to_numpy(zero_copy_only=False), _rows(batch.column(1))
            for r in range(runs):
                own = x[np.isnan(run.astype(float)) | (run == r)]
                if not len(own):
                    continue
                near, gain = _nearest(own, centres[r], cosine)
                np.add.at(sums[r], near, own)
                numbers[r] += np.bincount(near, minlength=k)
                gains[r] += np.bincount(near, gain, k)
        flat = np.concatenate([sums, numbers[..., None], gains[..., None]], axis=2).reshape(-1)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "amount"])

    found = points.select("run", "vector").mapInArrow(nearest, "at long, amount double").groupBy("at").agg(F.sum("amount").alias("amount")).toArrow()
    flat = np.zeros(runs * k * (width + 2))
    flat[found["at"].to_numpy()] = np.round(found["amount"].to_numpy(), 9)  # whatever the order of partial sums
    flat = flat.reshape(runs, k, width + 2)
    return flat[..., :width], flat[..., width], flat[..., width + 1]


def _nearest(x: np.ndarray, centres: np.ndarray, cosine: bool) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of every row (of equally near ones the first), and its similarity or squared distance."""
    if cosine:
        like = np.round(x @ centres.T, 9)
        near = like.argmax(axis=1)
        return near, like[np.arange(len(x)), near]
    far = np.round((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None], 9)
    near = far.argmin(axis=1)
    return near, np.maximum(0.0, far[np.arange(len(x)), near])


def spherical_kmeans(vectors: DataFrame, k: int, restarts: int = 5, rounds: int = 50, least: int = 1, seed: int = 7) -> DataFrame:
    """(id, cluster, similarity): k groups of vectors by cosine. ``vectors``: id, vector (array of numbers, all of one length).

    Every restart begins with ``k`` vectors (equal ones once) that come first in a hash order of its own; all restarts take a step
    together, in one pass and one aggregation, until no centre moves or after ``rounds``. The restart with the highest sum
    of similarities is taken. Groups of fewer than ``least`` vectors are dropped (but not all), and their vectors go to
    the nearest group left. Groups are numbered by size, the largest 0 (equal ones by first centre). Null vectors, vectors
    with a null or not a number, and those of length 0 have no direction: cluster null. Repeated ids stay rows of their own.
    What the driver holds is centres: restarts x k x width numbers."""
    direction = F.col("vector").cast("array<double>")
    square = F.aggregate(direction, F.lit(0.0), lambda s, v: s + v * v)
    unit = F.when((square > 0) & (square < float("inf")), F.transform(direction, lambda v: v / F.sqrt(square)))
    base = kept(vectors.select("id", unit.alias("vector")), "directions")
    some = base.where("vector is not null")
    starts = []
    for r in range(restarts):
        first = some.groupBy("vector").agg(F.min(F.xxhash64("vector", F.lit(seed), F.lit(r))).alias("h")).orderBy("h").limit(k).toArrow()
        starts.append(_rows(first["vector"].combine_chunks()) if first.num_rows else np.zeros((0, 0)))
    if not starts or not len(starts[0]):
        return base.select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("similarity"))
    centres = np.stack(starts)
    if centres.size > CENTRES:
        raise ValueError(f"{centres.size} numbers in centres; {CENTRES} at most")
    points = some.select(F.lit(None).cast("int").alias("run"), "vector")
    for _ in range(rounds):
        sums, numbers, gains = _summed(points, centres, True)
        length = np.sqrt((sums**2).sum(-1, keepdims=True))
        new = np.where(length > 1e-12, np.round(sums / np.maximum(length, 1e-12), 9), centres)
        if np.array_equal(new, centres):
            break
        centres = new
    sums, numbers, gains = _summed(points, centres, True)
    best = int(np.round(gains.sum(1), 6).argmax())
    size = numbers[best]
    keep = np.flatnonzero(size >= least)
    keep = keep if len(keep) else np.array([int(size.argmax())])
    keep = keep[np.argsort(-size[keep], kind="stable")]
    final = centres[best][keep]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False))
            cluster, like = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            if len(known):
                cluster[known], like[known] = _nearest(_rows(batch.column(1).take(pa.array(known))), final, True)
            none = cluster < 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32), mask=none), pa.array(like, mask=none)], names=["id", "cluster", "similarity"])

    return base.mapInArrow(assign, f"id {dict(base.dtypes)['id']}, cluster int, similarity double")


def indexed(rows: DataFrame, order: list[str], to: str) -> DataFrame:
    """``rows`` with a gapless long number from 0 by ``order``: ranges of the order are dealt to tasks, counted, and numbered
    behind the ranges before them, so no task holds all rows. ``rows`` should be a written table, and ``order`` tell rows apart."""
    dealt = kept(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).collect()  # a row a partition
    before, starts = 0, []
    for r in sorted(counts, key=lambda r: r["_part"]):
        starts.append((r["_part"], before))
        before += r["_n"]
    known = rows.sparkSession.createDataFrame(starts, "_part int, _before long")
    from pyspark.sql import Window

    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_at", inside).join(F.broadcast(known), "_part").withColumn(to, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def shuffled(units: DataFrame, shuffles: int, seed: int) -> DataFrame:
    """(run, vector): the vectors of ``units`` (id, vector) as run 0, and ``shuffles`` more runs where every column is moved along
    a random order of the units by a step of its own, so that columns keep their values and lose each other."""
    base = kept(units.select("id", "vector"), "units")
    order = kept(indexed(base.withColumn("_h", F.xxhash64("id", F.lit(seed))), ["_h", "id"], "i").select("i", "vector"), "order")
    n = order.count()
    each = order.select("i", F.posexplode("vector").alias("f", "value"))
    runs = each.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(shuffles))))
    step = F.when(F.col("run") == 0, 0).otherwise(F.pmod(F.xxhash64("run", "f", F.lit(seed)), F.lit(max(1, n))))
    moved = runs.withColumn("j", (F.col("i") + step) % F.lit(max(1, n)))
    held = moved.groupBy("run", "j").agg(F.sort_array(F.collect_list(F.struct("f", "value"))).alias("v"))  # the columns of one unit
    return held.select("run", F.transform("v", lambda x: x["value"]).alias("vector"))


def layers(units: DataFrame, k: int, shuffles: int = 49, rounds: int = 30, seed: int = 7) -> DataFrame:
    """One row (units, k, r2, null_mean, null_max, p): the share of the variance of ``units`` (id, vector; each id once) that k layers
    explain, and how often layers of units with shuffled columns explain as much (with the units themselves counted in).

    Columns are centred and scaled first. The units and all their shuffles take the steps of k-means together, one
    aggregation a step, from the k units of each that come first in a hash order. Vectors that are null or hold a null
    are left out; a column without variance counts nothing; with fewer units than k, or no variance, r2 and p are null."""
    some = kept(units.where(F.col("vector").isNotNull() & ~F.exists("vector", lambda v: v.isNull() | F.isnan(v))).select("id", F.col("vector").cast("array<double>").alias("vector")), "units")
    moments = some.select(F.posexplode("vector").alias("f", "v")).groupBy("f").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()  # a row a column
    n = some.count()
    spark = units.sparkSession
    if n < k or not any(r["s"] for r in moments):
        return spark.createDataFrame([(n, k, None, None, None, None)], "units long, k int, r2 double, null_mean double, null_max double, p double")
    width = len(moments)
    mean, dev = (np.zeros(width), np.zeros(width))
    for r in moments:
        mean[r["f"]], dev[r["f"]] = r["m"], r["s"]
    scaled = F.transform("vector", lambda v, i: F.when(F.get(F.array(*map(F.lit, dev.tolist())), i) > 0, (v - F.get(F.array(*map(F.lit, mean.tolist())), i)) / F.get(F.array(*map(F.lit, dev.tolist())), i)).otherwise(0.0))
    points = kept(shuffled(some.select("id", scaled.alias("vector")), shuffles, seed), "shuffled")
    runs = shuffles + 1
    if runs * k * width > CENTRES:
        raise ValueError(f"{runs * k * width} numbers in centres; {CENTRES} at most")
    from pyspark.sql import Window

    first = Window.partitionBy("run").orderBy(F.xxhash64("vector", F.lit(seed)))
    picked = points.groupBy("run", "vector").agg(F.count(F.lit(1)).alias("n")).withColumn("at", F.row_number().over(first)).where(F.col("at") <= k).collect()  # k vectors a run
    centres = np.zeros((runs, k, width))
    for r in picked:
        centres[r["run"], r["at"] - 1 :] = r["vector"]  # fewer different vectors than k: the last again
    for _ in range(rounds):
        sums, numbers, gains = _summed(points, centres, False)
        new = np.where(numbers[..., None] > 0, np.round(sums / np.maximum(numbers[..., None], 1), 9), centres)
        if np.array_equal(new, centres):
            break
        centres = new
    within = _summed(points, centres, False)[2].sum(1)
    total = n * float((dev > 0).sum())
    r2 = np.round(1 - within / total, 9)
    row = (n, k, float(r2[0]), float(r2[1:].mean()) if shuffles else None, float(r2[1:].max()) if shuffles else None, float((r2 >= r2[0]).sum() / runs))
    return spark.createDataFrame([row], "units long, k int, r2 double, null_mean double, null_max double, p double")
