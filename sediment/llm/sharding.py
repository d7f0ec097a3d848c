"""Shards of equal size with linked documents together, by balanced label propagation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, numbered, with_rank, written

SHARDS = 40


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, group_size) for every row of ``docs`` (doc_id, text).

    Law ``rows``: shards differ by one row at most. Documents with equal texts are linked. Rows start dealt
    evenly in hash order. In every round each group of equal texts names its home shards (those that hold most of
    it, as many as it needs at a shard's capacity) and its rows elsewhere ask to move home; moves between
    two shards are granted up to a quota so that sizes never change: requests one way are paired with
    requests the other way, then with unlinked rows, which change places with them. Rounds end when
    nothing asks or no request can be granted. The quotas are a table of shards x shards, whatever the input.

    How many linked rows are still cut from their group is what ``cut_rows`` counts.

    Null text counts as empty (16 bytes, crc 0) and is linked with empty texts. Rows with equal doc_id stay
    rows of their own, equal rows too (they are numbered, and their numbers hashed). An empty table gives no
    rows. Order of ties is by hash, doc_id. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.xxhash64(text).alias("_g"))
    base = written(base.withColumn("_h", F.xxhash64("doc_id", "_g", F.lit(1))), "rows")
    base = numbered(base, "_h", "_nth").withColumn("_u", F.xxhash64("_h", "_nth")).drop("_h", "_nth")
    # written, as Spark can split a hot group only where neither side of the join is aggregated in the same stage
    sized = written(base.groupBy("_g", "text_crc32").agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "groups")
    linked = base.join(sized.withColumnsRenamed({"_g": "_g2", "text_crc32": "_c2"}), (F.col("_g") == F.col("_g2")) & (F.col("text_crc32") == F.col("_c2")), "left").drop("_g2", "_c2")
    linked = linked.withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    start = with_rank(linked, [], "_u", "_r", ["doc_id"])
    at = written(start.withColumn("shard", (F.col("_r") % shards).cast("int")).withColumn("_id", F.col("_r")).drop("_r"), "shards")
    total = at.count()
    capacity = max(1, total // shards)
    for turn in range(rounds):
        groups = at.where("group_size > 1")
        held = groups.groupBy("_g", "text_crc32", "shard").agg(F.count(F.lit(1)).alias("n"), F.first("group_size").alias("m"))
        best = Window.partitionBy("_g", "text_crc32").orderBy(F.desc("n"), F.xxhash64("_g", "shard"))
        need = F.ceil(F.col("m") / F.lit(capacity))
        homes = held.withColumn("place", F.row_number().over(best)).where(F.col("place") <= need)
        homes = homes.groupBy("_g", "text_crc32").agg(F.sort_array(F.collect_list("shard")).alias("homes"))  # at most `shards` numbers
        homes = written(homes, "homes")
        asked = groups.join(homes.withColumnsRenamed({"_g": "_g2", "text_crc32": "_c2"}), (F.col("_g") == F.col("_g2")) & (F.col("text_crc32") == F.col("_c2")))
        asked = asked.where(~F.array_contains("homes", F.col("shard"))).withColumn("to", F.element_at("homes", (F.pmod(F.xxhash64("_u", F.lit(turn)), F.size("homes")) + 1).cast("int")))
        asked = written(asked.select("_id", "_u", "shard", "to"), "asked")
        want = np.zeros((shards, shards), np.int64)
        for a, b, n in asked.groupBy("shard", "to").agg(F.count(F.lit(1))).collect():  # shards x shards at most
            want[a, b] = n
        if not want.sum():
            break
        single = np.zeros(shards, np.int64)
        for a, n in at.where("group_size = 1").groupBy("shard").agg(F.count(F.lit(1))).collect():
            single[a] = n
        grant, back = quotas(want, single)
        if not grant.sum():
            break
        spark = docs.sparkSession
        pairs = spark.createDataFrame([(int(a), int(b), int(grant[a, b])) for a, b in zip(*np.nonzero(grant))], "a int, b int, quota long")
        placed = with_rank(asked, ["shard", "to"], "_u", "_r", ["_id"])
        moves = placed.join(F.broadcast(pairs), (placed.shard == pairs.a) & (placed["to"] == pairs.b)).where("_r < quota").select("_id", F.col("to").alias("_to"))
        if back.sum():
            ends = [(b, a, int(e - back[b, a]), int(e)) for b in range(shards) for a, e in zip(range(shards), np.cumsum(back[b])) if back[b, a]]
            ranges = spark.createDataFrame(ends, "a int, b int, low long, high long")
            free = with_rank(at.where("group_size = 1").select("_id", "_u", "shard"), ["shard"], "_u", "_r", ["_id"])
            moves = moves.union(free.join(F.broadcast(ranges), (free.shard == ranges.a) & (F.col("_r") >= F.col("low")) & (F.col("_r") < F.col("high"))).select("_id", F.col("b").alias("_to")))
        moves = moves.withColumnRenamed("_id", "_m")
        old, at = at, written(at.join(moves, at._id == moves._m, "left").withColumn("shard", F.coalesce("_to", "shard")).drop("_m", "_to"), "shards")
        discard(old, asked, homes)
    slots = with_rank(at, ["shard"], "_u", "slot", ["_id"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_size")


def cut_rows(sharded: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(linked, cut), one row: rows whose text others share, and how many of them lie outside the shards that hold most
    of their text (as many shards as it needs). ``sharded``: the rows of ``shard_documents``."""
    size = F.col("size") - 16
    held = sharded.groupBy(size.alias("bytes"), "text_crc32", "shard").agg(F.count(F.lit(1)).alias("n"))  # at most `shards` rows a text
    text = Window.partitionBy("bytes", "text_crc32")
    total = held.agg(F.sum("n")).first()[0] or 0
    capacity = max(1, total // shards)
    placed = held.withColumn("m", F.sum("n").over(text)).withColumn("place", F.row_number().over(text.orderBy(F.desc("n"), "shard"))).where("m > 1")
    away = F.when(F.col("place") > F.ceil(F.col("m") / F.lit(capacity)), F.col("n")).otherwise(0)
    return placed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("linked"), F.coalesce(F.sum(away), F.lit(0)).alias("cut"))


def quotas(want: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moves granted from a to b, and unlinked rows that b gives back to a, so that no shard's size changes."""
    both = np.minimum(want, want.T)
    over = want - both
    back = over.T.copy()  # b -> a
    for b in range(len(single)):
        ask = back[b].sum()
        if ask > single[b]:
            back[b] = back[b] * single[b] // ask
    return both + back.T, back


def op9_shard_documents(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_documents(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
