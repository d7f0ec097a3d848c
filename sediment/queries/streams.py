"""Events as a file stream: windows, and the same results in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query, table
from ..sources import records
from ..streaming import blocks as B
from ..streaming import windows as W


def streamed(spark, d):
    path = f"{d}/events.parquet"
    return W.event_stream(spark, path.replace("events.parquet", "events.parquet*"), spark.read.parquet(path).schema)


@query(319, 325, sql="SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, d):
    return W.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"])


@query(316, 325, sql="SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * o AS start, event_type, count(*) AS n FROM events, (SELECT unnest(range(0, 3)) AS o) GROUP BY 1, 2")
def sliding_counts(spark, d):
    return W.sliding(table(spark, d, "events"), "ts", "3 hours", "1 hour", ["event_type"])


@query(321, 325, sql="SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(date_trunc('milliseconds', ts)) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2")
def streamed_tumbling_counts(spark, d):
    """The stream's closed windows; those after the last watermark stay open."""
    return W.finished(W.tumbling(streamed(spark, d), "ts", "1 hour", ["event_type"]))


KINDS = ["signup", "error", "click", "view", "purchase"]
EVENT_FOLD = """SELECT user_id, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS "view",
count(*) FILTER (event_type = 'purchase') AS purchase, arg_max(event_type, (ts, event_id)) AS last_kind FROM events GROUP BY 1"""


@query(310, sql=EVENT_FOLD)
def streamed_fold(spark, d):
    """The stateful fold on the stream: the state of every user after the last micro-batch."""
    e = streamed(spark, d).select("user_id", "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))
    step, start = W.counted(KINDS)
    columns = ", ".join(f"{k} long" for k in KINDS) + ", last_kind string"
    return W.updated(W.folded(e, "user_id", ["ts", "seq", "kind"], f"user_id long, {columns}", columns, step, start), "user_id")


@query(311, sql=EVENT_FOLD)
def restored_fold(spark, d):
    """A snapshot of the first events, written, read again and carried on; it must be what a replay of all gives."""
    e = table(spark, d, "events").withColumnRenamed("event_type", "kind")
    path = records.scratch(spark, "snapshot")
    W.snapshot(e.where("event_id <= 700"), "user_id", ["ts", "event_id"], KINDS).write.parquet(path)
    out = W.restored(e.where("event_id > 700"), spark.read.parquet(path), "user_id", ["ts", "event_id"], KINDS)
    whole = W.replayed(e, "user_id", ["ts", "event_id"], KINDS)
    if W.differing(out, whole.select(*out.columns)):
        raise ValueError("the restored state is not the replayed one")
    return out


@query(314, sql="""WITH RECURSIVE t AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey // 3 > 0), r AS (SELECT p_partkey AS id, 0 AS steps FROM part WHERE p_size = 7 UNION SELECT t.child, r.steps + 1 FROM r JOIN t ON t.parent = r.id)
SELECT id, min(steps)::INT AS steps FROM r GROUP BY 1""")
def retraction(spark, d):
    p = table(spark, d, "part")
    t = p.select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 3).alias("parent")).where("parent > 0")
    return W.retracted(t, p.where("p_size = 7").select(F.col("p_partkey").alias("id")), "child", "parent")


@query(318, sql="""SELECT event_id, user_id, strikes, ts + to_microseconds((least(86400.0, 3600 * pow(2.0, strikes - 1)) * 1000000)::BIGINT) AS blocked_until
FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS strikes FROM events WHERE event_type = 'error')""")
def escalating_blocks(spark, d):
    out = W.escalated(table(spark, d, "events"), "user_id", "ts", F.col("event_type") == "error")
    return out.select("event_id", "user_id", "strikes", F.col("blocked_until").cast("timestamp_ntz").alias("blocked_until"))


STRIKES = """SELECT event_id, user_id, strikes, ts + to_microseconds((least(86400.0, 3600 * pow(2.0, strikes - 1)) * 1000000)::BIGINT) AS blocked_until
FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS strikes FROM events WHERE event_type = 'error')"""


@query(318, sql=STRIKES)
def streamed_blocks(spark, d):
    """Events arrive ten days at a time; after each arrival the stream goes on from its checkpoint."""
    e = table(spark, d, "events")
    source, base = records.scratch(spark, "arrivals"), records.scratch(spark, "blocks")
    for days in ((None, "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", None)):
        after, before = (F.lit(x).cast("timestamp_ntz") for x in days)
        e.where((after.isNull() | (F.col("ts") >= after)) & (before.isNull() | (F.col("ts") < before))).write.mode("append").parquet(source)
        with B.stateful(spark):
            stream = W.event_stream(spark, source, e.schema, late="1 minute")
            out = W.finished(B.streamed_blocks(stream, "user_id", "ts", F.col("event_type") == "error"), base=base)
    return out.select("event_id", "user_id", "strikes", F.col("blocked_until").cast("timestamp_ntz").alias("blocked_until"))


@query(sql=EVENT_FOLD)
def event_fold(spark, d):
    e = table(spark, d, "events").withColumnRenamed("event_type", "kind")
    return W.replayed(e, "user_id", ["ts", "event_id"], KINDS)


@query(313, sql="SELECT event_id FROM (SELECT event_id, user_id || '-' || date_trunc('day', ts)::DATE AS tx, event_type FROM events) e WHERE EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'purchase' AND c.user_id || '-' || date_trunc('day', c.ts)::DATE = e.tx)")
def committed_events(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "commit").otherwise(F.col("event_type"))
    return W.committed(e.select("event_id", kind.alias("kind"), F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("tx"))).select("event_id")


@query(312, sql="SELECT event_id, 999999::BIGINT AS session FROM events WHERE user_id = 7 AND event_id <= 5000")
def forked_session(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("session"), F.col("event_id").alias("seq"))
    return W.forked(e, 7, 5000, 999999).select("event_id", F.col("session").cast("long").alias("session"))


@query(317, 108, sql="""SELECT user_id, least(10, sum(CASE event_type WHEN 'error' THEN 3 WHEN 'click' THEN 1 ELSE 0 END))::BIGINT AS score, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1""")
def suspect_scores(spark, d):
    points = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "click", 1).otherwise(0)
    return table(spark, d, "events").groupBy("user_id").agg(F.least(F.lit(10).cast("long"), F.sum(points)).alias("score"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
