from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sediment.sources.records import scratch
from sediment.streaming import blocks as B
from sediment.streaming import windows as W

SCHEMA = "event_id long, user long, ts timestamp_ntz, kind string"


def test_stream_equals_table_and_state_empties(spark):
    r = random.Random(1)
    start = datetime(2024, 1, 1)
    times = sorted(start + timedelta(minutes=r.randint(0, 60 * 72)) for _ in range(300))
    rows = [(i, r.choice([1, 2, 3]), t, r.choice(["bad", "good"])) for i, t in enumerate(times)]
    rows += [(900, None, times[0], "bad"), (901, 1, None, "bad"), (902, 2, times[5], "bad"), (903, 2, times[5], "bad")]
    rows.sort(key=lambda x: (x[2] or start, x[0]))
    source, base = scratch(spark, "in"), scratch(spark, "out")
    table = spark.createDataFrame(rows, SCHEMA)
    for part in (rows[:80], rows[80:90], rows[90:]):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(source)
        with B.stateful(spark):
            stream = W.event_stream(spark, source, SCHEMA, late="1 minute")
            found = W.finished(B.streamed_blocks(stream, "user", "ts", F.col("kind") == "bad", memory=7200, first=60, most=500), base=base)
    assert spark.conf.get(B.PROVIDER, None) != B.ROCKS
    wanted = W.escalated(table.where("user is not null and ts is not null"), "user", "ts", F.col("kind") == "bad", "2 hours", 60, 500)
    key = ("user", "event_id", "strikes", F.unix_micros("blocked_until").alias("until"))
    assert sorted(map(tuple, found.select(*key).collect())) == sorted(map(tuple, wanted.select(*key).collect()))

    def held() -> int:
        return spark.read.format("statestore").option("path", f"{base}/state").option("stateVarName", "strikes").load().count()

    assert held() > 0
    later = [(1000, 9, times[-1] + timedelta(days=1), "bad"), (1001, 9, times[-1] + timedelta(days=2), "good")]
    for row in later:  # the second arrival lets the timers see the watermark that the first one set
        spark.createDataFrame([row], SCHEMA).write.mode("append").parquet(source)
        with B.stateful(spark):
            W.finished(B.streamed_blocks(W.event_stream(spark, source, SCHEMA, late="1 minute"), "user", "ts", F.col("kind").isin("bad", "good"), memory=7200, first=60, most=500), base=base)
    with B.stateful(spark):
        keys = {r["key"]["key"] if "key" in r["key"] else r["key"][0] for r in spark.read.format("statestore").option("path", f"{base}/state").option("stateVarName", "strikes").load().collect()}
    assert keys <= {9}
