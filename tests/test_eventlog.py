from __future__ import annotations

import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sediment.sources.eventlog import EventLog
from sediment.sources.records import scratch
from sediment.sources.store import Store

SCHEMA = "id long, `a.b` string"


def rows(spark, *ids):
    return spark.createDataFrame([(i, f"x{i}") for i in ids], SCHEMA)


def held(log, **how):
    return sorted((r["id"], r["batch"]) for r in log.read(**how).collect())


@pytest.mark.parametrize("step", ["write", "torn file", "half line", "committed"])
def test_a_batch_that_fails_anywhere_and_is_sent_again_is_there_once(spark, monkeypatch, step):
    log = EventLog(spark, scratch(spark, "log"), SCHEMA)
    log.append(rows(spark, 1, 2), "first")
    write, say = EventLog._write, EventLog._say

    def failing_write(self, df, folder):
        write(self, df.limit(1), folder)
        raise RuntimeError("lost")

    def failing_say(self, out, line):
        if step == "half line":
            out.write(bytearray(line[:-5]))
            out.close()
        if step == "committed":
            say(self, out, line)
        raise RuntimeError("lost")

    monkeypatch.setattr(EventLog, "_write" if step == "write" else "_say", failing_write if step == "write" else failing_say)
    with pytest.raises(RuntimeError):
        log.append(rows(spark, 3, 4), "second")
    monkeypatch.undo()
    assert held(log) == [(1, "first"), (2, "first")] + ([(3, "second"), (4, "second")] if step == "committed" else [])
    for _ in range(2):
        log.append(rows(spark, 3, 4), "second")
    log.append(rows(spark, 5), "third")
    assert held(log) == [(1, "first"), (2, "first"), (3, "second"), (4, "second"), (5, "third")]
    lost = log.vacuum()
    assert lost == (0 if step == "committed" else 1) and len(held(log)) == 5


def test_writers_side_by_side(spark):
    log = EventLog(spark, scratch(spark, "log"), SCHEMA)
    failed = []

    def send(i: int) -> None:
        try:
            log.append(rows(spark, i), f"batch {i % 5}" if i < 5 else f"batch {i - 5}")
        except Exception as e:  # noqa: BLE001  shown below
            failed.append(e)

    threads = [threading.Thread(target=send, args=(i % 5,)) for i in range(10)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and held(log) == [(i, f"batch {i}") for i in range(5)]


def test_versions_and_empty_batches(spark):
    log = EventLog(spark, scratch(spark, "log"), SCHEMA)
    assert held(log) == [] and log.read().columns == ["id", "a.b", "batch", "commit"]
    one, two = log.append(rows(spark, 1), "a"), log.append(rows(spark), "none")
    three = log.append(rows(spark, None), "null")
    assert one < two < three and [c["rows"] for c in log.commits()] == [1, 0, 1]
    assert held(log, upto=two) == [(1, "a")] and log.read().count() == 2


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    rows(spark, 1, 2).repartition(2).write.parquet(source)
    log = EventLog(spark, scratch(spark, "log"), SCHEMA)
    for _ in range(2):  # the second run starts again without its checkpoint
        log.append_stream(spark.readStream.schema(SCHEMA).parquet(source), "s", scratch(spark, "point"))
    assert [i for i, _ in held(log)] == [1, 2]


def filled(spark):
    store = Store(spark, scratch(spark, "store"), "work string", "work string, seq long, text string", 3)
    store.upsert(spark.createDataFrame([("w",), ("v",)], "work string"), spark.createDataFrame([("w", 1, "one two"), ("v", 1, "two")], "work string, seq long, text string"))
    return store


def state(store):
    return (Counter(map(tuple, store.read("passages").select("work", "seq", "text").collect())), Counter(map(tuple, store.read("postings").select("work", "token", "n").collect())))


MORE = [("w", 2, "two three"), ("w", 2, "two three"), ("v", None, "new"), ("x", 1, "unknown"), ("v", 1, "changed")]


@pytest.mark.parametrize("step", range(3))
def test_a_store_append_that_fails_anywhere_and_is_repeated_is_there_once(spark, monkeypatch, step):
    more = spark.createDataFrame(MORE, "work string, seq long, text string")
    store, plain = filled(spark), filled(spark)
    plain.append(more)
    put, calls = Store._put, []

    def failing(self, name, df, touched):
        if len(calls) == step:
            raise RuntimeError("lost")
        calls.append(name)
        put(self, name, df, touched)
        if step == 2 and len(calls) == 2:
            raise RuntimeError("lost")

    monkeypatch.setattr(Store, "_put", failing)
    with pytest.raises(RuntimeError):
        store.append(more)
    monkeypatch.undo()
    for _ in range(2):
        store.append(more)
    assert state(store) == state(plain)
    assert state(store) == (
        Counter([("w", 1, "one two"), ("w", 2, "two three"), ("v", 1, "changed"), ("v", None, "new")]),
        Counter([("w", "one", 1), ("w", "two", 2), ("w", "three", 1), ("v", "changed", 1), ("v", "new", 1)]),
    )
    assert store.read("works").select(F.count(F.lit(1))).first()[0] == 2
