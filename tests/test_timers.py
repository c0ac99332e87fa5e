"""Streams with state against their predicates on landed rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from sitescope.streaming import limits, timers

T = datetime.datetime(2026, 1, 1)


def at(seconds):
    return T + datetime.timedelta(seconds=seconds)


@pytest.fixture
def run(spark, tmp_path):
    """Feeds parts as batches to a stream, one after another, and returns all it put out.

    A stream whose state lives by the clock never runs out of batches: it is run once for each part.
    """
    conf = timers.STATE_STORE | {"spark.sql.shuffle.partitions": "1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)

    def go(name, schema, parts, plan, trigger="availableNow"):
        src = str(tmp_path / f"{name}-src")
        out = []
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
            stream = plan(spark.readStream.schema(schema).parquet(src))
            q = stream.writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(**{trigger: True}).start()
            q.awaitTermination(120)
        return out

    yield go
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_stale_jobs(spark, run):
    schema = "key string, ts timestamp, status string"
    parts = [
        [("a", at(0), "running"), ("b", at(0), "running"), ("c", at(0), "running")],
        [("a", at(200), "running"), ("c", at(100), "done"), ("z", at(350), "running")],  # b is silent for 350 s
        [("b", at(360), "running"), ("z", at(800), "running")],  # a and b are silent
        [("z", at(2000), "done"), ("y", at(2000), "running")],
    ]
    # z is done in the batch that would tell of its silence.
    got = sorted((r["key"], r["last_sign"]) for r in run("stale", schema, parts, lambda s: timers.stale_jobs(s, 300)))
    assert got == [("a", at(200)), ("b", at(0)), ("b", at(360))]
    # The predicate at the time of the third batch: of the jobs that run, those whose last sign is old.
    last = spark.createDataFrame([("a", "running", at(200)), ("b", "running", at(360)), ("c", "done", at(100)), ("z", "running", at(800))], "id string, status string, heartbeat_at timestamp").withColumn("started_at", F.col("heartbeat_at"))
    assert {r["id"] for r in limits.stale(last, F.lit(at(800)), 300).collect()} == {"a", "b"}


def test_gaps(spark, run):
    schema = "key string, ts timestamp, event_id long"
    parts = [[("h", at(0), 1), ("h", at(1), 2), ("g", at(0), 3)], [("h", at(1.5), 4), ("g", at(9), 5)], [("h", at(30), 6), ("g", at(30), 7)]]
    got = sorted((r["event_id"], r["gap"], r["too_soon"]) for r in run("gaps", schema, parts, lambda s: timers.gaps(s, 2.0)))
    all_rows = spark.createDataFrame([r for p in parts for r in p], schema)
    want = sorted((r["event_id"], r["gap"], r["too_soon"]) for r in limits.request_gaps(all_rows, "key", "ts", 2.0).collect())
    assert got == want and sum(r[2] for r in got) == 2
    # A late row has no gap; a host that was idle starts anew.
    parts = [[("h", at(0), 1), ("x", at(0), 2)], [("x", at(500), 3)], [("h", at(501), 4), ("x", at(502), 5)]]
    got = {r["event_id"]: r["gap"] for r in run("idle", schema, parts, lambda s: timers.gaps(s, 2.0, late="1 minute", idle=100))}
    assert got == {1: None, 2: None, 3: 500.0, 4: None, 5: 2.0}


def test_failures(spark, run):
    schema = "key string, ts timestamp, ok boolean"
    parts = [[("a", at(0), False), ("a", at(10), False), ("b", at(0), False)], [("a", at(20), False), ("b", at(5), True)], [("a", at(25), True), ("a", at(30), False), ("b", at(400), False)]]
    got = sorted((r["key"], r["ts"], r["failures"], r["blocked"]) for r in run("failures", schema, parts, lambda s: timers.failures(s, 300, 3), "once"))
    landed = limits.failures_in_window(spark.createDataFrame([r for p in parts for r in p], schema), "key", "ts", 300, 3, "ok")
    assert got == sorted((r["key"], r["ts"], r["failures"], r["blocked"]) for r in landed.collect())
    assert [r[3] for r in got].count(True) == 1


def test_active_work(spark, run):
    schema = "project string, ts timestamp, n int"
    parts = [[("p", at(0), 1), ("q", at(5), 2)], [("p", at(10), 3)], [("p", at(5000), 4), ("q", at(5001), 5)], [("p", at(5002), 6)]]
    got = sorted(r["n"] for r in run("active", schema, parts, lambda s: timers.accepted(s, ["project"], "10 minutes")))
    # A key is free once the watermark, ten minutes behind the latest row before, has passed the time of its first row.
    assert got == [1, 2, 6]
