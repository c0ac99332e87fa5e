"""Sliding limits, gaps between requests, heartbeats, and the sink that replaces what a batch brings anew."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import table


def failures_in_window(events: DataFrame, key: str, at: str, seconds: int, limit: int, ok: str | None = None, tie: str | None = None) -> DataFrame:
    """Adds the failures of the last ``seconds`` of an event's key, and whether it is blocked. For landed events.

    With ``ok``, a success forgets the failures before it, as in the stream; events of one time are taken in the order ``tie``.
    """
    time = F.unix_micros(F.col(at).cast("timestamp"))
    if ok is None:
        by = Window.partitionBy(key).orderBy(time).rangeBetween(-seconds * 1_000_000, 0)
        n = F.count("*").over(by)
        return events.withColumn("failures", n).withColumn("blocked", n >= limit)
    before = Window.partitionBy(key).orderBy(time, tie or ok).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("__since", F.count_if(ok).over(before))
    by = Window.partitionBy(key, "__since").orderBy(time).rangeBetween(-seconds * 1_000_000, 0)
    n = F.when(F.col(ok), F.lit(0)).otherwise(F.count_if(~F.col(ok)).over(by))
    return rows.withColumn("failures", n).withColumn("blocked", n >= limit).drop("__since")


def failure_limiter(stream: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Blocked keys of a stream (key, ts, ok): ``limit`` failures within ``seconds``; a success forgets them.

    The state of a key is the times of its failures within the window, at most ``limit`` of them; it goes when they are old.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists and not state.hasTimedOut else []
        out = []
        for b in batches:
            for ts, ok in sorted(zip(b["ts"], b["ok"], strict=True), key=lambda x: x[0]):
                now = ts.value // 1000
                times = [t for t in times if now - t <= seconds * 1_000_000]
                times = [] if ok else [*times, now][-limit:]
                out.append((key[0], ts, len(times), len(times) >= limit))
        if times:
            state.update((times,))
            state.setTimeoutDuration(seconds * 1000)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["key", "ts", "failures", "blocked"])

    return stream.groupBy("key").applyInPandasWithState(update, "key string, ts timestamp, failures int, blocked boolean", "times array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(stream: DataFrame, at: str, key: str, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by key and window; events later than ``late`` do not count."""
    return stream.withWatermark(at, late).groupBy(F.window(at, length), key).agg(F.count("*").alias("events"))


def request_gaps(events: DataFrame, key: str, at: str, delay: float) -> DataFrame:
    """Adds the seconds since the key's request before, and whether that is less than the agreed delay."""
    by = Window.partitionBy(key).orderBy(at, "event_id")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = (micros(F.col(at)) - micros(F.lag(at).over(by))) / 1_000_000.0
    return events.withColumn("gap", gap).withColumn("too_soon", F.coalesce(gap < delay, F.lit(False)))


def stale(jobs: DataFrame, now: Column, seconds: int = 300) -> DataFrame:
    """Running jobs whose heartbeat is older than ``seconds``; those without one count from their start."""
    beat = F.coalesce("heartbeat_at", "started_at")
    return jobs.where((F.col("status") == "running") & (F.unix_micros(beat.cast("timestamp")) < F.unix_micros(now.cast("timestamp")) - seconds * 1_000_000))


def claim(queue: DataFrame) -> DataFrame:
    """The oldest waiting job, now running. One top-1, no sort of the queue."""
    first = queue.where("status = 'queued'").orderBy("created_at", "id").limit(1).select(F.col("id").alias("claimed"))
    out = queue.join(F.broadcast(first), F.col("id") == F.col("claimed"), "left")
    return out.withColumn("status", F.when(F.col("claimed").isNotNull(), "running").otherwise(F.col("status"))).drop("claimed")


def due_syncs(integrations: DataFrame, syncs: DataFrame, now: Column, hours: int = 20) -> DataFrame:
    """Enabled integrations without an active sync and without one in the last ``hours``."""
    recent = syncs.where(F.col("status").isin("queued", "running") | (F.unix_micros(F.col("created_at").cast("timestamp")) > F.unix_micros(now.cast("timestamp")) - hours * 3_600_000_000))
    return integrations.where("enabled").join(recent.select(F.col("integration_id").alias("id")), "id", "left_anti")


def replace_days(stream: DataFrame, path: str, checkpoint: str):
    """Writes each batch's (integration_id, day) partitions in place of what they held; a repeated batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        table(batch, "days").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("integration_id", "day").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
