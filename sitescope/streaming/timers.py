"""Limits over streams with named state, timers and lifetimes: heartbeats, gaps between requests, failures, active work.

Each is the stream's form of a predicate in ``limits`` that works on landed rows. State is kept by key in RocksDB (set
``STATE_STORE`` before the stream starts), so a key's state, not all keys', is what a task holds; it goes by timer or lifetime,
so it is bounded by the keys that are active. With the time mode ``EventTime`` timers follow the watermark, and results depend
on the rows alone; ``ProcessingTime`` is for live use, where silence has to be noticed without further rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: A key's state goes when nothing has come for so long.
IDLE_SECONDS = 24 * 3600


def _rows(batches: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    return [r for b in batches for r in b[columns].itertuples(index=False, name=None)]


class Heartbeats(StatefulProcessor):
    """Of every running job the last sign of life; a timer that no later sign replaces reports the job as stale."""

    def __init__(self, seconds: int, event_time: bool) -> None:
        self.seconds, self.event_time = seconds, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts timestamp")

    def _forget(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        found = _rows(rows, ["ts", "status"])
        known = self.last.get()[0] if self.last.exists() else None
        times = [t for t, _ in found] + ([pd.Timestamp(known)] if known is not None else [])
        if any(s != "running" for _, s in found):  # finished: nothing to wait for
            self._forget()
            self.last.clear()
            return
        last = max(times)
        self._forget()
        self.last.update((last.to_pydatetime(),))
        from_ms = last.value // 1_000_000 if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(from_ms + self.seconds * 1000)
        yield pd.DataFrame({"key": pd.Series(dtype="object"), "last_sign": pd.Series(dtype="datetime64[ns]")})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            last = pd.Timestamp(self.last.get()[0])
            self.last.clear()
            yield pd.DataFrame({"key": [key[0]], "last_sign": [last]})

    def close(self) -> None:
        pass


class Gaps(StatefulProcessor):
    """Seconds since a host's request before. Rows of a batch are taken by time, then number; a late row is measured from none."""

    def __init__(self, delay: float, idle: int, event_time: bool) -> None:
        self.delay, self.idle, self.event_time = delay, idle, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts timestamp")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(self.last.get()[0]) if self.last.exists() else None
        out = []
        for ts, number in sorted(_rows(rows, ["ts", "event_id"])):
            gap = None if last is None or ts < last else (ts - last).value / 1e9
            out.append((key[0], number, gap, gap is not None and gap < self.delay))
            last = ts if last is None else max(ts, last)
        self.last.update((last.to_pydatetime(),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        from_ms = last.value // 1_000_000 if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(from_ms + self.idle * 1000)
        yield pd.DataFrame(out, columns=["key", "event_id", "gap", "too_soon"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"key": pd.Series(dtype="object"), "event_id": pd.Series(dtype="int64"), "gap": pd.Series(dtype="float64"), "too_soon": pd.Series(dtype="bool")})

    def close(self) -> None:
        pass


class Failures(StatefulProcessor):
    """The failures of a key within a window, as a list that lives as long as the window; a success empties it."""

    def __init__(self, seconds: int, limit: int) -> None:
        self.seconds, self.limit = seconds, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "ts timestamp", self.seconds * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        times = [pd.Timestamp(t[0]) for t in self.times.get()] if self.times.exists() else []
        out, window = [], pd.Timedelta(seconds=self.seconds)
        for ts, ok in sorted(_rows(rows, ["ts", "ok"])):
            times = [] if ok else [*[t for t in times if ts - t <= window], ts][-self.limit :]
            out.append((key[0], ts, len(times), len(times) >= self.limit))
        if times:
            self.times.put([(t.to_pydatetime(),) for t in times])
        else:
            self.times.clear()
        yield pd.DataFrame(out, columns=["key", "ts", "failures", "blocked"])

    def close(self) -> None:
        pass


def stale_jobs(stream: DataFrame, seconds: int = 300, late: str = "0 seconds", event_time: bool = True) -> DataFrame:
    """(key, last_sign) of jobs of a stream (key, ts, status) that fall silent for ``seconds`` while they run."""
    mode = "EventTime" if event_time else "ProcessingTime"
    rows = stream.withWatermark("ts", late) if event_time else stream
    return rows.groupBy("key").transformWithStateInPandas(Heartbeats(seconds, event_time), "key string, last_sign timestamp", "Append", mode)


def gaps(stream: DataFrame, delay: float, late: str = "0 seconds", idle: int = IDLE_SECONDS, event_time: bool = True) -> DataFrame:
    """(key, event_id, gap, too_soon) of every request of a stream (key, ts, event_id); a host's time goes after ``idle`` seconds."""
    mode = "EventTime" if event_time else "ProcessingTime"
    rows = stream.withWatermark("ts", late) if event_time else stream
    return rows.groupBy("key").transformWithStateInPandas(Gaps(delay, idle, event_time), "key string, event_id long, gap double, too_soon boolean", "Append", mode)


def failures(stream: DataFrame, seconds: int, limit: int) -> DataFrame:
    """(key, ts, failures, blocked) of a stream (key, ts, ok). Lifetimes count by the clock: at most as long as the window."""
    return stream.groupBy("key").transformWithStateInPandas(Failures(seconds, limit), "key string, ts timestamp, failures int, blocked boolean", "Append", "ProcessingTime")


def accepted(requests: DataFrame, keys: list[str], within: str) -> DataFrame:
    """Requests for work of a stream (.., ts), one for each key while it may be active.

    Repeats within the time of the first are dropped; a key is free again when the watermark has passed that time.
    """
    return requests.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)
