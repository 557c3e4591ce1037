"""Progress of jobs as a stream whose state ends with the jobs.

Each job has one state row: its last snapshot, and whether it has ended.  A snapshot is emitted when it
changes, the last one with the terminal event; what comes after that is ignored.  An event-time timer removes
the state ``hold`` after the end (until then late events of the job are recognised), and that of a job
without news for ``idle``.  State lives in RocksDB.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomscribe.functions.text import retrying

TERMINAL = ("done", "failed")
OUT = "job_id long, ms long, event_id long, status string, progress int, status_description string"
_STATE = "ms long, event_id long, status string, progress int, status_description string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Progress(StatefulProcessor):
    def __init__(self, hold_ms: int, idle_ms: int):
        self.hold_ms, self.idle_ms = hold_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.last.get()) if self.last.exists() else None
        if before is not None and before[2] in TERMINAL:
            return
        events = pd.concat(list(rows)).sort_values(["ms", "event_id"])
        now = before
        for event in events[["ms", "event_id", "status", "progress", "status_description"]].itertuples(index=False, name=None):
            if now is None or event[:2] > now[:2]:
                now = event
            if event[2] in TERMINAL:
                now = event
                break
        if now == before:
            return
        self.last.update((int(now[0]), int(now[1]), now[2], None if pd.isna(now[3]) else int(now[3]), now[4]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        wait = self.hold_ms if now[2] in TERMINAL else self.idle_ms
        self.handle.registerTimer(max(int(now[0]), timerValues.getCurrentWatermarkInMs()) + wait)
        yield pd.DataFrame([(key[0], *now)], columns=["job_id", "ms", "event_id", "status", "progress", "status_description"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def job_snapshots(events: DataFrame, delay: str = "1 hour", hold_ms: int = 3_600_000, idle_ms: int = 7 * 86_400_000) -> DataFrame:
    """``job_id, ms, event_id, status, progress, status_description, retrying``: streamed snapshots until a job ends, in update mode.

    ``events``: ``job_id, event_id, ts, status, progress, status_description``; the session's state store
    must be ``PROVIDER``.
    """
    timed = events.withWatermark("ts", delay).select("job_id", "event_id", "ts", F.unix_millis("ts").alias("ms"), "status", "progress", "status_description")
    rows = timed.groupBy("job_id").transformWithStateInPandas(Progress(hold_ms, idle_ms), outputStructType=OUT, outputMode="Update", timeMode="EventTime")
    return rows.withColumn("retrying", retrying(F.col("status"), F.col("status_description")))


def last_snapshots(rows: DataFrame) -> DataFrame:
    """The newest emitted snapshot of every job."""
    last = F.max_by(F.struct("status", "progress", "status_description", "retrying"), F.struct("ms", "event_id"))
    return rows.groupBy("job_id").agg(last.alias("s")).select("job_id", "s.*")
