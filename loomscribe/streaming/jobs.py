"""Structured Streaming over job events, chat frames and arriving snapshots.

The same transformations work on batch frames; the state of the streams is bounded by a
watermark or by the end of a turn.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from loomscribe.functions.text import retrying
from loomscribe.plans.refresh import refresh_decision, snapshot_diff
from loomscribe.sources.scratch import exists, shared_folder

TERMINAL = ("done", "failed")


def job_progress(events: DataFrame) -> DataFrame:
    """The current snapshot of every job."""
    last = F.max_by(F.struct("status", "progress", "status_description"), F.struct("ts", "event_id"))
    rows = events.groupBy("job_id").agg(last.alias("s")).select("job_id", "s.*")
    return rows.withColumn("retrying", retrying(F.col("status"), F.col("status_description")))


def job_terminal(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first terminal event of every job, once."""
    ended = events.filter(F.col("status").isin(*TERMINAL)).select("job_id", "status", "ts")
    if events.isStreaming:
        return ended.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id"])
    return ended.groupBy("job_id").agg(F.min_by("status", "ts").alias("status"), F.min("ts").alias("ts"))


MESSAGES = "session_id long, turn long, content string"
_HELD = "seqs array<long>, parts array<string>, total long, newest long"


#: Event time after its newest frame at which an unfinished turn is given up, in milliseconds.
EXPIRY_MS = 3_600_000


def _turn(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, expires: bool) -> Iterator[pd.DataFrame]:
    """Holds the chunks of one turn until its done frame, whose ``seq`` is their number, and all of
    them have come, in any order and any batches; an error drops them.  A turn that has ended or
    that gets no frame for ``EXPIRY_MS`` leaves no state."""
    if state.hasTimedOut:
        state.remove()
        return
    seqs, parts, total, newest = state.get if state.exists else ([], [], -1, 0)
    held, failed = dict(zip(seqs, parts, strict=True)), False
    for batch in frames:
        for seq, kind, text, ms in zip(*(batch[c].tolist() for c in ("seq", "type", "content", "ms")), strict=True):
            newest = max(newest, ms)
            if kind == "chunk":
                held[seq] = text if isinstance(text, str) else ""
            elif kind == "done":
                total = max(total, seq)
            elif kind == "error":
                failed = True
    whole = 0 <= total <= len(held)
    if whole and not failed:
        yield pd.DataFrame({"session_id": [key[0]], "turn": [key[1]], "content": ["".join(held[q] for q in sorted(held))]})
    if whole or failed:
        state.remove()
        return
    state.update((list(held), list(held.values()), total, newest))
    if expires:
        state.setTimeoutTimestamp(max(newest + EXPIRY_MS, state.getCurrentWatermarkMs() + 1))


def assemble_frames(frames: DataFrame, delay: str = "1 day") -> DataFrame:
    """``session_id, turn, content``: one message per turn that ended well.

    Streamed frames should have their time ``ts``, which bounds the state of turns that never end;
    then frames more than ``delay`` behind the newest are late and dropped."""
    if frames.isStreaming:
        expires = "ts" in frames.columns
        timed = frames.withWatermark("ts", delay) if expires else frames
        ms = F.unix_millis("ts") if expires else F.lit(0).cast("long")
        timed = timed.select("session_id", "turn", "seq", "type", "content", *(["ts"] if expires else []), ms.alias("ms"))
        timeout = GroupStateTimeout.EventTimeTimeout if expires else GroupStateTimeout.NoTimeout
        return timed.groupBy("session_id", "turn").applyInPandasWithState(partial(_turn, expires=expires), MESSAGES, _HELD, "append", timeout)
    chunk = F.when(F.col("type") == "chunk", F.struct("seq", "content"))
    rows = frames.groupBy("session_id", "turn").agg(F.array_sort(F.collect_list(chunk)).alias("c"), F.max(F.col("type") == "done").alias("fine"), F.max(F.col("type") == "error").alias("bad"))
    return rows.filter("fine and not bad").select("session_id", "turn", F.array_join(F.transform("c", lambda x: x["content"]), "").alias("content"))


def run_available(
    rows: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    mode: str = "append",
    files: int = 6,
    keys: tuple[str, ...] = (),
    per_batch: Callable[[DataFrame], DataFrame] | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Stream ``rows`` from ``files`` files through ``transform``, two files a micro-batch, until all is read.

    Rows of equal ``keys`` arrive in one file.  ``per_batch`` works on each batch before it is kept.
    Returns what the sink holds at the end: all batches, of complete results the last one.
    ``folder`` must be shared by all executors; it defaults to the session's checkpoint folder.
    """
    spark = rows.sparkSession
    base = f"{(folder or shared_folder(spark)).rstrip('/')}/stream-{uuid.uuid4().hex}"
    rows.repartition(files, *keys).write.parquet(f"{base}/in")
    out = transform(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in"))
    numbers: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        (batch if per_batch is None else per_batch(batch)).write.mode("overwrite").parquet(f"{base}/out/{number}")
        numbers.append(number)

    query = out.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    if not numbers:
        return spark.createDataFrame([], out.schema)
    kept = numbers[-1:] if mode == "complete" else sorted(set(numbers))
    return spark.read.parquet(*(f"{base}/out/{n}" for n in kept))


def append_new(messages: DataFrame, path: str, checkpoint: str, delay: str = "1 day") -> None:
    """Append streamed messages (``session_id, seq, role, content, created_at``) to the table at ``path``, each once.

    Replays within ``delay`` of event time are dropped by the stream's state, which the watermark bounds; a batch
    that runs again overwrites its own part; and messages that an earlier batch has stored are dropped by
    (session_id, seq).  Only stored messages as young as the batch less ``delay`` are read for that.
    """
    spark, key = messages.sparkSession, ["session_id", "seq"]
    once = messages.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(key)

    def append(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(key)
        if exists(spark, path):
            low = batch.agg(F.min("created_at").alias("low")).first()["low"]
            stored = spark.read.schema(StructType([*batch.schema.fields, StructField("batch", LongType())])).parquet(path)
            stored = stored.filter((F.col("batch") < number) & (F.col("created_at") >= F.lit(low).cast("timestamp") - F.expr(f"interval {delay}")))
            rows = rows.join(stored.select(key), key, "left_anti")
        rows.select(batch.columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    once.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest(arrivals: DataFrame, old: DataFrame, commits: DataFrame, pages: DataFrame, page_files: DataFrame) -> DataFrame:
    """``repo_id, rel_path, change, decision`` for a batch of newly arrived whole snapshots.

    Only the repositories that arrived are compared; the decision says what is to follow.
    """
    arrived = arrivals.select("repo_id").distinct()
    diff = snapshot_diff(old.join(arrived, "repo_id", "left_semi"), arrivals)
    decisions = refresh_decision(commits.join(arrived, "repo_id", "left_semi"), diff, pages, page_files)
    return diff.join(decisions.select("repo_id", "decision"), "repo_id")
