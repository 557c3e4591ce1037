"""Calls to models from tasks, tried again after passing errors; what fails for good is a row, not a failed job."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscribe.functions.text import retrying
from loomscribe.sources.scratch import Workspace


@dataclass(frozen=True)
class Retry:
    """How often a call is tried, and how long it waits in between; errors of other kinds fail at once."""

    attempts: int = 3
    initial_delay: float = 2.0
    backoff: float = 2.0
    max_delay: float = 60.0
    transient: tuple[type[Exception], ...] = (TimeoutError, OSError)
    sleep: Callable[[float], None] = field(default=time.sleep, compare=False)

    def call(self, function: Callable, *args: Any) -> tuple[Any, int, str | None, list[str]]:
        """``result, attempts, error, notes``: the result is None if there is an error; a note is the status of one wait."""
        notes: list[str] = []
        for attempt in range(1, self.attempts + 1):
            try:
                return function(*args), attempt, None, notes
            except Exception as error:
                if attempt == self.attempts or not isinstance(error, self.transient):
                    return None, attempt, f"{type(error).__name__}: {error}", notes
                wait = min(self.initial_delay * self.backoff ** (attempt - 1), self.max_delay)
                notes.append(f"Retry {attempt}/{self.attempts} in {wait:.0f}s ({type(error).__name__})")
                self.sleep(wait)
        raise ValueError("a call needs one attempt at least")


#: Columns that a call adds: its result, how often it was tried, why it failed for good, and a note for each wait.
OUTCOME = "attempts int, error string, notes array<string>"


def called(rows: DataFrame, argument: str, function: Callable[[Any], Any], result: str = "content", kind: str = "string", retry: Retry | None = None) -> DataFrame:
    """``rows`` with ``result`` (``kind``), and ``OUTCOME``: ``function`` of each row's ``argument``, tried again in its task.

    A task that is lost runs its calls again; write the outcome to a table before reading it twice.
    """
    policy = retry or Retry()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outcomes = [policy.call(function, value) for value in batch[argument].to_pylist()]
            kinds = (None, pa.int32(), pa.string(), pa.list_(pa.string()))
            for i, (name, type_) in enumerate(zip((result, "attempts", "error", "notes"), kinds, strict=True)):
                batch = batch.append_column(name, pa.array([o[i] for o in outcomes], type_ or {"string": pa.string()}.get(kind)))
            yield batch

    return rows.mapInArrow(run, f"{fields}, `{result}` {kind}, {OUTCOME}")


def delivered(outcome: DataFrame) -> DataFrame:
    """The rows whose call came to a result."""
    return outcome.filter("error is null").drop("attempts", "error", "notes")


def dead_letters(outcome: DataFrame) -> DataFrame:
    """The rows whose call failed for good, with the error and the number of attempts."""
    return outcome.filter("error is not null").drop("notes")


def status_rows(outcome: DataFrame, *keys: str) -> DataFrame:
    """``keys, step, status, status_description, retrying``: what a watcher sees of each call, in order."""
    last = F.struct(F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), F.col("error").alias("status_description"))
    waits = F.transform("notes", lambda n: F.struct(F.lit("running").alias("status"), n.alias("status_description")))
    rows = outcome.select(*keys, F.posexplode(F.concat(waits, F.array(last))).alias("step", "s")).select(*keys, "step", "s.*")
    return rows.withColumn("retrying", retrying(F.col("status"), F.col("status_description")))


def written_pages(prompts: DataFrame, generate: Callable[[str], str], retry: Retry | None = None) -> tuple[DataFrame, DataFrame]:
    """Page texts of ``prompts`` (``repo_id, slug, title, prompt``) as ``content``, and the dead letters; the outcome is stored once."""
    work = Workspace(prompts.sparkSession, "calls")
    outcome = work.save(called(prompts.select("repo_id", "slug", "title", "prompt"), "prompt", generate, retry=retry), "outcome")
    return delivered(outcome).drop("prompt"), dead_letters(outcome)
