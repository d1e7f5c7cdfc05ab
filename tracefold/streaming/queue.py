"""A work queue as a stream with state: tasks that are asked for, claimed, finished or failed, with leases that run out and
retries that wait, timed by the events themselves."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracefold.operators.incremental import LEASE_MINUTES, MAX_ATTEMPTS, RETRY_MINUTES

STATE = (
    T.StructType().add("status", T.StringType()).add("attempts", T.IntegerType()).add("priority", T.IntegerType()).add("not_before", T.LongType())
    .add("lease_until", T.LongType()).add("at", T.LongType()).add("changes", T.LongType())
)
OUT = T.StructType([T.StructField("task", T.StringType()), *STATE.fields])
FIELDS = STATE.names
#: Moments are milliseconds, so that no time zone plays a part.
MINUTE, MOMENTS = 60_000, ("not_before", "lease_until", "at")
#: What a task is before anything is known of it.
NEW = {"status": None, "attempts": 0, "priority": 0, "not_before": None, "lease_until": None, "at": None, "changes": 0}


def failed(task: dict, at: int) -> dict:
    """One attempt more has failed: queued again after a wait, or given up at the last."""
    attempts = task["attempts"] + 1
    again = attempts < MAX_ATTEMPTS
    wait = MINUTE * RETRY_MINUTES[min(attempts, len(RETRY_MINUTES)) - 1]
    return task | {"status": "queued" if again else "failed", "attempts": attempts, "not_before": at + wait if again else None, "lease_until": None, "at": at}


def expired(task: dict, now: int) -> dict:
    """The task at a moment: a lease that is over by then has failed when it ended."""
    over = task["status"] == "running" and task["lease_until"] <= now
    return failed(task, task["lease_until"]) | {"changes": task["changes"] + 1} if over else task


def step(task: dict, kind: str, at: int, priority: int | None) -> dict:
    """The task after one event; events that its state does not allow, and those from before its last change, change nothing."""
    task = expired(task, at)
    if task["at"] is not None and at < task["at"]:
        return task
    status, after = task["status"], None
    if kind == "ask":
        if status in ("queued", "running"):
            after = task | {"priority": max(task["priority"], priority or 0)}
        else:
            after = NEW | {"status": "queued", "priority": priority or 0, "changes": task["changes"]}
    elif kind == "claim" and status == "queued" and (task["not_before"] is None or task["not_before"] <= at):
        after = task | {"status": "running", "not_before": None, "lease_until": at + MINUTE * LEASE_MINUTES}
    elif kind == "done" and status == "running":
        after = task | {"status": "done", "lease_until": None}
    elif kind == "fail" and status == "running":
        after = failed(task, at)
    return task if after is None else after | {"at": at, "changes": task["changes"] + 1}


class Queue(StatefulProcessor):
    """One task a key. A timer stands at the end of each lease, so a lease runs out without any event for its task."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("task", STATE)

    def _read(self) -> dict:
        return dict(zip(FIELDS, self.state.get(), strict=True)) if self.state.exists() else dict(NEW)

    def _write(self, key: Any, before: dict, after: dict) -> Iterator[Row]:
        for lease in {before["lease_until"]} - {after["lease_until"], None}:
            self.handle.deleteTimer(lease)
        if after["lease_until"] is not None and after["lease_until"] != before["lease_until"]:
            self.handle.registerTimer(after["lease_until"])
        if after["changes"] != before["changes"]:
            self.state.update(tuple(after[f] for f in FIELDS))
            yield Row(task=key[0], **after)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = after = self._read()
        for r in sorted(rows, key=lambda r: (r.ms, r.tie)):
            after = step(after, r.kind, r.ms, r.priority)
        yield from self._write(key, before, after)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        before = self._read()
        yield from self._write(key, before, expired(before, expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


def queue_states(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of the tasks that change: task, status, attempts, priority, not_before, lease_until, at, changes.

    events: a stream of task, kind (ask, claim, done, fail), at, priority, tie. The state of a task is one row, kept by the
    state store (RocksDB is needed); what comes later than `late` is left out. The latest state of a task is the row of most
    changes.
    """
    held = events.select(F.col("task").cast("string").alias("task"), "kind", F.col("at").cast("timestamp").alias("at"), F.unix_millis(F.col("at").cast("timestamp")).alias("ms"), F.col("priority").cast("int").alias("priority"), F.col("tie").cast("long").alias("tie"))
    states = held.withWatermark("at", late).groupBy("task").transformWithState(Queue(), OUT, "Update", "EventTime")
    return states.withColumns({c: F.timestamp_millis(c) for c in MOMENTS})


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest(changes: DataFrame) -> DataFrame:
    """The state of each task, of all changes that were written."""
    return changes.groupBy("task").agg(F.max_by(F.struct(*FIELDS), "changes").alias("s")).select("task", "s.*")
