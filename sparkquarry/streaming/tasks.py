"""Tasks of a queue as state machines over a stream of their events, with retries and timeouts by event time.

``transitions`` gives a row for each change of a task's status: queued, running, retried, completed, failed. A run that isn't over
after ``timeout`` seconds of event time is cut off there by a timer that the watermark fires, or by the next event of the task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..ship import to_workers

#: Class of Spark's store that keeps the state of streams with timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "task_id {kind}, at long, status string, attempts int, reason string"

#: (status, attempts, since when it runs, last time handled) in microseconds, before any event.
NEW = (None, 0, 0, -(1 << 62))


def ended(state: tuple, at: int, reason: str, retries: int) -> tuple[tuple, tuple]:
    """State and transition when a run ends without success: another try, up to ``retries`` after the first."""
    status = "retried" if state[1] <= retries else "failed"
    return (status, state[1], 0, max(at, state[3])), (at, status, state[1], reason)


def advanced(state: tuple, at: int, kind: str | None, timeout: int, retries: int) -> tuple[tuple, list[tuple]]:
    """State after an event, or after the mere passing of time without a kind, and the transitions on the way.

    ``queued`` counts for new and ended tasks, ``started`` for waiting ones, ``failed`` and ``completed`` for running ones; other events are
    passed over, and so are events before the last one handled.
    """
    out = []
    if at < state[3]:
        return state, out
    if state[0] == "running" and at >= state[2] + timeout:
        state, made = ended(state, state[2] + timeout, "timeout", retries)
        out.append(made)
    status, attempts, since, _ = state
    if kind == "queued" and status in (None, "completed", "failed"):
        status, attempts = "queued", 0
    elif kind == "started" and status in ("queued", "retried"):
        status, attempts, since = "running", attempts + 1, at
    elif kind == "completed" and status == "running":
        status = "completed"
    elif kind == "failed" and status == "running":
        state, made = ended(state, at, "failure", retries)
        return state, [*out, made]
    if (status, attempts) != state[:2]:
        out.append((at, status, attempts, kind))
    return (status, attempts, since, max(at, state[3]) if kind else state[3]), out


class Lifecycle(StatefulProcessor):
    def __init__(self, timeout: float, retries: int) -> None:
        self.timeout, self.retries = int(timeout * 1e6), retries

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", "status string, attempts int, since long, seen long")

    def _now(self) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else NEW

    def _keep(self, state: tuple) -> None:
        """The state, and one timer while the task runs."""
        self.state.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if state[0] == "running":
            self.handle.registerTimer(-(-(state[2] + self.timeout) // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self._now()
        for at, _, kind in sorted((r["at"], r["n"], r["kind"]) for r in rows):  # what one task has in one trigger
            state, made = advanced(state, at, kind, self.timeout, self.retries)
            for transition in made:
                yield Row(task_id=key[0], **dict(zip(("at", "status", "attempts", "reason"), transition)))
        self._keep(state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, made = advanced(self._now(), expiredTimerInfo.getExpiryTimeInMs() * 1000, None, self.timeout, self.retries)
        for transition in made:
            yield Row(task_id=key[0], **dict(zip(("at", "status", "attempts", "reason"), transition)))
        self._keep(state)

    def close(self) -> None:
        pass


def transitions(events: DataFrame, timeout: float, retries: int = 2, late: str = "1 hour", task: str = "task_id", at: str = "ts", kind: str = "kind", number: str | None = None) -> DataFrame:
    """(task_id, at, status, attempts, reason), a streaming frame of the changes of each task of a stream of events.

    Events are taken in order of time, equal times by ``number`` or kind, within a trigger. Events later than ``late`` behind the newest
    are dropped by the watermark, and so are events before the last one that their task has had in an earlier trigger.
    """
    spark = events.sparkSession
    to_workers(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    order = {"queued": 0, "started": 1, "failed": 2, "completed": 3}
    rank = F.coalesce(*(F.when(F.col(kind) == k, i) for k, i in order.items()), F.lit(9)).cast("long")
    given = events.select(F.col(task).alias("task_id"), F.col(at).cast("timestamp").alias("time"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(kind).alias("kind"), (F.col(number).cast("long") if number else rank).alias("n"))
    known = given.where("task_id is not null and time is not null and kind is not null").withWatermark("time", late)
    made = known.groupBy("task_id").transformWithState(Lifecycle(timeout, retries), SCHEMA.format(kind=given.schema["task_id"].dataType.simpleString()), "Append", "EventTime")
    return made.withColumn("at", F.timestamp_micros("at"))


def latest(changes: DataFrame) -> DataFrame:
    """(task_id, status, attempts, at, failures): the last status of each task in a table of transitions, and how many runs failed."""
    return changes.groupBy("task_id").agg(F.max_by("status", F.struct("at", "attempts")).alias("status"), F.max_by("attempts", F.struct("at", "attempts")).alias("attempts"), F.max("at").alias("at"), F.count_if(F.col("reason").isin("failure", "timeout")).alias("failures"))
