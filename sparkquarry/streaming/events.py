"""Streaming forms over event tables: tumbling counts, sessions, and latest state of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time_col: str = "ts", key: str = "event_type") -> DataFrame:
    """Works on streams and tables: rows later than the watermark are dropped on streams only."""
    stamped = events.withColumn("__t", F.col(time_col).cast("timestamp")).withWatermark("__t", late)
    return stamped.groupBy(F.window("__t", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes", time_col: str = "ts", key: str = "user_id") -> DataFrame:
    stamped = events.withColumn("__t", F.col(time_col).cast("timestamp")).withWatermark("__t", late)
    return stamped.groupBy(F.session_window("__t", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def task_states(events: DataFrame, key: str = "task_id", status: str = "status", at: str = "ts") -> DataFrame:
    """Latest status of each task and its number of failures, as a streaming or batch aggregate."""
    return events.groupBy(key).agg(F.max_by(status, at).alias("status"), F.count_if(F.col(status) == "failed").alias("failures"), F.max(at).alias("updated"))


def progress(events: DataFrame, key: str = "task_id", at: str = "ts", done: str = "done", total: str = "total") -> DataFrame:
    """(key, completed, total, seconds, left): completions so far, and the seconds left at the rate since the first event; a streaming or batch aggregate."""
    seconds = (F.max(F.unix_micros(F.col(at).cast("timestamp"))) - F.min(F.unix_micros(F.col(at).cast("timestamp")))) / 1e6
    out = events.groupBy(key).agg(F.sum(done).alias("completed"), F.max(total).alias("total"), seconds.alias("seconds"))
    return out.withColumn("left", F.try_divide((F.col("total") - F.col("completed")) * F.col("seconds"), F.col("completed")))


def workflow(states: DataFrame, steps: list[str], key: str = "project") -> DataFrame:
    """(key, step): the first step of a workflow that is not completed, null when all are; ``states``: key, step, status."""
    order = F.array(*map(F.lit, steps))
    done = states.groupBy(key).agg(F.collect_set(F.when(F.col("status") == "completed", F.col("step"))).alias("done"))
    return done.select(key, F.try_element_at(F.array_except(order, "done"), F.lit(1)).alias("step"))


def waited(states: DataFrame, now, timeout: float, key: str = "task_id", started: str = "started", status: str = "status") -> DataFrame:
    """Tasks with ``waiting``: done, waiting, or timed_out after so many seconds."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(started).cast("timestamp"))) / 1e6
    return states.withColumn("waiting", F.when(F.col(status).isin("completed", "failed"), "done").when(age > timeout, "timed_out").otherwise("waiting"))
