"""Queries that run a stream over the given tables to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..shared import shared_folder
from ..sources import pages
from ..streaming import tasks
from .base import query, table

#: What events of users mean as those of a queue's tasks, and the seconds after which a run is cut off.
KINDS = {"signup": "queued", "view": "queued", "click": "started", "error": "failed", "purchase": "completed"}
TIMEOUT = 6 * 3600


@query()
def task_lifecycles(spark, sf_dir):
    """Transitions of tasks, a user each, of a stream over all events; held against a loop in the tests."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    kind = F.coalesce(*(F.when(F.col("event_type") == e, k) for e, k in KINDS.items()))
    changes = tasks.transitions(stream.withColumn("kind", kind), TIMEOUT, task="user_id", number="event_id")
    folder, log = shared_folder(spark, "transitions"), shared_folder(spark, "transitions-log")
    changes.writeStream.format("parquet").option("path", folder).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(changes.schema).parquet(folder)


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS at, event_type, value, props FROM events WHERE event_type <> 'view'")
def logged_events(spark, sf_dir):
    """Events written as a log that rotates by bytes, and read back whole, but for a kind that the reader leaves out."""
    pages.register(spark)
    folder = shared_folder(spark, "log")
    events = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at"), "event_type", "value", "props")
    events.write.format("json_pages").option("rotate", 200_000).mode("append").save(folder)
    read = spark.read.format("json_pages").schema(events.schema).load(folder)
    return read.where("event_type <> 'view'")
