"""The stream of task transitions against a loop over the events."""

import random

from pyspark.sql import functions as F

from sparkquarry.plans import streams
from sparkquarry.streaming import tasks


def walk(events, timeout, retries, until):
    """Transitions of one task: events are (seconds, kind) in order; ``until`` is how far the watermark got."""
    out, status, attempts, since = [], None, 0, None

    def end(at, reason):
        nonlocal status
        status = "retried" if attempts <= retries else "failed"
        out.append((at, status, attempts, reason))

    for at, kind in [*events, (None, None)]:
        if status == "running" and (at is not None and at >= since + timeout or at is None and since + timeout <= until):
            end(since + timeout, "timeout")
        if kind == "queued" and status in (None, "completed", "failed"):
            status, attempts = "queued", 0
            out.append((at, status, 0, kind))
        elif kind == "started" and status in ("queued", "retried"):
            status, attempts, since = "running", attempts + 1, at
            out.append((at, status, attempts, kind))
        elif kind == "completed" and status == "running":
            status = kind
            out.append((at, status, attempts, kind))
        elif kind == "failed" and status == "running":
            end(at, "failure")
    return out


def test_stream(spark, tmp_path):
    """Files arrive in order of time, one a trigger; the last moves the watermark past all timers."""
    rng = random.Random(12)
    events, at = [], 0
    for _ in range(600):
        at += rng.randint(1, 40)
        events.append((rng.randint(1, 12), at, rng.choice(["queued", "started", "started", "failed", "completed", "other"])))
    last = at + 100_000
    parts = [events[i : i + 150] for i in range(0, 600, 150)] + [[(99, last, "queued")]]
    for i, part in enumerate(parts):
        folder = str(tmp_path / "in" / f"{i}")
        spark.createDataFrame(part, "task_id int, s long, kind string").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("task_id int, s long, kind string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    changes = tasks.transitions(stream, 300, 1, "10 seconds")
    query = changes.writeStream.format("memory").queryName("task_changes").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(150)
    got = {}
    for r in spark.table("task_changes").selectExpr("task_id", "unix_seconds(at) as s", "status", "attempts", "reason").collect():
        got.setdefault(r["task_id"], []).append(tuple(r)[1:])
    want = {t: w for t in {e[0] for e in [*events, (99, 0, "")]} if (w := walk([(s, k) for i, s, k in [*events, (99, last, "queued")] if i == t], 300, 1, last - 10))}
    assert {t: sorted(v) for t, v in got.items()} == {t: sorted(v) for t, v in want.items()}
    assert {"timeout", "failure"} <= {x[3] for v in got.values() for x in v}


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/events.parquet").selectExpr("user_id", "unix_micros(cast(ts as timestamp)) as us", "event_id", "event_type").collect()
    kinds = streams.KINDS
    newest = max(r["us"] for r in rows)
    want = []
    for user in {r["user_id"] for r in rows}:
        own = sorted((r["us"], r["event_id"], r["event_type"]) for r in rows if r["user_id"] == user)
        want += [(user, *t) for t in walk([(us, kinds.get(k, "")) for us, _, k in own], streams.TIMEOUT * 1_000_000, 2, newest - 3_600_000_000)]
    got = [tuple(r) for r in streams.task_lifecycles(spark, folder).selectExpr("task_id", "unix_micros(at) as us", "status", "attempts", "reason").collect()]
    assert sorted(got) == sorted(want) and len(got) > 20
