"""Paged records over HTTP and logs that rotate, against the records themselves."""

import json
import os
import threading
from functools import partial
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from sparkquarry.sources import pages

RECORDS = [{"number": i, "title": f"t{i}", "state": "open" if i % 3 else "closed", "body": None if i % 5 == 0 else f"b\n{i}", "updated_at": f"2024-01-{i % 28 + 1:02d}", "labels": [{"name": n} for n in ("bug", "ui")[: i % 3]]} for i in range(95)]


class Server(BaseHTTPRequestHandler):
    def __init__(self, asked, *args):
        self.asked = asked
        super().__init__(*args)

    def do_GET(self):
        query = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        self.asked.append(query)
        page, size = int(query["page"]), 20
        self.send_response(200)
        self.send_header("Link", f'<http://x/?page=2>; rel="next", <http://x/?q=1&page={-(-len(RECORDS) // size)}>; rel="last"')
        self.end_headers()
        self.wfile.write(json.dumps(RECORDS[(page - 1) * size : page * size]).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def served():
    asked = []
    server = HTTPServer(("127.0.0.1", 0), partial(Server, asked))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/issues?page={{page}}", asked
    server.shutdown()


def test_pages(spark, served):
    url, asked = served
    pages.register(spark)
    df = spark.read.format("json_pages").option("url", url).load()
    rows = {r["number"]: r for r in df.collect()}
    assert rows.keys() == {r["number"] for r in RECORDS} and rows[4]["labels"] == ["bug"] and rows[5]["body"] is None
    assert df.rdd.getNumPartitions() == 5 and {int(q["page"]) for q in asked} == {1, 2, 3, 4, 5}
    asked.clear()
    some = df.where("state = 'open' and updated_at >= '2024-01-15' and number % 2 = 0")
    want = {r["number"] for r in RECORDS if r["state"] == "open" and r["updated_at"] >= "2024-01-15" and r["number"] % 2 == 0}
    assert {r["number"] for r in some.collect()} == want
    assert any(q.get("since") == "2024-01-15" for q in asked)  # the condition went to the server
    both = spark.read.format("json_pages").options(url=url, labels="bug,ui", since="2024-01-10", limit=2).load()
    found = [r["number"] for r in both.collect()]
    assert 0 < len(found) <= 10 and all(n % 3 == 2 and n % 28 >= 9 for n in found)


def test_logs(spark, tmp_path):
    pages.register(spark)
    folder = str(tmp_path / "logs")
    df = spark.range(1000).select("id", F.concat(F.lit("é "), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int"))).alias("text"), F.when(F.col("id") % 2 == 0, 0.5).alias("v")).repartition(3)
    df.write.format("json_pages").option("rotate", 5000).mode("append").save(folder)
    sizes = [os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder)]
    assert len(sizes) > 8 and max(sizes) <= 5000 and not any(f.startswith("_") for f in os.listdir(folder))
    read = lambda: spark.read.format("json_pages").schema("id long, text string, v double").load(folder)
    assert sorted(map(tuple, read().collect())) == sorted(map(tuple, df.collect()))
    before = sorted(os.listdir(folder))
    bad = df.withColumn("v", F.when(F.col("id") == 777, F.raise_error(F.lit("stop"))).otherwise(1.0))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("json_pages").option("rotate", 500).mode("append").save(folder)
    assert [f for f in sorted(os.listdir(folder)) if not f.startswith("_")] == before  # nothing of the failed write can be read
    assert read().count() == 1000
    df.limit(10).write.format("json_pages").mode("overwrite").save(folder)
    assert read().count() == 10
    assert spark.read.format("json_pages").schema("id long").load(str(tmp_path / "none")).count() == 0
