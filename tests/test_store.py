"""The project store and the text store against plain loops."""

import json

from pyspark.sql import functions as F

from sparkquarry.functions import rules
from sparkquarry.operators import knowledge
from sparkquarry.sources import store


def test_collections_logs_and_reports(spark, tmp_path):
    assert store.collections(spark, f"{tmp_path}/none") == []
    rows = [("2024-01-01 10:00:00", "r1", "p", "m", "/x", 5, None), ("2024-01-02 10:00:00", "r2", "p", "m", "/x", 7, "Timeout: late")]
    given = spark.createDataFrame(rows, "timestamp string, request_id string, provider string, model string, endpoint string, duration_ms int, error string")
    for _ in range(2):
        store.log_interactions(given, f"{tmp_path}/logs", 1)
    back = spark.read.json(f"{tmp_path}/logs")
    assert back.count() == 4 and {r["error_type"] for r in back.collect()} == {None, "Timeout"}
    assert store.collections(spark, str(tmp_path)) == ["logs"]
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "a.json").write_text(json.dumps({"findings": [{"t": 1}, {"t": 2}]}))
    (tmp_path / "out" / "a.md").write_text("# A")
    (tmp_path / "out" / "b.json").write_text("not json")
    assert {tuple(r)[:1] + tuple(r)[2:] for r in store.result_reports(spark, f"{tmp_path}/out").collect()} == {("a", 2, True), ("b", 0, False)}


def test_threats(spark, tmp_path):
    assert store.threat_patterns(spark).count() == len(store.THREATS)
    (tmp_path / "t.json").write_text(json.dumps([{"name": "n", "pattern": "x+", "severity": "low"}, {"name": "none"}]))
    assert [tuple(r) for r in store.threat_patterns(spark, f"{tmp_path}/t.json").collect()] == [("n", "x+", "low")]
    lines = spark.createDataFrame([("a.CALL(b); for (;;)",), ("plain",), (None,)], "line string")
    assert [r["threats"] for r in store.detected(lines, store.threat_patterns(spark)).collect()] == [["reentrancy", "denial of service"]]


def test_state(spark):
    files = spark.createDataFrame([(1, "a.sol", "x"), (2, "b.sol", "y")], "file_id int, path string, content string")
    one = spark.createDataFrame([(1,), (1,)], "file_id int")
    got = {r["file_id"]: json.loads(r["summary"]) for r in store.context_json(files, one, one.limit(0), one).collect()}
    assert got == {1: {"path": "a.sol", "findings": 2, "has_contracts": True, "has_functions": False}, 2: {"path": "b.sol", "findings": 0, "has_contracts": False, "has_functions": False}}
    cache = spark.createDataFrame([("k1", "v1"), ("k2", "v2")], "key string, value string")
    found, missing = store.cached(cache, spark.createDataFrame([("k1",), ("k3",), ("k3",)], "key string"), "key")
    assert found.count() == 1 and missing.count() == 2
    assert {tuple(r) for r in store.stored(cache, cache.where("key = 'k1'").withColumn("value", F.lit("new")), "key").collect()} == {("k1", "new"), ("k2", "v2")}
    good, bad = store.recovered(cache.unionByName(spark.createDataFrame([("k4", None), ("k1", "v1")], cache.schema)), ["key", "value"], "key")
    assert good.count() == 2 and [r["key"] for r in bad.collect()] == ["k4"]
    prompts = spark.createDataFrame([("a/b c", "  "), ("d.e-f", " t ")], "id string, text string")
    assert {tuple(r) for r in store.prompts_fixed(prompts).collect()} == {("a_b_c", None), ("d.e-f", "t")}
    totals = store.validation_totals(spark.createDataFrame([("f", "confirmed"), ("f", "open"), ("g", "rejected")], "file string, status string"), "file")
    assert {tuple(r) for r in totals.collect()} == {("f", 1, 0, 1, 2), ("g", 0, 1, 0, 1)}
    metrics = store.tool_metrics(spark.createDataFrame([("t", True, 10), ("t", False, 99), ("u", False, 5)], "tool string, ok boolean, duration_ms int"), "tool")
    assert {tuple(r) for r in metrics.collect()} == {("t", 2, 0.5, 10.0), ("u", 1, 0.0, 0.0)}
    assert store.overview(files=files, ones=one, none=one.limit(0)).first().asDict() == {"files": 2, "ones": 2, "none": 0}


def test_text_store(spark):
    docs = spark.createDataFrame([(1, "Reentrancy is bad. Lock it."), (2, "Lock it."), (3, "Lock it."), (4, None), (5, "Oracles give prices.")], "doc_id int, text string")
    rows = knowledge.index_rows(docs, size=12, overlap=0)
    texts = sorted((r["doc_id"], r["chunk"]) for r in rows.collect())
    assert texts == [(1, "Lock it."), (1, "Reentrancy is bad."), (5, "Oracles give prices.")]
    assert knowledge.index_rows(docs, rows).count() == 1  # the whole of the first text, of which the store has the parts alone
    saved = rows.select(F.col("digest").alias("name"), F.monotonically_increasing_id().alias("id"), F.col("chunk").alias("text"), "embedding")
    asked = spark.createDataFrame([(10, "reentrancy bad"), (11, "prices of oracles"), (12, "zzz")], "query_id long, text string")
    ranked = knowledge.search_texts(asked, saved, 2)
    best = {r["query_id"]: r["context"].split("\n")[0] for r in knowledge.context_of(ranked, saved).collect()}
    assert best[10] == "Reentrancy is bad." and best[11] == "Oracles give prices."
    parts = spark.createDataFrame([("q", 10), ("q", 12), ("r", 11)], "question string, query_id long")
    assert {tuple(r) for r in knowledge.answered(parts, ranked, 0.5).collect()} == {("q", 2, 1, 0.5), ("r", 1, 1, 1.0)}
    only = knowledge.search_texts(asked, saved, 2, patterns=["^Oracles"], path_col="text")
    assert only.select("vec_id").distinct().count() == 1
    one = knowledge.embedded(docs, F.pandas_udf(lambda s: s.map(lambda t: [float(len(t or ""))]), "array<double>"))
    assert {r["embedding"][0] for r in one.collect()} == {27.0, 8.0, 0.0, 20.0}


def test_rules(spark):
    assert rules.is_pattern("a+") and not rules.is_pattern("a(")
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, v string")
    assert [r[0] for r in df.select(rules.plain_json(F.col("v"))).collect()] == ['{"v":null}', '{"v":"x"}']
