"""Sinks, sources, combinators, streams and chunkers against plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkquarry.functions import json as J
from sparkquarry.functions import reports as R
from sparkquarry.functions import text as T
from sparkquarry.operators import chunking, flows, graph, retrieval, windows
from sparkquarry.plans import pipeline
from sparkquarry.plans.code import WRITTEN
from sparkquarry.sources import readers
from sparkquarry.streaming import events

FINDINGS = [("b <x>", "High", "two"), ("a", "Critical", None), ("c", None, "& three"), ("d", "Odd", "")]


def findings(spark):
    return spark.createDataFrame(FINDINGS, "title string, severity string, description string")


def test_reports(spark, tmp_path):
    readers.write_report(findings(spark), f"{tmp_path}/r.json")
    assert [r["title"] for r in sorted(spark.read.json(f"{tmp_path}/r.json").collect(), key=lambda r: r["title"])] == ["a", "b <x>", "c", "d"]
    readers.write_report(findings(spark), f"{tmp_path}/audit_20240203_040506.md", "md", "Audit")
    lines = [r["text"] for r in readers.report_lines(findings(spark), "md", "Audit").orderBy("place").collect()]
    assert lines == ["# Audit", "- Critical: 1", "- High: 1", "- Medium: 0", "- Low: 1", "- Informational: 0", "- **a** (Critical): ", "- **b <x>** (High): two", "- **c** (Low): & three", "- **d** (Odd): "]
    html = [r["text"] for r in readers.report_lines(findings(spark), "html").orderBy("place").collect()]
    assert html[-3] == "<li><b>b &lt;x&gt;</b> (High): two</li>" and html[0] == "<h1>Report</h1>"
    with pytest.raises(ValueError):
        readers.write_report(findings(spark), f"{tmp_path}/x", "pdf")
    (tmp_path / "reports").mkdir()
    (tmp_path / "reports" / "audit_20240203_040506.md").write_text("\n".join(lines))
    (row,) = readers.read_reports(spark, f"{tmp_path}/reports").collect()
    assert (row["title"], str(row["reported"]), row["findings"]) == ("Audit", "2024-02-03 04:05:06", 4)


def test_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, text string, lang string")
    readers.write_families(docs, f"{tmp_path}/f", "id", {"text": ["text"], "meta": ["lang"]})
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/f/meta").collect()} == {(1, "x"), (2, "y")}
    more = spark.createDataFrame([(2, "c", "z"), (3, "d", "w"), (3, "d", "w")], docs.schema)
    assert [tuple(r) for r in readers.append_new(docs, more, ["id"]).collect()] == [(3, "d", "w")]
    assert sorted(tuple(r) for r in readers.upsert(docs, more.distinct(), ["id"]).collect()) == [(1, "a", "x"), (2, "c", "z"), (3, "d", "w")]
    prompts = spark.createDataFrame([("p", "t", "q", "x"), ("p", "u", "q", "y"), ("r", "t", None, "z")], "name string, type string, project string, text string")
    assert readers.prompts_by(prompts, name="p", kind="t").count() == 1 and readers.prompts_by(prompts).count() == 3
    readers.export_prompts(prompts.where("name = 'p'").withColumn("text", F.upper("text")), f"{tmp_path}/p")
    assert {r["text"] for r in readers.import_prompts(prompts, f"{tmp_path}/p", ["name", "type"]).collect()} == {"X", "Y", "z"}
    tree = readers.directory_tree(spark.createDataFrame([("a/b/c/d/e.sol",), ("a/b/x.sol",), ("top.sol",)], "path string"))
    assert {tuple(r) for r in tree.collect()} == {("a", 1, 2), ("a/b", 2, 2), ("a/b/c", 3, 1)}


def test_combinators(spark):
    calls = []

    def flaky(df):
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("again")
        return df.limit(1)

    df = spark.range(4)
    assert pipeline.retry(flaky)(df).count() == 1 and len(calls) == 3
    with pytest.raises(KeyError):
        pipeline.retry(lambda d: {}["x"], 1, should=lambda e: False)(df)
    assert pipeline.conditional(lambda d: "id" in d.columns, lambda d: d.limit(2))(df).count() == 2
    assert pipeline.Pipeline().add("a", lambda d: d.limit(1)).add("b", lambda d: d.limit(0)).only(exclude=["b"]).run(df).count() == 1
    chunks = spark.createDataFrame([("ab", 1), (None, 2), ("abc", 3)], "chunk string, n int")
    got = pipeline.compose(pipeline.transformers(F.upper, F.reverse), pipeline.chunk_analyzer(lambda t: str(len(t)), "n <> 3"))(chunks).collect()
    assert [(r["chunk"], r["analysis"]) for r in got] == [("BA", "2"), (None, None), ("CBA", None)]
    registry = pipeline.Registry()
    registry.register("twice_it", F.pandas_udf(lambda s: s * 2, "long"))
    registry.use(spark)
    assert spark.sql("SELECT twice_it(id) AS x FROM range(3)").agg(F.sum("x")).first()[0] == 6
    with pytest.raises(ValueError):
        registry.register("twice_it", len)
    out = pipeline.Outcome.of(int, "3").map(lambda x: x + 1)
    assert out.get() == 4 and out.flat_map(lambda x: pipeline.Outcome.of(int, "x")).recover(lambda e: 7).get() == 7
    failed = pipeline.Outcome.of(int, "x").map(lambda x: x + 1)
    assert failed.get_or_else(0) == 0
    with pytest.raises(ValueError):
        failed.get()


def test_streams(spark, tmp_path):
    rows = [("t1", "running", 1, "2024-01-01 00:00:00"), ("t1", "completed", 1, "2024-01-01 00:00:10"), ("t2", "failed", 1, "2024-01-01 00:20:00"), ("t2", "running", 0, "2024-01-01 02:00:00")]
    table = spark.createDataFrame(rows, "task_id string, status string, done int, ts string").selectExpr("task_id", "status", "done", "cast(ts as timestamp) as ts", "10 as total", "status as event_type", "1.0 as value")
    assert {tuple(r)[:3] for r in events.task_states(table).collect()} == {("t1", "completed", 0), ("t2", "running", 1)}
    assert {(r["task_id"], r["completed"], r["left"]) for r in events.progress(table).collect()} == {("t1", 2, 40.0), ("t2", 1, 54000.0)}
    table.write.parquet(f"{tmp_path}/e")
    stream = events.windowed_counts(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/e"))
    stream.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = {(r["event_type"], r["n"]) for r in spark.sql("SELECT * FROM hours").collect()}
    assert got == {(r["event_type"], r["n"]) for r in events.windowed_counts(table).collect()} == {("running", 1), ("completed", 1), ("failed", 1)}
    states = spark.createDataFrame([("p", "analysis", "completed"), ("p", "report", "open"), ("q", "analysis", "failed"), *(("r", s, "completed") for s in ("analysis", "validation", "report"))], "project string, step string, status string")
    assert {tuple(r) for r in events.workflow(states, ["analysis", "validation", "report"]).collect()} == {("p", "validation"), ("q", "analysis"), ("r", None)}
    tasks = spark.createDataFrame([(1, "completed", "2024-01-01"), (2, "running", "2024-01-01"), (3, "running", "2024-01-02")], "task_id int, status string, started string")
    assert [r["waiting"] for r in events.waited(tasks, "2024-01-02 00:00:05", 60).orderBy("task_id").collect()] == ["done", "timed_out", "waiting"]


def test_chunkers(spark):
    vault = WRITTEN[0][1]
    for limit in (60, 200, 400, 5000):
        chunks = chunking.cascade(vault, limit)
        assert chunks and all(vault.split("\n")[s - 1 : e] and (code in vault or kind == "lines") for kind, _, _, s, e, code in chunks)
        if any(len(c[-1]) > limit for c in chunks if c[0] != "lines"):
            seen = {n for c in chunks for n in range(c[3], c[4] + 1)}
            assert seen.issuperset(range(1, vault.count("\n") + 1))
        parts = chunking.hierarchy(vault, limit)
        assert all(len(code) <= limit + 1 for kind, *_, code in parts if kind not in ("contract_declaration",)) or limit < 30
        by_name = {}
        for kind, _, name, part, n, code in parts:
            if kind == "function_part":
                by_name.setdefault(name, []).append(code)
                assert 1 <= part <= n
        assert all("".join(c) in vault for c in by_name.values())
    assert chunking.cascade("", 9) == [] and chunking.cascade("no code\nhere", 100) == [("lines", None, None, 1, 2, "no code\nhere")]
    draw = random.Random(1)
    for _ in range(50):
        text = "".join(draw.choice("ab;}\n") for _ in range(draw.randrange(60)))
        for limit in (1, 3, 7):
            pieces = chunking.split_at_delimiters(text, limit)
            assert "".join(pieces) == text and all(0 < len(p) <= limit + 1 for p in pieces)
        words = " ".join(draw.choice(["One two.", "Three!", "Four five six?", "x" * 40 + "."]) for _ in range(draw.randrange(12)))
        for piece, after in zip(chunking.sentence_pieces(words, 30, 10), chunking.sentence_pieces(words, 30, 10)[1:]):
            assert len(piece) <= 41 and piece in words and after in words
    got = chunking.sentence_chunks(spark.createDataFrame([(1, "A b. C d. E."), (2, None)], "id int, text string"), 9, 4)
    assert [tuple(r) for r in got.orderBy("chunk_index").collect()] == [(1, 0, "A b. C d."), (1, 1, "C d. E.")]


def test_retrieval(spark):
    draw = random.Random(4)
    rows = [(i, [draw.gauss(0, 1) for _ in range(6)], json.dumps({"k": i % 3})) for i in range(300)] + [(300, [0.0] * 6, "{}"), (301, None, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, metadata string")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))

    def cosine(a, b):
        norms = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / norms if norms else 0.0

    for block in (2000, 1):
        retrieval.BLOCK = block
        got = {(r["query_id"], r["rank"]): r["vec_id"] for r in retrieval.search(queries, vectors, 5, {"k": 1}).collect()}
        for q in (0, 100, 200):
            best = sorted((i for i in range(300) if i % 3 == 1), key=lambda i: (-round(cosine(rows[q][1], rows[i][1]), 6), i))[:5]
            assert [got[q, r] for r in range(1, 6)] == best
    retrieval.BLOCK = 2000
    sets = spark.createDataFrame([(i, [draw.randrange(12) for _ in range(draw.randrange(6))]) for i in range(60)], "id int, items array<int>")
    given = {r["id"]: set(r["items"]) for r in sets.collect()}
    want = {(a, b) for a in given for b in given if given[a] & given[b] and len(given[a] & given[b]) >= 0.5 * len(given[a] | given[b])}
    assert {tuple(r)[:2] for r in retrieval.set_matches(sets, sets, 0.5, "id", "id", "items").collect()} == want


def test_ranks_and_paths(spark):
    draw = random.Random(6)
    rows = [(i, draw.randrange(9), draw.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g int, v double").repartition(7)
    got = {r["id"]: r["place"] for r in windows.global_rank(df, ["g", F.desc("v"), "id"]).collect()}
    assert got == {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[1], -r[2], r[0])), 1)}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("x", "y")], "src string, dst string")
    assert {tuple(r) for r in graph.reachable(edges, starts=spark.createDataFrame([("a",)], "s string")).collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("a", "a", 3)}
    assert {tuple(r["path"]) for r in graph.simple_paths(edges, "a").collect()} == {("a",), ("a", "b"), ("a", "b", "c"), ("a", "b", "d")}
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None), (5, 4)], "id int, parent int")
    assert {tuple(r) for r in graph.descendants(tree, "id", "parent").collect()} == {(1, 1, 0), (1, 2, 1), (1, 3, 2), (4, 4, 0), (4, 5, 1)}
    spans = spark.createDataFrame([("f", 1, 3), ("f", 4, 6), ("f", 9, 9)], "file string, start_line int, end_line int")
    chunks = spark.createDataFrame([("f", 1, 6), ("f", 5, 8), ("g", 1, 1)], "file string, start_line int, end_line int")
    assert {tuple(r) for r in flows.uncovered(chunks, spans, ["file"]).collect()} == {("f", 5, 8), ("g", 1, 1)}


def test_texts(spark):
    one = lambda column: spark.range(1).select(column).first()[0]
    t = F.lit("```\nraw\n``` and ~~~py\nx\n~~~")
    assert [tuple(b) for b in one(T.fenced_blocks(t))] == [("text", "raw\n"), ("py", "x\n")]
    assert one(T.arrow_paths(F.lit("a -> b0 → c1\nnone"))) == [["a", "b0", "c1"]]
    meta = F.lit('{"a": 1, "b": "x"}')
    assert [one(J.metadata_filter(meta, f, how)) for f, how in (({}, "and"), ({"a": 1, "b": "x"}, "and"), ({"a": 1, "b": "y"}, "and"), ({"a": 2, "b": "x"}, "or"))] == [True, True, False, True]
    lists = {"xs": (F.array(F.lit("p"), F.lit("q")), ())}
    assert one(R.rendered("{{#each xs}}<{{this}}{{#if on}}!{{/if}}>{{/each}}{{#if off}}no{{/if}} {{n}}", {"on": F.lit(True), "off": F.lit(""), "n": F.lit(3)}, lists)) == "<p!><q!> 3"
    with pytest.raises(ValueError):
        R.rendered("{{#if a}}", {})


def test_facts(spark, tmp_path):
    calls = spark.createDataFrame([(1, 10, 11), (2, 11, 10), (3, 12, 12)], "call_id int, caller_id int, callee_id int")
    functions = spark.createDataFrame([(10,), (12,), (13,)], "function_id int")
    assert {tuple(r) for r in flows.calls_of(functions, calls).collect()} == {(10, 1), (10, 2), (12, 3)}
    a = spark.createDataFrame([("f", 1, 5), ("g", 1, 1)], "file string, start_line int, end_line int")
    b = spark.createDataFrame([("f", 4, 9), ("f", 2, 2), ("g", 2, 3)], "file string, start_line int, end_line int")
    assert [tuple(r) for r in flows.shared_lines(a, b, "file").collect()] == [("f", [2, 4, 5])]
    risky = spark.createDataFrame([("f", 8.0, ["x", "y"]), ("f", 7.0, ["x"]), ("f", 6.9, ["z"]), ("g", 1.0, ["q"])], "file string, exploitability double, variables array<string>")
    assert [tuple(r) for r in flows.variables_at_risk(risky, "file").collect()] == [("f", ["x", "y"])]
    paths = spark.createDataFrame([("f", 7, 5, 6), ("f", 8, 6, 9), ("f", 9, 2, 3)], "file string, flow_id int, f_start int, f_end int")
    assert {(r["file"], tuple(r["flows"] or ())) for r in flows.findings_with_flows(a, paths, ["file"]).collect()} == {("f", (7, 9)), ("g", ())}
    assert [tuple(r) for r in flows.severity_summary(spark.createDataFrame([("p", "High"), ("p", "low"), ("p", None)], "p string, severity string"), "p").collect()] == [("p", 3, 1, 0, 1)]
    page = [{"number": 1, "title": "a", "state": "open", "body": None, "updated_at": "2024-01-02", "labels": [{"name": "bug"}, {"name": "x"}]}, {"number": 2, "title": "b", "updated_at": "2024-01-03", "labels": [], "pull_request": {"url": "u"}}]
    (tmp_path / "page1.json").write_text(json.dumps(page))
    got = readers.issues(spark, str(tmp_path))
    assert [(r["number"], r["is_pull"]) for r in got.collect()] == [(2, True), (1, False)]
    assert readers.issues(spark, str(tmp_path), ["bug", "x"]).count() == 1 and readers.issues(spark, str(tmp_path), since="2024-01-03", limit=5).count() == 1
    (tmp_path / "r" / ".git").mkdir(parents=True)
    (tmp_path / "r" / "a.sol").write_text("contract A {}")
    (tmp_path / "r" / ".git" / "b.sol").write_text("x")
    assert readers.repository(spark, f"{tmp_path}/r").count() == 1
