import json
import random

import pytest
from pyspark.sql import functions as F

from sparkquarry.functions import code as C
from sparkquarry.functions import text as T
from sparkquarry.operators import chunking, graph, intervals
from sparkquarry.plans import pipeline
from sparkquarry.sources import readers


def test_sliding_windows_match_a_loop(spark):
    texts = [(i, "x" * n) for i, n in enumerate((0, 1, 3, 10, 11, 17, 30))]
    for size, overlap in ((10, 3), (5, 0), (4, 3)):
        got = {}
        for r in chunking.sliding(spark.createDataFrame(texts, "id int, text string"), size=size, overlap=overlap).collect():
            got.setdefault(r["id"], []).append((r["chunk_start"], r["chunk_end"]))
        for i, text in texts:
            want, at = [], 0
            while text and (at == 0 or at < len(text) - overlap):
                want.append((at, min(at + size, len(text))))
                at += size - overlap
            assert sorted(got.get(i, [])) == want
    with pytest.raises(ValueError):
        chunking.sliding(spark.range(1), size=3, overlap=3)


def test_binned_overlap_join_matches_brute_force(spark):
    draw = random.Random(1)
    rows = lambda n: [(draw.choice("fg"), i, s := draw.randrange(60), s + draw.randrange(25)) for i in range(n)]
    a, b = rows(40), rows(40)
    left, right = spark.createDataFrame(a, "f string, a int, s int, e int"), spark.createDataFrame(b, "f string, b int, bs int, be int")
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])
    for bins in (None, 7):
        got = intervals.overlap_join(left, right, ["f"], "s", "e", "bs", "be", bin_size=bins).select("a", "b").collect()
        assert sorted(map(tuple, got)) == want


def test_reachability_matches_search(spark):
    draw = random.Random(2)
    edges = {(draw.randrange(12), draw.randrange(12)) for _ in range(18)}
    got = {tuple(r) for r in graph.reachable(spark.createDataFrame(list(edges), "src int, dst int"), 3).collect()}
    want = {}
    for start in range(12):
        level, depth = {start}, 0
        while level and depth < 3:
            depth += 1
            level = {d for s, d in edges if s in level}
            for node in level:
                want.setdefault((start, node), depth)
    assert got == {(s, d, n) for (s, d), n in want.items()}


def test_packing_and_scopes():
    assert chunking.pack_lines("aa\nbb\ncc\ndd", 6, 1) == ["aa\nbb", "bb\ncc", "cc\ndd"]
    assert chunking.pack_lines("", 5, 0) == []
    assert "".join(chunking.split_at_delimiters("ab;cdefgh\nij", 5)) == "ab;cdefgh\nij"
    (kind, name, start, end, code), *rest = chunking.scopes("// x\ncontract A is B {\n function f() { if (x) { y(); } }\n}\ncontract C { ")
    assert (kind, name, start, end) == ("contract", "A", 2, 4) and code.endswith("}") and rest[0][1] == "C"


def test_readers(spark, tmp_path):
    (tmp_path / "a.sol").write_text("contract A {}")
    (tmp_path / "ERC20.sol").write_bytes(b"bad \xff byte")
    got = {r["name"]: r for r in readers.files(spark, str(tmp_path), "*.sol", exclude=[r"ERC\d{2,}"]).collect()}
    assert set(got) == {"a.sol"} and got["a.sol"]["is_source"] and got["a.sol"]["language"] == "solidity"
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(r["a"] for r in readers.jsonl(spark, str(tmp_path / "x.jsonl"), "a long").collect()) == [1, 2]
    (tmp_path / "x.json").write_text(json.dumps({"items": [{"id": "p", "text": "t"}]}))
    assert readers.json_items(spark, str(tmp_path / "x.json")).collect()[0]["id"] == "p"
    (tmp_path / "x.csv").write_text("Name,body,other\nn,b,o\n,,\n")
    (row,) = readers.csv_documents(spark, str(tmp_path / "x.csv")).collect()
    assert row["doc_title"] == "n" and row["doc_content"] == "body: b"


def test_pipeline_keeps_going_after_an_optional_failure(spark):
    def fails(df):
        raise ValueError("no")

    run = pipeline.Pipeline().add("a", lambda d: d.where("id > 2")).add("b", fails, required=False)
    assert run.run(spark.range(5)).count() == 2
    assert [e[2].split(":")[0] for e in run.events] == ["completed", "failed"]


def test_text_functions(spark):
    df = spark.createDataFrame([("f.sol:3-9", None), ("f.sol:7", "Odd"), ("bad", "High")], "loc string, severity string")
    start, end = T.location(F.col("loc"))
    assert [tuple(r) for r in df.select(start, end, T.severity_rank(F.col("severity"))).collect()] == [(3, 9, 3), (7, 7, 99), (None, None, 1)]
    code = spark.createDataFrame([("function f(uint a) external view returns (uint) { return g(a); }",)], "content string")
    (row,) = C.functions(code).collect()
    assert (row["name"], row["visibility"], row["is_view"], row["is_payable"]) == ("f", "external", True, False)


def test_equal_sets_are_compared_once(spark):
    from sparkquarry.operators import retrieval

    sets = spark.createDataFrame([(i, [i % 3, 7, 8]) for i in range(60)] + [(60, [1, 1, 7]), (61, [])], "id int, items array<int>")
    got = retrieval.set_matches(sets.where("id % 10 = 0"), sets, 0.6, "id", "id", "items")
    rows = {r["id"]: set(r["items"]) for r in sets.collect()}
    want = {(a, b) for a in rows for b in rows if a % 10 == 0 and rows[a] and len(rows[a] & rows[b]) >= 0.6 * len(rows[a] | rows[b])}
    pairs = [(r["query_id"], r["row_id"]) for r in got.collect()]
    assert set(pairs) == want and len(pairs) == len(want)
    # what meets by items isn't made distinct by pairs of ids, which would shuffle it
    assert "Aggregate [query_id" not in got._jdf.queryExecution().optimizedPlan().toString().replace("row_id", "query_id").split("Join", 1)[0]


def test_top_rows_hold_a_bounded_number_of_scores(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from sparkquarry.operators import retrieval

    draw = np.random.default_rng(2)
    rows = draw.integers(-2, 3, (500, 4)).astype(float)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 100)), pa.array(rows[i : i + 100].tolist())], names=["id", "v"]) for i in range(0, 500, 100)]
    want = sorted(zip(*(x.tolist() for x in retrieval.top_scores(np.arange(500), rows, rows[:30], 7, 6))))
    seen, scored = [], retrieval.top_scores
    monkeypatch.setattr(retrieval, "CELLS", 600)
    monkeypatch.setattr(retrieval, "top_scores", lambda ids, *a: seen.append(len(ids) * 30) or scored(ids, *a))
    out = list(retrieval._matcher(np.arange(30), rows[:30], 7, 6)(iter(batches)))
    assert len(out) == 1 and max(seen) <= 600
    assert sorted(zip(*(c.to_pylist() for c in out[0].columns))) == want


def test_only_what_may_be_among_the_best_is_scored(monkeypatch):
    """Rows that cannot be among a query's best are screened out, copies of a row and vectors of zeros are not."""
    import numpy as np
    import pyarrow as pa

    from sparkquarry.operators import retrieval

    rng = np.random.default_rng(5)
    rows = rng.normal(size=(4000, 8))
    rows[::50], rows[7] = rows[3], 0
    queries = np.concatenate([rows[:20], np.zeros((1, 8))])
    scores = np.floor(np.nan_to_num(rows @ queries.T / np.maximum(np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(queries, axis=1), 1e-300)) * 1e6 + 0.5) / 1e6
    want = sorted((q, i, scores[i, q]) for q in range(21) for i in np.lexsort((np.arange(4000), -scores[:, q]))[:3])
    seen, scored = [], retrieval.top_scores
    monkeypatch.setattr(retrieval, "CELLS", 21 * 100)
    monkeypatch.setattr(retrieval, "top_scores", lambda ids, r, q, *a: seen.append(len(ids) * len(q)) or scored(ids, r, q, *a))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4000)), pa.array(list(rows))], names=["id", "v"])
    (out,) = retrieval._matcher(np.arange(21), queries, 3, 6)(iter([batch]))
    assert sorted(zip(*(c.to_pylist() for c in out.columns))) == want and sum(seen) < 21 * 4000 / 2


def test_texts_are_embedded_once_whatever_the_blocks_of_queries(spark, monkeypatch):
    from pyspark.sql import functions as F

    from sparkquarry.operators import knowledge, retrieval

    texts = spark.createDataFrame([(i, f"word{i % 7} other{i % 5} Word{i}") for i in range(60)], "id long, text string")
    calls, asked = spark.sparkContext.accumulator(0), texts.where("id < 12").withColumnRenamed("id", "query_id")

    def counting(t):
        @F.pandas_udf("array<double>")
        def f(values):
            calls.add(len(values))
            return values.map(lambda x: [float(len(x)), float(x.count("1")), 1.0])

        return f(t)

    found = {}
    for block in (2000, 3):
        monkeypatch.setattr(retrieval, "BLOCK", block)
        before = calls.value
        store = knowledge.embedded(texts, counting)
        found[block] = sorted(map(tuple, knowledge.search_texts(asked, store, 3, counting).collect()))
        assert calls.value - before <= 60 + 12
    assert found[3] == found[2000] and len(found[3]) == 36


def test_set_matches_in_blocks_and_parts(spark, monkeypatch):
    from sparkquarry.operators import retrieval

    r = random.Random(8)
    made = [(i, [r.choice(["a", "b", "c", "d", "e", "f", "g", "h", None]) for _ in range(r.randint(0, 7))] if r.random() > 0.05 else None) for i in range(240)] + [(i, ["a"]) for i in range(240, 300)]
    want = set()
    for i, a in made[::3]:
        for j, b in made:
            x, y = set(a or ()), set(b or ())
            n = len((x & y) - {None})
            if n and n / (len(x) + len(y) - n) >= 0.4:
                want.add((i, j, round(n / (len(x) + len(y) - n), 3)))
    rows = spark.createDataFrame(made, "id int, items array<string>")
    asked = rows.where("id % 3 = 0")
    for sizes in ({}, {"ASKED": 40, "PAIRS": 50, "GIVEN": 7}):
        for k, v in sizes.items():
            monkeypatch.setattr(retrieval, k, v)
        got = retrieval.set_matches(asked, rows, 0.4, "id", "id", "items", digits=3)
        assert sorted(tuple(x) for x in got.collect()) == sorted(want)
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # pairs are made where they are counted
    assert retrieval.set_matches(asked.limit(0), rows, 0.4, "id", "id", "items").count() == 0
