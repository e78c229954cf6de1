"""Data flow across functions against a search from each source, and counts of shared lines against all pairs."""

import random

from pyspark.sql import functions as F

from sparkquarry.operators import dataflow as D
from sparkquarry.operators import taint

CODE = """contract A { uint total;
 function enter(uint amount, address to) external { uint x = amount + 1; first(x, 2); }
 function first(uint a, uint b) internal { second(a, wrap(b)); }
 function second(uint c, uint d) private { total = c; if (d > 0) { first(d, c); } to.transfer(c); }
 function wrap(uint w) internal returns (uint) { return w; }
 function later(address to) public { uint y = wrap(msg.value); to.call{value: total}(""); selfdestruct(y); }
 function safe(uint z) public { uint q = z; /* to.transfer(q) */ log("to.transfer(z)"); }
 function lone(uint n) public { lone(n); }
}"""


def test_flows(spark):
    files = spark.createDataFrame([(1, CODE), (2, CODE.replace("to.transfer(c)", "")), (3, ""), (4, None)], "file_id long, content string")
    rows = {(r["file_id"], r["function"], r["variable"], r["sink_function"], r["vulnerability"]): r["path"] for r in D.flows_across(files).collect()}
    want = {
        ("enter", "amount", "second", "reentrancy"): ["enter.amount", "enter.x", "first.a", "second.c"],
        ("enter", "amount", "later", "reentrancy"): ["enter.amount", "enter.x", "first.a", "second.c", ".total"],
        ("enter", "amount", "later", "code_injection"): None,
        ("later", "msg.value", "later", "contract_destruction"): ["later.msg.value", "later.y"],
        ("later", "to", "later", "reentrancy"): ["later.to"],
    }
    assert all(rows.get((1, *key)) == path for key, path in want.items())
    assert {k[1] for k in rows} == {"enter", "later"}  # neither what is in strings and comments, nor a call that only recurs
    assert (2, "enter", "amount", "second", "reentrancy") not in rows and (2, "enter", "amount", "later", "reentrancy") in rows
    inner = {(r["function"], r["variable"]) for r in D.summaries(files).where("file_id = 1 and not open and sink_function = 'second'").collect()}
    assert inner >= {("first", "a"), ("first", "b"), ("second", "c"), ("second", "d"), ("wrap", "w")}


def test_reaching(spark):
    rng = random.Random(8)
    nodes = [f"n{i}" for i in range(25)]
    edges = [(g, rng.choice(nodes), rng.choice(nodes)) for g in (1, 2) for _ in range(45)]
    ends = [(1, "n3", "x"), (1, "n4", "x"), (1, "n5", "y"), (2, "n3", "x")]
    found = D.reaching(spark.createDataFrame(edges, "g int, v string, to_v string"), spark.createDataFrame(ends, "g int, v string, sink string"), ["g"], ["v"], ["to_v"], ["sink"])
    got = {(r["g"], r["v"], r["sink"]): (r["steps"], r["path"]) for r in found.collect()}
    want = {}
    for g, start, sink in ends:
        level, seen = {start: [start]}, {}
        while level:
            seen |= level
            after = {}
            for h, a, b in edges:
                if h == g and b in level and a not in seen:
                    after[a] = min(after.get(a, ["~"]), [a, *level[b]])
            level = after
        for v, path in seen.items():
            key = (g, v, sink)
            want[key] = min(want.get(key, (99, [])), (len(path) - 1, path))
    assert got == want


def test_shared_before(spark):
    rng = random.Random(1)
    rows = [(rng.randint(1, 3), i, *(rng.randint(1, 12) for _ in range(3))) for i in range(200)]
    df = spark.createDataFrame(rows, "file int, n int, a int, b int, c int").repartition(3)
    got = {r["n"]: r["shared"] for r in taint.shared_before(df, ["file"], ["n"], ["a", "b", "c"]).collect()}
    assert got == {x[1]: sum(y[0] == x[0] and y[1] < x[1] and bool({*y[2:]} & {*x[2:]}) for y in rows) for x in rows}


def test_empty(spark):
    none = spark.createDataFrame([], "file_id long, content string")
    assert D.flows_across(none).count() == 0 and D.statements(none).select(F.col("at")).count() == 0
