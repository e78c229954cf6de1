"""Names in texts against all pairs, and writes by key."""

import random
import re

from sparkquarry.operators import containment, flows
from sparkquarry.sources import readers


def made(rng):
    letters = "abé \\%_😀AB"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [(i, word(rng.randint(0, 300))) for i in range(60)] + [(60, None), (None, "abab"), (61, ""), (62, "ab" * 5000), (5, "ab again")]
    names = [(i, word(rng.randint(0, 7))) for i in range(80)] + [(80, None), (None, "ab"), (81, "ab"), (81, "😀"), (82, texts[3][1][:40]), (83, "\\E.\\Q")]
    return names, texts


def test_all_pairs(spark):
    names, texts = made(random.Random(3))
    n, t = spark.createDataFrame(names, "id int, name string"), spark.createDataFrame(texts, "doc int, body string").repartition(3)
    for fold in (False, True):
        low = (lambda x: x.lower()) if fold else (lambda x: x)
        want = {(i, d) for i, a in names for d, b in texts if i is not None and d is not None and a and b and low(a) in low(b)}
        got = [tuple(r) for r in containment.holding(n, t, "id", "name", "doc", "body", ignore_case=fold).collect()]
        assert set(got) == want and len(got) == len(want)
    want = {(i, d) for i, a in names for d, b in texts if i is not None and d is not None and a and b and re.search(rf"(?<!\w){re.escape(a.lower())}(?!\w)", b.lower())}
    assert {tuple(r) for r in containment.holding(n, t, "id", "name", "doc", "body", ignore_case=True, words=True).collect()} == want
    assert containment.holding(n.limit(0), t, "id", "name", "doc", "body").count() == 0 == containment.holding(n, t.limit(0), "id", "name", "doc", "body").count()


def test_mentions(spark):
    items = spark.createDataFrame([(1, "Pay Out", None), (2, "none", "x"), (3, "a.b", "pay")], "id int, f string, c string")
    texts = spark.createDataFrame([(1, "you PAY OUT now"), (2, "repay outs"), (3, "axb a.b")], "doc int, text string")
    got = {(r["id"], r["doc"]) for r in flows.mentioned(items, texts, ["f", "c"], "id", "doc").collect()}
    assert got == {(1, 1), (3, 1), (3, 3)}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (None, "n", 0)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1), (None, "m", 1)], "k int, v string, at int")
    assert {(r["k"], r["v"]) for r in readers.upsert(old, new, ["k"], "at").collect()} == {(1, "a"), (2, "d"), (3, "e"), (None, "m")}
    assert readers.upsert(old, new, ["k"]).groupBy("k").count().where("count > 1").count() == 0


def test_expressions(spark):
    stored = spark.createDataFrame([("any", "t", "c", "x"), ("A", "t", "c", "y"), ("B", "t", "d", "z")], "contract_pattern string, type string, category string, expression string")
    contracts, existing = spark.createDataFrame([("A",), ("B",), ("C",)], "contract string"), spark.createDataFrame([("A", "t", "c")], "contract string, type string, category string")
    found = flows.new_expressions(stored, contracts, existing)
    assert {(c, r["expression"]) for c in "ABC" for r in flows.expressions_for(found, c).collect()} == {("B", "z"), ("B", "x"), ("C", "x")}
    assert "Cartesian" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()


def test_expressions_of_each_contract(spark):
    stored = spark.createDataFrame([("any", "t", "c", "x"), ("any", None, "c", "w"), ("A", "t", "c", "y"), ("B", "t", "d", "z")], "contract_pattern string, type string, category string, expression string")
    contracts, existing = spark.createDataFrame([("A",), ("B",), ("C",)], "contract string"), spark.createDataFrame([("A", "t", "c")], "contract string, type string, category string")
    found = flows.for_each_contract(flows.new_expressions(stored, contracts, existing), contracts)
    assert sorted((r["contract"], r["expression"]) for r in found.collect()) == [("A", "w"), ("B", "w"), ("B", "x"), ("B", "z"), ("C", "w"), ("C", "x")]
    assert "Cartesian" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()


def test_names_in_blocks_and_texts_in_groups(spark, monkeypatch):
    names, texts = made(random.Random(4))
    n, t = spark.createDataFrame(names, "id int, name string"), spark.createDataFrame(texts, "doc int, body string")
    want = {(i, d) for i, a in names for d, b in texts if i is not None and d is not None and a and b and a in b}
    monkeypatch.setattr(containment, "BLOCK", 30)
    got = containment.holding(n, t, "id", "name", "doc", "body")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    # texts are scanned where they are: no gram is a row
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_contracts_that_nothing_exists_for_have_no_condition(spark):
    stored = spark.createDataFrame([("any", "t", "c", "x"), ("any", "u", "c", "w"), ("any", "t", "c", "x")], "contract_pattern string, type string, category string, expression string")
    contracts = spark.createDataFrame([(f"C{i}",) for i in range(9)] + [("C8",), (None,)], "contract string")
    existing = spark.createDataFrame([("C1", "t", "c"), ("C2", "u", "c"), ("other", "t", "c")], "contract string, type string, category string")
    want = sorted((f"C{i}", e) for i in [*range(9), 8] for e in "xxw" if (i, e) not in ((1, "x"), (2, "w")))
    found = flows.for_each_contract(flows.new_expressions(stored, contracts, existing), contracts)
    assert sorted((r["contract"], r["expression"]) for r in found.collect()) == want
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert joins and not any("array_contains" in line for line in joins)
    listed = flows.for_each_contract(flows.new_expressions(stored, contracts, existing), contracts, most=2)
    assert sorted((r["contract"], r["expression"]) for r in listed.collect()) == want


def test_texts_are_given_where_they_are_found(spark, monkeypatch):
    rng = random.Random(6)
    names, texts = made(rng)
    names += [(7, "ab"), (7, "b a"), (90, "ab"), (91, "A"), (91, "B"), (91, "_😀")]
    texts += [(3, "ab A"), (3, "ab A")]
    n = spark.createDataFrame(names, "id int, name string")
    for rows, unique in ((texts, False), ([(i, b) for i, (_, b) in enumerate(texts)], True)):
        t = spark.createDataFrame(rows, "doc int, body string").repartition(3)
        want = {(i, d, b) for i, a in names for d, b in rows if i is not None and d is not None and a and b and a in b}
        for sizes in ({}, {"BLOCK": 40, "GIVEN": 5, "GIVEN_SIZE": 300}, {"BLOCK": 9}):
            with monkeypatch.context() as m:
                for k, v in sizes.items():
                    m.setattr(containment, k, v)
                got = containment.holding(n, t, "id", "name", "doc", "body", keep=True)
                assert sorted(map(tuple, got.collect())) == sorted(want)
                if unique and not sizes:  # neither texts nor pairs are shuffled
                    found = got._jdf.queryExecution().optimizedPlan().toString()
                    assert "Join" not in found and "Aggregate" not in found
