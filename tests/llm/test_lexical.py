"""Ranked lexical search against scores of all pairs."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkquarry.llm import lexical, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(lexical.TERM, (text or "").translate(LOWER))


def plain(docs, items, k=10):
    words = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in words), sum(sum(c.values()) for _, c in words)
    df = Counter(w for _, c in words for w in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        scored = []
        for i, c in words:
            n, score = sum(c.values()), 0
            for t in own & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * (10 + (90 * n * n_docs) // total)))
            if score > 0:
                scored.append((-score, (i is not None, i or 0), i))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(repr, out))


def got(spark, docs, items, k=10):
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, term string").withColumns({"doc": F.lit(1), "score": F.lit("x"), "bucket": F.lit(2)}).repartition(3)
    index = lexical.build(frame)
    found = lexical.ranked(spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, term string"), index, k)
    return sorted(map(repr, map(tuple, found.collect())))


def text(rng, size):
    return " ".join(f"w{min(int(rng.paretovariate(0.6)), 400)}" for _ in range(size))


def test_random(spark, monkeypatch):
    """Frequent and rare terms, copies by the hundred that tie, repeated ids, items that documents hold."""
    monkeypatch.setattr(lexical, "PROBE", 40)
    rng = random.Random(4)
    docs = [(i, text(rng, rng.randint(1, 60))) for i in range(300)]
    items = [(i, docs[7 * i][1]) for i in range(8)] + [(20 + i, text(rng, 5)) for i in range(12)] + [(50, "w1 w2 w1"), (51, "nothing of this")]
    docs += [(1000 + i, docs[14][1]) for i in range(200)] + [(5, docs[9][1]), (5, docs[9][1]), (None, docs[0][1]), (None, None)]
    rng.shuffle(docs)
    assert got(spark, docs, items) == plain(docs, items)
    assert got(spark, docs, items, 3) == plain(docs, items, 3)


@pytest.mark.parametrize(
    "docs, items",
    [
        ([], [(1, "a b")]),
        ([(1, "a b")], []),
        ([(1, None), (2, ""), (3, " ,.;\x00")], [(1, "a"), (2, None)]),
        ([(1, "A É é ß_9 x-y"), (2, "a " * 30_000 + "rare"), (3, "é"), (4, "ÉÉ"), (-4, "9 x y 😀 😀x"), (9, None)], [(1, "a rare É"), (None, "a"), (2, ""), (3, "X y 9 😀x"), (3, "é"), (3, "é")]),
    ],
    ids=["no documents", "no items", "no terms", "odd texts"],
)
def test_edges(spark, docs, items):
    assert got(spark, docs, items) == plain(docs, items)


def test_blocks(spark, monkeypatch):
    """Small blocks give the same rows."""
    rng = random.Random(5)
    docs = [(i, text(rng, 20)) for i in range(100)]
    whole = lexical._Block(0)
    for i, t in docs:
        whole.add(i, lexical.terms_of(t))
    import pyarrow as pa

    lists = pa.list_(pa.int32())
    schema = pa.schema([("term", pa.string()), ("base", pa.int64()), ("docs", lists), ("tfs", lists), ("ns", lists), ("ids", pa.list_(pa.int64()))])
    rows = [r for b in whole.batches(schema) for r in b.to_pylist()]
    assert rows[0]["ids"] == [i for i, _ in docs] and rows[0]["ns"] == [20] * 100
    found = {(r["term"], d, tf, n) for r in rows[1:] for d, tf, n in zip(r["docs"], r["tfs"], r["ns"])}
    assert found == {(w, i, c, 20) for i, t in docs for w, c in Counter(terms(t)).items()}


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = (duckdb.sql(f"SELECT {c}, text FROM '{folder}/{t}.parquet'").fetchall() for c, t in (("doc_id", "documents"), ("item_id", "benchmark")))
    found = queries.op11_lexical_search(spark, folder).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(repr, map(tuple, found))) == plain(docs, items)
