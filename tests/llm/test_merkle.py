"""Merkle manifests against a plain tree in memory."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sparkquarry.llm import common, merkle, queries

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """(root, the siblings of each leaf as (left, right) by level)."""
    sides, level, step = [[] for _ in nodes], nodes, 1
    while len(level) > 1:
        for i, own in enumerate(sides):
            c = i // step
            first = c - c % 3
            own.append(("".join(level[first:c]), "".join(level[c + 1 : first + 3])))
        level, step = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)], step * 3
    return level[0], sides


def plain(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    roots, inner = [], []
    for source in order:
        trees[source].sort(key=lambda x: x[:3])
        root, sides = climb([x[2] for x in trees[source]])
        roots.append(root)
        inner.append(sides)
    root, upper = climb(roots) if roots else (None, [])
    out = []
    for source, subroot, sides, more in zip(order, roots, inner, upper):
        for (_, _, leaf, row), own in zip(trees[source], sides):
            path, crc = own + more, zlib.crc32(b"" if row[0] is None else str(row[0]).encode())
            h = leaf_of((*row[:4], row[4].replace("\n", ""))) if crc % 2 == 0 and row[4] is not None else leaf
            for left, right in path:
                h = sha(left + h + right)
            out.append((row[0], leaf, subroot, root, sha("".join(x + y for x, y in path)), h, h == root))
    return out


def got(df):
    found = merkle.verified_rows(df, common.remainder("doc_id", 2) == 0, COLUMNS)
    return sorted(map(repr, map(tuple, found.collect())))


def cases():
    small = [
        (1, "b", "en", 3, "a\nb"), (2, "b", None, None, None), (3, "b", "de", 0, ""), (3, "b", "de", 0, ""), (3, "b", "de", 1, "x\n"), (None, "b", "en", 4, "\n"), (None, None, None, None, None),
        (7, None, "en", 1, "x"), (8, "", "en", 1, "x"), (9, "é", "en", 2, "é\n😀"), (10, "Z", "en", 9, "long\n" * 20_000), (11, "~", "en", 1, "\n\n"), (-5, "~", "en", 1, "minus\n"),
    ]
    return [small, [(i, "one", "en", i, f"t\n{i}") for i in range(2200)] + [(i, f"s{i % 40}", None, i, "x\n") for i in range(100)], [(4, "lone", "en", 1, "a\nb")], []]


@pytest.mark.parametrize("rows", cases(), ids=["edge cases", "three heights of one tree", "one row", "no rows"])
def test_trees(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", leaf string").withColumns({"tree": F.lit(1), "range": F.lit("x"), "digest": F.lit(0), "payload": F.lit(2), "id": F.lit(5)})
    assert got(df.repartition(3)) == sorted(map(repr, plain(rows)))


def test_nodes(spark):
    """The store has each node of each level once."""
    rows = [(i, "one" if i % 3 else "two", "en", i, f"t{i}") for i in range(1200)]
    df = spark.createDataFrame(rows, SCHEMA)
    leaves = df.select(merkle.tree_of(F.col("source")).alias("tree"), F.col("doc_id").alias("payload"), merkle.digest(*(merkle.field(F.col(c)) for c in COLUMNS)).alias("leaf"))
    manifest = merkle.build(leaves, ["payload"])
    found = {(r["tree"], r["level"], r["idx"]): r["digest"] for r in merkle.nodes(manifest).collect()}
    want = {}
    for tree in ("one", "two"):
        level, number = [leaf_of(r) for r in rows if r[1] == tree], 0
        while True:
            want |= {(f"s{tree}", number, i): h for i, h in enumerate(level)}
            if len(level) == 1:
                break
            level, number = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)], number + 1
    assert found == want
    assert merkle.nodes(manifest).count() == len(want)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select(*COLUMNS).collect()]
    found = queries.op12_merkle_manifest(spark, folder)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, plain(rows)))
