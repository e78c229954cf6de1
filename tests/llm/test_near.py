"""The near-duplicate query on the driver's documents against all pairs."""

import collections
import itertools

import duckdb

from sparkquarry.llm.queries import op5_near_dedup, op6_decontamination

from .test_llm import shingles

FOLDER = "/root/testdata/sf0.01"


def test_components_are_those_of_all_pairs(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    sets = {i: shingles(t) for i, t in docs}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = collections.Counter(pair for ids in holders.values() for pair in itertools.combinations(sorted(ids), 2))  # pairs without a common shingle aren't linked
    links = {(a, b) for (a, b), n in shared.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)}
    roots = {i: i for i in sets}
    changed = True
    while changed:  # the least id spreads over links
        changed = False
        for a, b in links:
            low = min(roots[a], roots[b])
            changed |= roots[a] != low or roots[b] != low
            roots[a] = roots[b] = low
    got = {r["doc_id"]: r for r in op5_near_dedup(spark, FOLDER).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(s), roots[i], roots[i] == i) for i, s in sets.items()}
    assert len(links) > 100 and all(got[a]["component_id"] == got[b]["component_id"] for a, b in links)  # a recall of one


def test_contamination_is_that_of_all_pairs(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet'").fetchall()
    sets = [(k, shingles(t)) for k, t in items]
    want = {(i, k, len(s), len(s & own)) for i, t in docs for own in (shingles(t),) for k, s in sets if s and 100 * len(s & own) >= 75 * len(s)}
    assert {tuple(r) for r in op6_decontamination(spark, FOLDER).collect()} == want and want
