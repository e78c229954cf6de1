"""Roots by pointer doubling against a walk."""

import random

from sparkquarry.operators import graph


def test_rooted(spark):
    rng = random.Random(6)
    parents = {i: rng.choice([None, *range(i)]) if i < 300 else i - 1 for i in range(900)}
    parents |= {2000: 2001, 2001: 2002, 2002: 2000, 2003: 2001, 2004: 2003, 3000: 3000, 4000: 9999, 4001: 4000, 5000: None}
    parents |= {6000 + i: 5000 for i in range(300)}

    def walk(i):
        seen, depth = set(), 0
        while i is not None and i in parents and i not in seen:
            seen.add(i)
            if parents[i] is None:
                return i, depth
            i, depth = parents[i], depth + 1
        return None, None

    df = spark.createDataFrame([*parents.items(), (None, 5)], "id int, parent int").repartition(3)
    got = {r["id"]: (r["root"], r["depth"]) for r in graph.rooted(df, "id", "parent").collect()}
    assert got == {i: walk(i) for i in parents}
    assert max(d for _, d in got.values() if d is not None) > 500
    assert {(r["id"], r["depth"]) for r in graph.descendants(df, "id", "parent", 2).collect()} == {(i, d) for i, (_, d) in got.items() if d is not None and d <= 2}
    assert graph.rooted(df.limit(0), "id", "parent").count() == 0
