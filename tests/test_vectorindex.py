"""The inverted-file index against exhaustive search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkquarry.operators import retrieval as R
from sparkquarry.operators import vectorindex as V
from sparkquarry.plans import retrieval

SCHEMA = "vec_id long, embedding array<float>, label int"


def made(spark, copies=0):
    """Vectors around some directions, a group of copies, vectors without direction, and nulls."""
    rng = np.random.default_rng(3)
    around = rng.normal(size=(20, 16))
    rows = [(i, [float(x) for x in around[i % 20] + 0.3 * rng.normal(size=16)], i % 5) for i in range(1500)]
    rows += [(2000 + i, rows[7][1], i % 5) for i in range(copies)] + [(5000 + i, [0.0] * 16, 1) for i in range(3)] + [(6000, None, 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def queries_of(df, step):
    return df.where(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def rows(df):
    return sorted(map(tuple, df.select("query_id", "vec_id", "score", "rank").collect()))


@pytest.mark.parametrize("copies", [0, 700])
def test_exact(spark, copies):
    df = made(spark, copies)
    queries, index = queries_of(df, 50), V.build(df, 40)
    whole = rows(R.cosine_top_k(queries, df, 7))
    assert rows(V.search(queries, index, 7, None)) == whole
    assert rows(V.search(queries, index, 7, 2, exact=True)) == whole
    some = rows(R.cosine_top_k(queries, df.where("label = 3"), 7))
    assert rows(V.search(queries, index, 7, 1, condition="label = 3", exact=True)) == some
    assert sum(index.sizes.values()) == df.where("embedding is not null").count()
    nearest = V.search(queries, index, 7, 8)
    assert V.recall(nearest, R.cosine_top_k(queries, df, 7)) >= 0.9
    index.drop()


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall(spark, scale):
    """Recall of the registered query on the driver's vectors, which have hardly any clusters."""
    folder = f"/root/testdata/{scale}"
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    assert V.recall(retrieval.ivf_topk(spark, folder), R.cosine_top_k(queries_of(df, 100), df, 10)) >= 0.9


def test_probes(spark):
    """Clustered vectors need few lists."""
    df = made(spark)
    index = V.build(df, 20)
    assert V.probes_for(queries_of(df, 30), index, 5, 0.9) <= 4


def test_add(spark):
    df = made(spark)
    queries = queries_of(df, 75)
    index = V.build(df.where("vec_id < 1000"), 20)
    index.add(df.where("vec_id >= 1000"))
    assert rows(V.search(queries, index, 5, 3, exact=True)) == rows(R.cosine_top_k(queries, df, 5))


def test_lists_are_read(spark):
    """Few queries read few lists, and the filter goes to the scan."""
    df = made(spark)
    index = V.build(df, 40)
    plan = V.search(queries_of(df, 1499), index, 3, 2, condition="label = 3")._jdf.queryExecution().executedPlan().toString()
    assert "list" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(label,3)" in plan


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [0.5, 0.5], 0)], SCHEMA)
    none = V.build(empty)
    assert rows(V.search(queries_of(one, 1), none, 3)) == []
    index = V.build(one)
    assert rows(V.search(queries_of(empty, 1), index, 3)) == []
    assert [r[1:] for r in rows(V.search(queries_of(one.limit(1), 1), index, 2, exact=True))] == [(1, 1.0, 1), (1, 1.0, 2)]
    zero = spark.createDataFrame([(9, [0.0, 0.0])], "query_id long, query array<float>")
    assert [r[2] for r in rows(V.search(zero, index, 2))] == [0.0, 0.0]
