"""Metrics of stages against counts, and that the sink runs once."""

import pytest
from pyspark.sql import functions as F

from sparkquarry.functions import roles
from sparkquarry.plans import observed


def test_run(spark):
    passed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            passed.add(b.num_rows)
            yield b

    df = spark.range(100).withColumn("v", F.when(F.col("id") % 4 > 0, F.col("id")))
    stages = [("all", lambda d: d.mapInArrow(counted, d.schema)), ("some", lambda d: d.where("id < 30")), ("none", lambda d: d.where("id < 0"))]
    out = observed.run(df, stages, metrics={"most": F.max("v")})
    assert out.metrics == {"all": {"rows": 100, "null:id": 0, "null:v": 25, "most": 99}, "some": {"rows": 30, "null:id": 0, "null:v": 8, "most": 29}, "none": {"rows": 0, "null:id": 0, "null:v": 0, "most": None}}
    assert passed.value == 100 and out.result.count() == 0 and out.seconds > 0
    assert out.rows(spark).where("stage = 'some' and metric = 'rows'").first()["value"] == 30
    with pytest.raises(ValueError):
        observed.run(df, [("a", lambda d: d), ("a", lambda d: d)])


def test_measures_of_nothing(spark):
    files = spark.createDataFrame([(1, ""), (2, None), (3, "// a\n/* b\n*/\n\nx = '// c'; // d")], "file_id int, content string")
    rows = {r["file_id"]: r["c"] for r in files.select("file_id", roles.line_counts(F.col("content")).alias("c")).collect()}
    assert tuple(rows[1]) == (0, 0, 0, 0, 0.0, 0.0) and tuple(rows[3])[:4] == (5, 1, 3, 1)
    assert roles.classified(files).count() == 0 == roles.branches(files).count()
    assert roles.insights(files.limit(0), ["file_id"], "content").count() == 0
    assert {r["file_id"]: r["words"] for r in roles.insights(files, ["file_id"], "content").collect()} == {1: 0, 2: 0, 3: 11}
