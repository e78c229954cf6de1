"""Metrics of pipeline stages from the execution itself: each stage's rows are counted as they pass, when the sink runs."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..shared import shared_folder
from .base import query, table

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Run:
    """What a run measured: by stage the numbers that were asked for, and the seconds of the sink, in which all stages run."""

    result: DataFrame | None
    metrics: dict[str, dict[str, object]] = field(default_factory=dict)
    seconds: float = 0.0

    def rows(self, spark) -> DataFrame:
        """(stage, place, metric, value) of each number, the stages in order."""
        found = [(stage, place, name, None if value is None else float(value)) for place, (stage, own) in enumerate(self.metrics.items(), 1) for name, value in own.items()]
        return spark.createDataFrame(found, "stage string, place int, metric string, value double")


def run(df: DataFrame, stages: Sequence[tuple[str, Step]], sink: Callable[[DataFrame], object] | None = None, metrics: Mapping[str, Column] | None = None) -> Run:
    """Apply stages in order and run the sink, by default a table in the shared folder, once.

    Of each stage, rows, the nulls of each column and ``metrics`` (aggregates, null where the stage lacks a column) are observed in the
    same pass. A stage that is planned away, or whose rows a later limit doesn't ask for, has no more than what passed. A failing
    sink raises as ever, and nothing is reported.
    """
    watched: dict[str, Observation] = {}
    for name, stage in stages:
        if name in watched:
            raise ValueError(f"two stages are named {name}")
        df, watched[name] = stage(df), Observation()
        nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"null:{c}") for c in df.columns]
        own = [m.alias(k) for k, m in (metrics or {}).items()]
        df = df.observe(watched[name], F.count(F.lit(1)).alias("rows"), *nulls, *own)
    began, result = time.monotonic(), None
    if sink is None:
        folder = shared_folder(df.sparkSession, "observed")
        df.write.parquet(folder)
        result = df.sparkSession.read.schema(df.schema).parquet(folder)
    else:
        sink(df)
    seconds = time.monotonic() - began
    return Run(result, {name: dict(o.get) for name, o in watched.items()}, seconds)


STAGES = (
    ("read", lambda d: d.select("doc_id", "text", "lang")),
    ("with_text", lambda d: d.where("text is not null and text <> ''")),
    ("measured", lambda d: d.withColumn("n", F.length("text")).withColumn("long", F.when(F.col("n") >= 1000, F.col("n")))),
    ("known", lambda d: d.join(F.broadcast(d.sparkSession.createDataFrame([("en", 1), ("de", 2)], "lang string, rank int")), "lang", "left")),
    ("ranked", lambda d: d.where("rank is not null and n > 300")),
)


@query("""WITH d AS (SELECT doc_id, text, lang, length(text) AS n, CASE WHEN length(text) >= 1000 THEN length(text) END AS long, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 END AS rank FROM documents), t AS (SELECT * FROM d WHERE text <> ''), r AS (SELECT * FROM t WHERE rank IS NOT NULL AND n > 300),
m AS (SELECT 'read' AS stage, 1 AS place, 'rows' AS metric, count(*) AS value FROM d UNION ALL SELECT 'read', 1, 'null:text', count(*) - count(text) FROM d UNION ALL SELECT 'read', 1, 'null:lang', count(*) - count(lang) FROM d
UNION ALL SELECT 'with_text', 2, 'rows', count(*) FROM t UNION ALL SELECT 'measured', 3, 'rows', count(*) FROM t UNION ALL SELECT 'measured', 3, 'null:long', count(*) - count(long) FROM t
UNION ALL SELECT 'known', 4, 'rows', count(*) FROM t UNION ALL SELECT 'known', 4, 'null:rank', count(*) - count(rank) FROM t UNION ALL SELECT 'ranked', 5, 'rows', count(*) FROM r UNION ALL SELECT 'ranked', 5, 'null:long', count(*) - count(long) FROM r)
SELECT stage, place::INT AS place, metric, value::DOUBLE AS value FROM m""")
def stage_metrics(spark, sf_dir):
    """Rows and nulls after each stage of a pipeline over all documents, from the one pass that runs it."""
    rows = run(table(spark, sf_dir, "documents"), STAGES).rows(spark)
    wanted = F.concat_ws("/", "stage", "metric").isin("read/null:text", "read/null:lang", "measured/null:long", "known/null:rank", "ranked/null:long")
    return rows.where((F.col("metric") == "rows") | wanted)
