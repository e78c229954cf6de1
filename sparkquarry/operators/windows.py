"""Neighbourhoods and groups over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut_lineage


def context(df: DataFrame, partition: list[str], order: str, value: str, before: int, after: int, name: str = "context") -> DataFrame:
    """An array of the values of the rows around each one, itself included."""
    return df.withColumn(name, F.collect_list(value).over(Window.partitionBy(*partition).orderBy(order).rowsBetween(-before, after)))


def proximity_groups(df: DataFrame, partition: list[str], order: list[str], gap, value: str, name: str = "group_no") -> DataFrame:
    """Number of each row's group: a group ends where ``value`` grows by more than ``gap``."""
    w = Window.partitionBy(*partition).orderBy(*order)
    new = F.when(F.col(value) - F.lag(value).over(w) > gap, 1).otherwise(0)
    return df.withColumn("__new", new).withColumn(name, F.sum("__new").over(w)).drop("__new")


def top_per_group(df: DataFrame, partition: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col(name) <= k)


def global_rank(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """Each row's place in the order of all rows, from 1; the order must be total. Rows are sorted in ranges, and what is added
    to the places within a range is known from the sizes of those before it: no task sees all rows, and the driver gets a
    number a range."""
    keyed = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    keyed = cut_lineage(keyed)  # so that ranges stay what they are
    offset, sizes = 0, []
    for r in sorted(keyed.groupBy("__range").count().collect()):
        sizes.append((r["__range"], offset))
        offset += r["count"]
    before = df.sparkSession.createDataFrame(sizes, "__range int, __before long")
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return keyed.withColumn("__within", within).join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__within")).drop("__range", "__within", "__before")


def nearest_rank(df: DataFrame, partition: list[str], value: str, share: float, least: int) -> DataFrame:
    """The value at index floor(n * share) of each group in order if it has ``least`` rows, else the largest; by places in the
    order of all rows, so that a large group is many tasks."""
    known = df.where(F.col(value).isNotNull()).select(*partition, value).withColumn("__id", F.monotonically_increasing_id())
    ranked = global_rank(known, [*partition, value, "__id"], "__r")
    sizes = ranked.groupBy(*partition).agg(F.count(F.lit(1)).alias("__n"), F.min("__r").alias("__first"))
    at = F.when(F.col("__n") >= least, F.floor(F.col("__n") * share) + 1).otherwise(F.col("__n"))
    wanted = sizes.select(F.col("__n"), (F.col("__first") + at - 1).alias("__r"))
    return ranked.join(wanted, "__r").select(*partition, F.col(value).alias("value"), F.col("__n").alias("n"))


def top_with_more(df: DataFrame, partition: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group with their place, and how many more the group has. Groups are counted apart, so that the
    window keeps k rows a group and task before the shuffle."""
    return top_per_group(df, partition, order, k, "place").join(df.groupBy(*partition).agg((F.count(F.lit(1)) - k).alias("more")), partition)
