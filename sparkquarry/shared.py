"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4()}"


def removed(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, made: list[str] | None = None, name: str = "step") -> DataFrame:
    """Cut the lineage with a table in the shared folder; ``made`` gets the folder, for its removal."""
    folder = shared_folder(df.sparkSession, name)
    if made is not None:
        made.append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dealt(df: DataFrame, *keys: str, tasks: int = 4) -> DataFrame:
    """Rows dealt by their keys to some tasks a core. Where few or narrow rows make much work, the size of a file or of a shuffle
    says little of it, and would leave it to one task or two."""
    return df.repartition(tasks * df.sparkSession.sparkContext.defaultParallelism, *keys)


def dropped(spark: SparkSession, made: list[str]) -> None:
    """Remove the folders of steps that nothing reads any more."""
    for folder in made:
        removed(spark, folder)
    made.clear()


def _width(name: str, kind: DataType) -> Column:
    col, text = F.col(f"`{name}`"), (StringType, BinaryType)
    if isinstance(kind, text):
        own = F.octet_length(col)
    elif isinstance(kind, ArrayType):
        own = F.aggregate(col, F.lit(0), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0)) + 8) if isinstance(kind.elementType, text) else F.size(col) * 8
    else:
        own = F.lit(0)
    return F.coalesce(own, F.lit(0)).cast("long") + 16


def broadcast_small(df: DataFrame, rows: int = 200_000, size: int = 32 << 20) -> DataFrame:
    """Broadcast df, made of plain values, strings and arrays of them, only if it is counted to have at most ``rows`` rows and
    ``size`` bytes in all; else the planner shuffles it."""
    width = sum((_width(f.name, f.dataType) for f in df.schema), F.lit(0))
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df
