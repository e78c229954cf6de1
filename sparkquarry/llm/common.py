"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType

from ..ship import to_workers

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def lower_ascii(col: Column) -> Column:
    return F.translate(col, ASCII_UPPER, ASCII_UPPER.lower())


def remainder(col: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"), F.lit(""))) % mod


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Ready the session for Python operators: the package on the workers, and batches in which long texts fit together."""
    to_workers(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A session's setting for the time of a block; what it was comes back."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffles_removed(spark: SparkSession):
    """For the time of a block, shuffle files go with the query that wrote them rather than when the driver collects garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


_HELD: dict = {}


def held(name: tuple, make):
    """What ``make`` gives, kept in this process under the name; one such object at a time, that of the operator at work, as
    workers live on from one operator to the next."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


@lru_cache(maxsize=1)
def _libc():
    import ctypes

    return ctypes.CDLL(None)  # what this process has loaded


def memory_returned() -> None:
    """Give what a worker's arrays and tables held back to the system, as the worker lives on; nothing without the GNU library."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        _libc().malloc_trim(0)
    except (AttributeError, OSError):
        pass


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, with Spark's own subfolder.

    The session's setting is used. Where it is unset, a session on one machine (tests) gets a temporary folder; on a
    cluster that would lose data, so it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which driver and executors share."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4()}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the checkpoint folder; partitioning stays known."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, folder: str) -> None:
    """Remove a folder that shared_folder() named."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forgotten(df: DataFrame) -> None:
    """Remove the files of a frame that checkpointed() gave; it can't be read any more."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        removed(df.sparkSession, file.get())


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, made: list[str]) -> DataFrame:
    """Cut the lineage with a table in the shared folder, for loops; ``made`` gets the folder, for its removal.

    A checkpoint keeps its plan's estimated size, for a join the product of both sides: over rounds a number of ever more
    digits, until the driver's memory is full. A table has the size of its files.
    """
    folder = shared_folder(df.sparkSession, "round")
    made.append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than that plus one."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast df only if a count shows that it has at most ``rows`` rows; else the planner shuffles it."""
    return F.broadcast(df) if fits(df, rows) else df


def _width(name: str, kind: DataType) -> Column:
    """Bytes of a column's values, those of nested values too."""
    col, text = F.col(f"`{name}`"), (StringType, BinaryType)
    if isinstance(kind, text):
        own = F.octet_length(col)
    elif isinstance(kind, ArrayType):
        own = F.aggregate(col, F.lit(0), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0)) + 8) if isinstance(kind.elementType, text) else F.size(col) * 8
    else:
        own = F.lit(0)
    return F.coalesce(own, F.lit(0)).cast("long") + 16


def broadcast_small(df: DataFrame, rows: int, size: int) -> DataFrame:
    """Broadcast df, made of plain values, strings and arrays of them, only if it is counted to have at most ``rows`` rows and
    ``size`` bytes in all; else the planner shuffles it. Reads no more than ``rows`` plus one rows."""
    width = sum((_width(f.name, f.dataType) for f in df.schema), F.lit(0))
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df


def without(docs: DataFrame, gone: DataFrame, id_col: str, rows: int = 500_000) -> DataFrame:
    """The rows of docs whose id is none of ``gone``, a frame of one column, with all their columns, whatever their names.

    The ids are worked out first. Up to ``rows`` of them, by count, are broadcast, so that texts stay where they are;
    beyond, both sides are shuffled by id. A null id is equal to a null id alone.
    """
    key = unused(docs, "gone")
    ids = checkpointed(gone.toDF(key).distinct())
    return docs.join(broadcast_if(ids, rows), F.col(f"`{id_col}`").eqNullSafe(F.col(key)), "left_anti")
