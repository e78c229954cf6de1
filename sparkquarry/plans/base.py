"""Registration of queries, and tables that both engines read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import dealt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the SQL of the same rows."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    """An inline table from SQL VALUES, the same text that the oracle uses."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


def literal(value) -> str:
    """A Python value in SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def relation(rows, columns: str) -> str:
    """Inline rows as a relation of the oracle, for which a query gives createDataFrame() the same rows."""
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") v({columns}))"


def _types(schema: str) -> list[tuple[str, str]]:
    return [tuple(c.strip().split(" ", 1)) for c in schema.split(",")]


def grown(spark: SparkSession, sf_dir: str, rows, schema: str, texts: str, swap: str | None = None) -> DataFrame:
    """A row a part, of one of the kinds that ``rows`` are: a part's name takes the place of ``swap`` in its ``texts``, or ends them on a
    line of its own; ``id`` is the part's."""
    kinds = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "kind int, " + ", ".join(f"{n} {t}" for n, t in _types(schema)[1:]))
    word = F.col("p_name")
    made = {c: F.replace(c, F.lit(swap), word) if swap else F.concat(c, F.lit("\n"), word) for c in texts.split()}
    parts = dealt(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("id"), "p_name", (F.col("p_partkey") % len(rows)).cast("int").alias("kind"))
    return parts.join(F.broadcast(kinds), "kind").withColumns(made).drop("kind", "p_name")


def grown_sql(rows, columns: str, texts: str, swap: str | None = None) -> str:
    """The rows of grown() as a relation of the oracle."""
    names = [c.strip() for c in columns.split(",")][1:]
    made = ", ".join((f"replace({c}, {literal(swap)}, p_name) AS {c}" if swap else f"{c} || chr(10) || p_name AS {c}") if c in texts.split() else c for c in names)
    kinds = relation([(i, *r[1:]) for i, r in enumerate(rows)], "kind, " + ", ".join(names))
    return f"(SELECT p_partkey AS id, {made} FROM part JOIN {kinds} k ON p_partkey % {len(rows)} = kind)"


def shared(name: str, sql: str, spark_sql: str | None = None, oracle: str | None = None) -> None:
    """Register SQL over driver tables named in braces; both engines run the same text unless the dialects differ."""
    tables = {t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels", "conversations") if f"{{{t}}}" in (spark_sql or sql)}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(spark_sql or sql, **{t: table(spark, sf_dir, t) for t in tables})

    run.__name__ = name
    plain = oracle or sql
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels", "conversations"):
        plain = plain.replace(f"{{{t}}}", t)
    query(plain)(run)
