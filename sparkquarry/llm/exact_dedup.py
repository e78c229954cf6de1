"""Exact dedup by progressive refinement: length, then prefix hash, then full hash of what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, checkpointed, text_or_empty, without

#: Characters of the prefix that the second round hashes.
PREFIX = 128
#: Parts that the rows of one length are dealt to when they meet its count.
SALTS = 16


def normalised(col: str = "text") -> Column:
    """The text with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(col), SPACE, " ")


def _full(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _survivors(keyed: DataFrame) -> DataFrame:
    """The rows of (id, len, prefix, ...) whose length and prefix another row has too.

    Groups are counted before they are shuffled. Lengths, few values that many texts share, are dealt to salted parts; what
    is left of a large group meets its one row of (length, prefix), a join whose large partitions adaptive execution splits.
    """
    lengths = keyed.groupBy("len").count().where("count > 1").select("len", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("id", "prefix"), F.lit(SALTS)).cast("int"))
    by_length = salted.join(lengths, ["len", "salt"], "left_semi")
    prefixes = by_length.groupBy("len", "prefix").count().where("count > 1").select("len", "prefix")
    return by_length.join(prefixes, ["len", "prefix"], "left_semi")


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("full").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")


def _kept() -> Column:
    return F.coalesce(F.col("id") == F.coalesce("keep", "id"), F.col("keep").isNull())


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of each row; of equal normalised texts the smallest id stays.

    Rounds: rows are counted by normalised length; rows of lengths that occur once are settled. The others are counted
    by (length, hash of the prefix); only groups of two and more are grouped by full hash. Texts are read once: lengths and
    hashes, some 100 bytes a row, go to a table that all rounds read. As the digest is a column of the result, every text is
    hashed whole in that pass; drop_exact_copies() hashes survivors alone.

    Null text counts as empty, so nulls equal each other and empty texts. Null ids never become keep_id unless a group
    has no other; such a row is kept. Rows that repeat an id and its text are one document: all have the same flags.
    Other columns are ignored, whatever their names; an empty table gives an empty one; texts may have any length.
    """
    norm = normalised(text_col)
    keyed = checkpointed(docs.select(F.col(id_col).alias("id"), F.octet_length(norm).alias("len"), F.xxhash64(F.substring(norm, 1, PREFIX)).alias("prefix"), _full(norm).alias("full")))
    joined = keyed.select("id", "full").join(_groups(_survivors(keyed)), "full", "left")
    return joined.select(
        F.col("id").alias(id_col), F.coalesce("keep", "id").alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), _kept().alias("kept"), F.col("full").alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup() keeps, with all their columns, also such as are named like its own.

    Only texts of surviving groups are hashed whole. Rows of one id are one document and stay together: if one of them is
    kept, all are. Nulls, repeats, ties, empty tables and long texts are as in exact_dedup().
    """
    norm = normalised(text_col)
    keyed = checkpointed(docs.select(F.col(id_col).alias("id"), F.octet_length(norm).alias("len"), F.xxhash64(F.substring(norm, 1, PREFIX)).alias("prefix")))
    wanted = _survivors(keyed).select(F.col("id").alias("wanted")).distinct()
    texts = docs.select(F.col(id_col).alias("id"), _full(norm).alias("full")).join(wanted, F.col("id").eqNullSafe(F.col("wanted")), "left_semi")
    rows = checkpointed(texts)
    flags = rows.join(_groups(rows), "full", "left").groupBy("id").agg(F.max(_kept()).alias("kept"))
    return without(docs, flags.where("not kept").select("id"), id_col)
