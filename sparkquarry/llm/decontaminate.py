"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingle sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, broadcast_small, checkpointed, lower_ascii, text_or_empty, without

WORDS = 5
#: A document holds an item if 100 * shared >= CONTAINED * (shingles of the item).
CONTAINED = 75
#: Least hashes of an item in its sketch. A document that holds an item shares none of them with chance below 0.25 ** 8.
SKETCH = 8
#: Items are partitioned by shingle count, a partition to each doubling.
GROWTH = 2.0
#: Rows and bytes of item tables up to which they are broadcast; beyond, joins shuffle.
SMALL, BYTES = 200_000, 32 << 20


def bound_to(value: Column, body) -> Column:
    """body(value), with value worked out once: other functions' lambdas would work it out again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(text: Column) -> Column:
    """Array of the hashes of a text's shingles of five words; of fewer words, the whole sequence as one; of none, empty."""
    words = F.filter(F.split(lower_ascii(text), SPACE), lambda w: w != "")

    def runs(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WORDS))))
        return F.when(n >= WORDS, many).when(n > 0, F.array(F.xxhash64(h, n))).otherwise(F.array().cast("array<bigint>"))

    return bound_to(F.transform(words, lambda w: F.xxhash64(w)), runs)


def item_sketches(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(item, n, part, shingles) of items with words, and (item, part, hash): the SKETCH least hashes of each.

    ``part`` is the size partition. Hashes order shingles at random, so an item's least ones are a MinHash sketch of it.
    """
    sets = items.select(F.col(id_col).alias("item"), F.array_sort(F.array_distinct(shingles(text_or_empty(text_col)))).alias("shingles"))
    sets = sets.where(F.size("shingles") > 0).withColumn("n", F.size("shingles").cast("long"))
    sets = checkpointed(sets.withColumn("part", F.floor(F.log(GROWTH, F.col("n"))).cast("int")))  # items are hashed once
    return sets, sets.select("item", "part", F.explode(F.slice("shingles", 1, SKETCH)).alias("hash"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, n_item, n_shared) of each document that holds an item: 75 of 100 of its distinct shingles, wherever they are.

    Items are partitioned by size. A partition has a least size and a threshold, the largest hash in its sketches (lower
    for larger items). A document is searched for the partitions whose items it is large enough to hold, with its hashes
    below the highest threshold of these. Documents that share a sketch hash with an item are candidates; their whole
    sets are intersected with the item's. Partitions are a few rows whatever the number of items, and known to the driver.

    Items or documents without words match nothing; an item of fewer than five words matches only a document of the
    same words. Equal items match alike; a repeated document gives its rows once. Null ids match nothing. Other columns
    are ignored. Item tables are broadcast only if their rows and the bytes of their arrays are counted small, else joins shuffle.
    """
    sets, sketches = item_sketches(items, item_col, item_text_col)
    parts = sketches.join(sets.select("item", "n"), "item").groupBy("part").agg(F.min("n").alias("least"), F.max("hash").alias("most")).collect()
    keyed = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), shingles(text_or_empty(text_col)).alias("shingles"))

    def searched(own: Column) -> Column:
        limits = (F.when(F.size(own) * 100 >= p["least"] * CONTAINED, F.lit(p["most"])) for p in parts)
        return bound_to(F.struct(own.alias("own"), F.greatest(F.lit(-(1 << 63)), F.lit(-(1 << 63)), *limits).alias("most")), lambda x: F.filter(x["own"], lambda h: h <= x["most"]))

    hashes = keyed.select("id", F.explode(bound_to(F.col("shingles"), searched)).alias("hash"))
    found = hashes.join(broadcast_small(sketches.select("hash", "item"), SMALL, BYTES), "hash").groupBy("id").agg(F.collect_set("item").alias("items"))
    candidates = broadcast_small(checkpointed(found), SMALL, BYTES)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(candidates, "id")
    checked = texts.select("id", F.array_distinct(shingles(text_or_empty("text"))).alias("own"), F.explode("items").alias("item"))
    shared = checked.join(broadcast_small(sets.withColumnRenamed("shingles", "theirs"), SMALL, BYTES), "item").select("id", "item", "n", F.size(F.array_intersect("own", "theirs")).cast("long").alias("shared"))
    held = shared.where(f"100 * shared >= {CONTAINED} * n").distinct()
    return held.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("n").alias("n_item"), F.col("shared").alias("n_shared"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item, with all their columns, whatever their names. Null ids and texts hold nothing and stay;
    repeats, ties, empty tables (documents or items) and long texts are as in contaminated()."""
    return without(docs, contaminated(docs, items, id_col, text_col).select(id_col), id_col)
