"""Ranked lexical search: postings bucketed by term, integer scores, exact pruning of documents that can't be among the best.

The index is a Parquet table of postings partitioned by bucket of term. A row is a term in one block of documents, with the
documents' positions in the block, the term's occurrences there and the documents' lengths as arrays. A frequent term is many
rows, whose buckets are dealt out anew by size.
"""

from __future__ import annotations

from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_small, lower_ascii, memory_returned, removed, shared_folder, shuffles_removed, small_batches, text_or_empty, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Postings and documents of a block, and terms of an Arrow batch.
BLOCK, BLOCK_DOCS, TERMS = 2_000_000, 1 << 20, 20_000
BUCKETS = 64
#: Bytes of UTF-8 as terms have them: A-Z in lower case, other ASCII that isn't of a term as a space.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bucket of the rows that have a block's documents: their ids and lengths.
DOCUMENTS = -1
#: Postings of an item's rarest terms in which its first documents are looked for.
PROBE = 2_000
#: What a term adds to a score is less than its weight times this.
MOST = 1_000_000
#: First documents of an item by the place asked for, and share of the bound that terms set aside may add up to: the less,
#: the more matches are summed, and the fewer documents are left to be scored whole.
FIRST, ASIDE = 20, 0.35
#: Rows and bytes up to which a table is broadcast.
ROWS, BYTES = 500_000, 32 << 20


@dataclass
class Index:
    """Folder of the postings, number of documents that have a term, number of their terms, and the type of ids."""

    spark: SparkSession
    folder: str
    documents: int
    terms: int


def _bucket() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")


class _Numbers(dict):
    """Numbers from 0 of what is looked up, in order of first look."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def terms_of(text: str) -> list[bytes]:
    """The text's terms in UTF-8, in order: bytes above ASCII are parts of terms, so single bytes can be mapped."""
    return text.encode().translate(FOLDED).split()


class _Block:
    """Postings of the documents that a task has read since the last block."""

    def __init__(self, base: int) -> None:
        self.base, self.vocabulary = base, _Numbers()
        self.terms, self.counts, self.distinct, self.sizes, self.ids = array("i"), array("i"), array("i"), array("i"), []

    def add(self, ident, words: list[bytes]) -> None:
        counts = Counter(words)
        self.terms.extend(map(self.vocabulary.__getitem__, counts))
        self.counts.extend(counts.values())
        self.distinct.append(len(counts))
        self.sizes.append(len(words))
        self.ids.append(ident)

    def full(self) -> bool:
        return len(self.terms) >= BLOCK or len(self.ids) >= BLOCK_DOCS

    def batches(self, schema: pa.Schema):
        def batch(terms, docs, tfs, ns, ids):
            n = len(terms)
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()).cast(pa.string()), pa.array(np.full(n, self.base, np.int64)), docs, tfs, ns, ids], schema=schema)

        sizes, none = np.frombuffer(self.sizes, np.int32), pa.nulls(1, pa.list_(pa.int32()))
        whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(self.ids)], pa.int32()), values)
        ids = whole(pa.array(self.ids, schema.field("ids").type.value_type))
        yield batch([None], none, none, whole(pa.array(sizes)), ids)
        if not self.vocabulary:
            return
        terms, counts = np.frombuffer(self.terms, np.int32), np.frombuffer(self.counts, np.int32)
        order = np.argsort(terms, kind="stable")  # documents of a term stay in order
        docs = np.repeat(np.arange(len(sizes), dtype=np.int32), np.frombuffer(self.distinct, np.int32))[order]
        ends = np.r_[0, np.cumsum(np.bincount(terms, minlength=len(self.vocabulary)))]
        names, tfs, ns = [*self.vocabulary], counts[order], sizes[docs]
        for at in range(0, len(names), TERMS):
            own = ends[at : at + TERMS + 1]
            offsets = pa.array((own - own[0]).astype(np.int32))
            part = lambda values: pa.ListArray.from_arrays(offsets, pa.array(values[own[0] : own[-1]]))  # noqa: B023, E731
            yield batch(names[at : at + TERMS], part(docs), part(tfs), part(ns), pa.nulls(len(own) - 1, ids.type))


def _postings(batches):
    from pyspark import TaskContext

    at, block, schema = TaskContext.get().partitionId() << 40, None, None
    for found in batches:
        schema = schema or pa.schema([("term", pa.string()), ("base", pa.int64()), *((c, pa.list_(pa.int32())) for c in ("docs", "tfs", "ns")), ("ids", pa.list_(found.schema.field(0).type))])
        for ident, text in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
            block = block or _Block(at)
            block.add(ident, terms_of(text))
            at += 1
            if block.full():
                yield from block.batches(schema)
                block = None
    if block:
        yield from block.batches(schema)
    block = None
    memory_returned()


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index every row of docs over its whole text. Each row is a document of its own, whatever its id, with a number from its
    task and place. Null text has no terms.

    Texts are read once. A task turns up to BLOCK postings at a time into rows by term, so that what is shuffled is a row a
    term and block. Buckets go to tasks by size: adaptive execution splits those of frequent terms.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(F.col(f"`{text_col}`")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    rows = source.mapInArrow(_postings, f"term string, base long, docs array<int>, tfs array<int>, ns array<int>, ids array<{kind}>")
    bucketed = rows.withColumn("bucket", F.when(F.col("term").isNull(), F.lit(DOCUMENTS)).otherwise(_bucket()))
    folder = shared_folder(spark, "postings")
    with shuffles_removed(spark):
        bucketed.hint("rebalance", "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(folder)
    with_terms = "aggregate(ns, struct(0L as n, 0L as l), (a, n) -> struct(a.n + if(n > 0, 1, 0) as n, a.l + n as l))"
    if not _documents(spark, folder).take(1):
        return Index(spark, folder, 0, 0)
    total = _documents(spark, folder).selectExpr(f"{with_terms} as t").agg(F.sum("t.n").alias("n"), F.sum("t.l").alias("l")).first()
    return Index(spark, folder, total["n"], total["l"])


def _table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("term string, base long, docs array<int>, tfs array<int>, ns array<int>, bucket int").parquet(folder)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of (base, ns, ids): the documents of a block."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(folder).where(F.col("bucket") == DOCUMENTS).select("base", "ns", "ids")
    except AnalysisException:  # no documents, no files
        return spark.createDataFrame([], "base long, ns array<int>, ids array<long>")


def _weights(df: str, n: int) -> str:
    return f"cast(floor(1000 * ln({2 * n + 2}D / (2 * {df} + 1))) as bigint)"


def _adds(index: Index) -> str:
    """SQL of what a posting (w, tf, n) adds to the score of its document; integers, divisions round down."""
    return f"w * ((1000000000L * tf) div (1000L * tf + 8 * (10 + (90L * n * {index.documents}L) div {max(1, index.terms)}L)))"


def _exploded(postings: DataFrame, *kept: str) -> DataFrame:
    rows = postings.select("term", "base", *kept, F.explode(F.arrays_zip("docs", "tfs", "ns")).alias("p"))
    return rows.selectExpr("term", *kept, "base + p.docs as doc", "p.tfs as tf", "p.ns as n")


def _whole_scores(pairs: DataFrame, terms: DataFrame, postings: DataFrame, index: Index) -> DataFrame:
    """(item, doc, score) over all of an item's terms, of pairs (item, doc), which are few."""
    wanted = pairs.join(broadcast_small(terms, ROWS, BYTES), "item").select("item", "doc", "term", "w")
    found = _exploded(postings).join(broadcast_small(wanted, ROWS, BYTES), ["term", "doc"])
    return found.groupBy("item", "doc").agg(F.sum(F.expr(_adds(index))).alias("score"))


def ranked(items: DataFrame, index: Index, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, rank, doc_id, score): the k highest-scoring documents of each item with a score above 0, by score, then id.

    Exact, though not all matches are summed. The postings of an item's rarest terms name its first documents, and the k-th
    of their whole scores is a bound that the k-th best of all reaches. Terms of least weight that add up to a part of the bound
    at most are set aside. Matches with the others are summed by item and document, and where the sum with all that was
    set aside reaches the bound, the whole score is worked out. With fewer than k first documents the bound is 0 and
    nothing is set aside.

    Rows of one item id are one item with the terms of all of them, once each; rows of a null id are ignored, as are items
    without terms. Documents of equal score and id are as many rows; a null id comes before others. No documents or no items
    give no rows; other columns are ignored, whatever their names. Tables are broadcast only if counted small.
    """
    with shuffles_removed(index.spark):
        return _ranked(items, index, k, id_col, text_col)


def _ranked(items: DataFrame, index: Index, k: int, id_col: str, text_col: str) -> DataFrame:
    spark, made = index.spark, []
    words = F.regexp_extract_all(lower_ascii(text_or_empty(F.col(f"`{text_col}`"))), F.lit(TERM), F.lit(0))
    own = items.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("item"), F.explode(words).alias("term")).distinct()
    own = written(own.withColumn("bucket", _bucket()), made)
    asked = own.select("bucket", "term").distinct()
    postings = written(_table(spark, index.folder).where(F.col("bucket") >= 0).join(broadcast_small(asked, ROWS, BYTES), ["bucket", "term"]), made)
    df = postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    terms = written(own.join(df, "term").selectExpr("item", "term", "df", f"{_weights('df', index.documents)} as w"), made)

    rarest = Window.partitionBy("item").orderBy("df", "term")
    probes = terms.withColumn("before", F.sum("df").over(rarest) - F.col("df")).where(F.col("before") < PROBE).select("item", "term", "w")
    best = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
    sums = lambda part: _exploded(postings.join(broadcast_small(part, ROWS, BYTES), "term"), "item", "w").groupBy("item", "doc").agg(F.sum(F.expr(_adds(index))).alias("score"))
    first = written(sums(probes).withColumn("place", best).where(F.col("place") <= FIRST * k).select("item", "doc"), made)
    known = _whole_scores(first, terms.select("item", "term", "w"), postings, index).groupBy("item").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
    bounds = written(known.selectExpr("item", f"coalesce(get(scores, {k - 1}), 0L) as bound"), made)

    lightest = Window.partitionBy("item").orderBy("w", "term")
    marked = terms.join(bounds, "item").withColumn("could", F.sum("w").over(lightest) * MOST)
    marked = written(marked.selectExpr("item", "term", "w", "bound", f"could < {ASIDE} * bound as aside"), made)
    rest = marked.groupBy("item", "bound").agg(F.coalesce(F.sum(F.expr(f"if(aside, w * {MOST}, 0L)")), F.lit(0)).alias("rest"))
    partial = sums(marked.where("not aside").select("item", "term", "w")).join(broadcast_small(rest, ROWS, BYTES), "item")
    able = written(partial.where("score + rest >= bound").select("item", "doc"), made)
    scores = written(_whole_scores(able, marked.select("item", "term", "w"), postings, index), made)

    scored = scores.where("score > 0")
    named = _documents(spark, index.folder).select("base", F.posexplode("ids").alias("at", "id")).select((F.col("base") + F.col("at")).alias("doc"), "id")
    rows = named.join(broadcast_small(scored, ROWS, BYTES), "doc").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    out = written(rows.select(F.col("item").alias(id_col), "rank", F.col("id").alias("doc_id"), "score"), [])
    for folder in made:
        removed(spark, folder)
    return out


def forget(index: Index) -> None:
    removed(index.spark, index.folder)
