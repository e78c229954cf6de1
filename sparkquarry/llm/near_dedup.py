"""Near duplicates by MinHash with tensored banding, every link confirmed on whole shingle sets.

Two collections of M short signatures (R minhashes each) are drawn per document. Table keys are all M x M pairs of one of
each, so M * M tables cost 2 * M * R minhashes. Only signatures that two documents share can be part of a shared key, so
keys are formed for those alone. Candidates within a key are compared with pivots, never all with all: once a component has
formed, its members need no more comparisons with each other; the number of pivots of a key grows from round to round until
each pair of its members that is still in two components has been compared, or shown by bounds not to be linked. Bounds are
exact: shingles found in one component alone can't be common to a link between two, so a document with too few others is
done; and a bit of a document's bitmap that the other's lacks is a shingle that isn't common.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, forgotten, memory_returned, removed, small_batches, text_or_empty, without, written

WORDS = 5
#: Linked if 100 * intersection >= SIMILAR * union.
SIMILAR = 75
#: Signatures in a collection and minhashes in a signature. A pair at similarity 0.75 shares no key with chance 2 * (1 - 0.75 ** R) ** M = 0.0005.
M, R = 10, 2
#: Rounds of one comparison a document, before the pivots of a key grow by a factor each round.
DRAWS, GROWTH = 4, 16
#: Longs in the bitmap of a document's shingles.
BITS = 8
KEPT = 400_000
SHUFFLE = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def _done() -> None:
    word_hashes().clear()
    memory_returned()


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, size: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``size`` words; of fewer words, the whole sequence as one; of none, empty."""
    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space alone
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, n)
    width = min(size, n)
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, width, np.uint64)
        for i in range(width):
            out = (out + h[i : n - width + 1 + i]) * SHUFFLE
    return np.unique(mixed(out))


@lru_cache(maxsize=1)
def draws() -> tuple[np.ndarray, np.ndarray]:
    x = mixed(np.arange(1, 4 * M * R + 1, dtype=np.uint64) * SHUFFLE)
    return x[: 2 * M * R] | np.uint64(1), x[2 * M * R :]


def signatures(shingles: np.ndarray) -> np.ndarray:
    """2 * M signatures: the first collection, then the second; the place of a signature is part of its value."""
    factors, offsets = draws()
    lowest = np.full(2 * M * R, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 2048):
            lowest = np.minimum(lowest, (shingles[i : i + 2048, None] * factors + offsets).min(0))
        out = np.arange(1, 2 * M + 1, dtype=np.uint64)
        for r in range(R):
            out = mixed(out * SHUFFLE + lowest[r :: R])
    return out


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, shape, signatures): number of shingles, digest of the whole set, and signatures if it isn't empty."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([*map(len, sets)], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([signatures(s).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                names=["id", "n", "shape", "signatures"],
            )
        _done()

    return docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "id long, n long, shape binary, signatures array<long>")


def bitmap(shingles: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * BITS, bool)
    bits[shingles % np.uint64(64 * BITS)] = True
    return np.packbits(bits).view(np.int64)


def _sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(id, shingles, bits) of the wanted ids."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
            columns = [[x.view(np.int64) for x in sets], [bitmap(x) for x in sets]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.list_(pa.int64())) for c in columns)], names=["id", "shingles", "bits"])
        _done()

    source = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).join(wanted.select("id"), "id", "left_semi")
    return source.mapInArrow(run, "id long, shingles array<long>, bits array<long>").dropDuplicates(["id"])


def connected(edges: DataFrame, made: list[str]) -> DataFrame:
    """(node, root): the smallest node reachable over edges (a, b), by spreading the least label and jumping to labels' labels."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), made)
    labels = written(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")), made)
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("heard"))
        nearer = labels.join(heard.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("before"), F.least("root", "heard").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        after = written(nearer.join(jump, "root").select("node", "before", F.least("root", "beyond").alias("root")), made)
        settled = after.where("before <> root").isEmpty()
        labels = after.select("node", "root")
        if settled:
            return labels


def _place(col: str) -> Column:
    """A fixed draw in [0, 1) for an id."""
    return F.shiftrightunsigned(F.xxhash64(F.col(col)), 11) / F.lit(float(1 << 53))


def _able(open_docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, n, m) of the documents that may be linked with one of another component; m of their shingles are in two components.

    A link has 75 of 100 of a document's shingles in common at least, and these are in both documents' components.
    """
    held = sets.join(open_docs, "id").select("id", "n", "component", F.explode("shingles").alias("shingle"))
    crossing = held.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("shingle")
    return held.join(crossing, "shingle", "left_semi").groupBy("id", "n").agg(F.count(F.lit(1)).alias("m")).where(f"100 * m >= {SIMILAR} * n")


def _rows(both: DataFrame, able: DataFrame) -> DataFrame:
    """A row for each key of the able documents, with the signatures below the key's own, by which a pair knows its least key."""
    own = both.select(F.col("rep").alias("id"), "first", "second").join(able, "id")
    for side, sign in (("first", "f"), ("second", "s")):
        own = own.withColumn(sign, F.explode(side)).withColumn(f"below_{sign}", F.expr(f"filter({side}, x -> x < {sign})"))
    own = own.withColumn("key", F.xxhash64("f", "s")).select("key", "id", "n", "m", "below_f", "below_s", *(F.get("bits", F.lit(i)).alias(f"w{i}") for i in range(BITS)))
    return own.join(own.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi")


def _unruled(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """(a, b, ca, cb, na, nb) of rows a and pivots b, each pair at its least key alone, that may be linked."""
    lacking = [" + ".join(f"bit_count({x}.w{i} & ~{y}.w{i})" for i in range(BITS)) for x, y in ("ab", "ba")]
    bounds = ["a.m", "b.m", f"(a.n - ({lacking[0]}))", f"(b.n - ({lacking[1]}))"]  # on the size of the intersection, cheapest first
    may = " and ".join(f"{100 + SIMILAR} * {most} >= {SIMILAR} * (a.n + b.n)" for most in bounds)
    met = "a.key = b.key and (a.place > b.place or a.place = b.place and a.id > b.id) and a.component <> b.component"
    least_key = "not arrays_overlap(a.below_f, b.below_f) and not arrays_overlap(a.below_s, b.below_s)"
    pairs = rows.join(pivots, F.expr(f"{met} and {may} and {least_key}"))
    return pairs.selectExpr("a.id as a", "b.id as b", "a.component as ca", "b.component as cb", "a.n as na", "b.n as nb")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row: components of links between documents' whole shingle sets.

    Documents without words are linked with nothing, and so are rows of null id, which have a null component and stay.
    Equal sets are one class from the start; classes are compared by representatives, which loses no link. Rows that
    repeat an id are one document. Ids are integers; other columns are ignored; an empty table gives an empty one.
    What is worked out on the way is removed from the shared folder. Per document 2 * M signatures are shuffled, shared ones once more; shingle sets only of documents with a shared key.
    """
    small_batches(docs.sparkSession)
    made: list[str] = []
    signed = checkpointed(_signed(docs, id_col, text_col))
    filled = signed.where("n > 0 and id is not null")
    classes = filled.groupBy("shape").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("signatures").alias("signatures"))
    drawn = classes.select("rep", "n", F.posexplode("signatures").alias("at", "signature"))
    shared = drawn.groupBy("signature").count().where("count > 1").select("signature")
    both = drawn.join(shared, "signature").groupBy("rep", "n").agg(
        F.collect_list(F.when(F.col("at") < M, F.col("signature"))).alias("first"), F.collect_list(F.when(F.col("at") >= M, F.col("signature"))).alias("second")
    )
    both = checkpointed(both)
    crossed = both.select(F.col("rep").alias("id"), "n", F.explode("first").alias("f"), "second").select("id", "n", "f", F.explode("second").alias("s"))
    keyed = crossed.select("id", "n", F.xxhash64("f", "s").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("least")).where("members > 1")
    tables = checkpointed(keyed.join(sizes, "key"))
    labels = written(tables.groupBy("id").agg(F.min("n").alias("n"), F.min("least").alias("least")).withColumn("component", F.col("id")), made)
    sets = checkpointed(_sets(docs, id_col, text_col, labels))
    sized = labels.select("id", "n")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of (a, b, ca, cb, na, nb) whose whole sets are linked, as edges between components."""
        near = pairs.where(f"100 * least(na, nb) >= {SIMILAR} * greatest(na, nb)")
        left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        both = near.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
        return both.where(f"100 * common >= {SIMILAR} * (na + nb - common)").select(F.col("ca").alias("a"), F.col("cb").alias("b"))

    def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
        edges = written(edges.distinct(), made)
        if edges.isEmpty():
            return labels
        roots = connected(edges, made).withColumnRenamed("node", "component")
        return written(labels.join(roots, "component", "left").withColumn("component", F.coalesce("root", "component")).drop("root"), made)

    leads = sized.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("id").alias("cb"))
    first = labels.where("least < id").select(F.col("id").alias("a"), F.col("least").alias("b"), F.col("id").alias("ca"), F.col("n").alias("na")).join(leads, "b")
    labels = merged(labels, confirmed(first))

    def open_tables(labels: DataFrame) -> DataFrame:
        """Rows of the keys whose members are still in two components or more."""
        placed = tables.select("key", "id", "n", "members").join(labels.select("id", "component"), "id")
        keys = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
        return written(placed.join(keys, "key", "left_semi"), made)

    # rounds of one comparison a document at most: with one of the leads of its open keys, drawn anew each round
    for draw in range(DRAWS):
        rows = open_tables(labels)
        if rows.isEmpty():
            break
        lead = F.struct(F.xxhash64("id", F.lit(draw)).alias("at"), F.col("id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"))
        leads_of = rows.groupBy("key").agg(F.min(lead).alias("lead"))
        met = rows.join(leads_of, "key").where("lead.cb <> component").groupBy("id", "component", "n").agg(F.min("lead").alias("lead"))
        labels = merged(labels, confirmed(met.select(F.col("id").alias("a"), "lead.b", F.col("component").alias("ca"), "lead.cb", F.col("n").alias("na"), "lead.nb")))

    # then every pair of an open key that is in two components and that no bound rules out, pivots by slices that grow
    able = _able(open_tables(labels).select("id", "component", "n").distinct(), sets)
    rows = written(_rows(both, able.join(sets.select("id", "bits"), "id")), made)
    most, low, high = rows.groupBy("key").count().agg(F.max("count")).first()[0] or 0, 0, 4
    while low < most:
        placed = rows.join(labels.select("id", "component"), "id")
        keys = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
        placed = written(placed.join(keys, "key", "left_semi").withColumn("place", _place("id")), made)
        if placed.isEmpty():
            break
        # slices are of places, the same in every key, so that a pair is met in one round alone: that of its pivot
        slice_ = f"place * {most} >= {low}" + (f" and place * {most} < {high}" if high < most else "")
        pairs = _unruled(placed.alias("a"), placed.where(slice_).alias("b"))
        labels = merged(labels, confirmed(written(pairs, made)))
        low, high = high, high * GROWTH

    members = signed.join(classes.select("shape", "rep"), "shape", "left")
    found = members.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    out = checkpointed(found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")))
    for df in (signed, both, tables, sets):
        forgotten(df)
    for folder in made:
        removed(docs.sparkSession, folder)
    return out


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_duplicates() keeps, one document of each component, with all their columns, whatever their
    names. Nulls, repeats, ties, empty tables and long texts are as there."""
    gone = near_duplicates(docs, id_col, text_col).where("not kept").select(id_col)
    return without(docs, gone, id_col)
