"""Inverted-file index of vectors: lists around centres, probing of the nearest, exact scores, and bounds that make it exact.

Centres are fitted on a bounded sample; every row is in the list of its nearest centre, in a Parquet table partitioned by list,
with its other columns, so that a metadata filter is pushed into the lists that are read. A search meets packed queries with
packed vectors by list, an equality join whose large lists adaptive execution splits; no list is gathered into a task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import broadcast_small, removed, shared_folder
from ..ship import to_workers
from .retrieval import _matrix, top_scores

#: Rows that centres are fitted on, most lists, and rounds of the fit.
SAMPLE, LISTS, ROUNDS = 20_000, 1024, 12
#: List of the vectors without direction, which any query is compared with.
NOWHERE = -1
#: Vectors and queries of a pack, and bytes of packed queries up to which they are broadcast.
PACK, QUERIES, BYTES = 1024, 256, 32 << 20
#: Room for rounding in bounds of angles.
EASE = 1e-6


@dataclass
class VectorIndex:
    """Centres as unit rows, and by list the number of rows and the largest angle between a row and its centre."""

    spark: SparkSession
    folder: str
    centres: np.ndarray
    id_col: str
    vec_col: str
    sizes: dict[int, int] = field(default_factory=dict)
    radii: dict[int, float] = field(default_factory=dict)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)

    def measure(self) -> None:
        """Sizes and radii, two numbers a list."""
        found = self.rows().groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle")).collect()
        self.sizes, self.radii = {r["list"]: r["n"] for r in found}, {r["list"]: r["angle"] for r in found}

    def add(self, vectors: DataFrame) -> None:
        """Put more rows, of the same columns, into the lists; centres stay."""
        _listed(vectors, self).write.mode("append").partitionBy("list").parquet(self.folder)
        self.measure()

    def drop(self) -> None:
        removed(self.spark, self.folder)


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def fitted(rows: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centres of unit rows by spherical k-means: first centres far from each other, empty ones moved to the worst fitted row."""
    rows, rng = unit(rows), np.random.default_rng(seed)
    rows = rows[np.any(rows != 0, axis=1)]
    lists = min(lists, len(np.unique(rows, axis=0)) if len(rows) else 0)
    if not lists:
        return np.zeros((0, rows.shape[1] if rows.ndim == 2 else 0))
    chosen = [int(rng.integers(len(rows)))]
    far = 1 - rows @ rows[chosen[0]]
    while len(chosen) < lists:
        weights = np.clip(far, 0, None) ** 2
        chosen.append(int(rng.choice(len(rows), p=weights / weights.sum())) if weights.sum() > 0 else int(rng.integers(len(rows))))
        far = np.minimum(far, 1 - rows @ rows[chosen[-1]])
    centres = rows[chosen]
    for _ in range(rounds):
        scores = rows @ centres.T
        nearest = scores.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        empty = np.flatnonzero(np.bincount(nearest, minlength=len(centres)) == 0)
        if len(empty):
            sums[empty] = rows[np.argsort(scores.max(axis=1), kind="stable")[: len(empty)]]
        centres = unit(sums)
    return centres


def _angles(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit(rows) @ centres.T, -1.0, 1.0))


def _listed(vectors: DataFrame, index: VectorIndex) -> DataFrame:
    """The rows with an id and a vector, and their list and angle to its centre. Rows go to tasks by list and size."""
    sent = index.spark.sparkContext.broadcast(index.centres)
    source = vectors.where(F.col(f"`{index.vec_col}`").isNotNull() & F.col(f"`{index.id_col}`").isNotNull())
    at = source.columns.index(index.vec_col)

    def run(batches):
        centres = sent.value
        for batch in batches:
            lists, angles = np.full(len(batch), NOWHERE, np.int32), np.zeros(len(batch))
            if len(batch) and len(centres):
                rows = _matrix(batch.column(at))
                away = _angles(rows, centres)
                there = np.any(rows != 0, axis=1)
                lists, angles = np.where(there, away.argmin(axis=1), NOWHERE).astype(np.int32), np.where(there, away.min(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists), pa.array(angles)], names=[*batch.schema.names, "list", "angle"])

    schema = source.schema.simpleString()[len("struct<") : -1]
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) if schema else ""
    return source.mapInArrow(run, f"{names}, list int, angle double").hint("rebalance", "list")


def build(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, id_col: str = "vec_id", vec_col: str = "embedding") -> VectorIndex:
    """Index every row of vectors that has an id and a vector, of equal length, with all its columns (none is named list or angle).

    Centres are fitted on at most ``sample`` rows, those of the least hashes of their ids, which the driver gets; there are
    ``lists`` of them, by default the root of the number of rows and LISTS at most. Rows of length zero have a list of their own.
    """
    spark = vectors.sparkSession
    to_workers(spark)
    known = vectors.where(F.col(f"`{vec_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
    wanted = lists or min(LISTS, max(1, round(known.count() ** 0.5)))
    drawn = known.orderBy(F.xxhash64(F.col(f"`{id_col}`")), F.col(f"`{id_col}`")).limit(sample).select(F.col(f"`{vec_col}`").alias("v")).toArrow()
    index = VectorIndex(spark, shared_folder(spark, "vectors"), fitted(_matrix(drawn.column("v").combine_chunks()), wanted), id_col, vec_col)
    _listed(vectors, index).write.partitionBy("list").parquet(index.folder)
    if drawn.num_rows:
        index.measure()
    return index


def _probes(queries: DataFrame, index: VectorIndex, nprobe: int | None, again: bool) -> DataFrame:
    """(list, names, vectors): packs of queries (id, v, known) by the lists that they look into.

    At first these are the ``nprobe`` nearest, and the list of vectors without direction. ``again``, these are the others that may
    hold a row as near as ``known``, the score of the last place so far: no row is nearer to the query than its centre is, less
    the list's radius. A query without direction looks into all.
    """
    sent = index.spark.sparkContext.broadcast((index.centres, np.array([index.radii.get(i, -np.inf) for i in range(len(index.centres))])))

    def run(batches):
        centres, radii = sent.value
        for batch in batches:
            if not len(batch):
                continue
            names, rows = batch.column(0), _matrix(batch.column(1))
            away = _angles(rows, centres) if len(centres) else np.zeros((len(rows), 0))
            first = np.zeros(away.shape, bool)
            if len(centres):
                n = min(nprobe or len(centres), len(centres))
                np.put_along_axis(first, np.argsort(away, axis=1, kind="stable")[:, :n], True, axis=1)
                first |= ~np.any(rows != 0, axis=1)[:, None]
            into = first
            if again:
                score = np.array(batch.column(2).to_pylist(), float)
                reach = np.arccos(np.clip(np.where(np.isnan(score), -1.0, score) - EASE, -1.0, 1.0))
                into = ~first & (away - radii <= reach[:, None] + EASE)
            columns = [*((i, np.flatnonzero(into[:, i])) for i in range(len(centres))), *([] if again else [(NOWHERE, np.arange(len(rows)))])]
            packs = [(i, found[at : at + QUERIES]) for i, found in columns for at in range(0, len(found), QUERIES)]
            if packs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in packs], pa.int32()), pa.array([names.take(pa.array(f)).to_pylist() for _, f in packs], pa.list_(pa.int64())), pa.array([rows[f].ravel() for _, f in packs], pa.list_(pa.float64()))],
                    names=["list", "names", "vectors"],
                )

    return queries.select("id", "v", "known").mapInArrow(run, "list int, names array<long>, vectors array<double>")


def _packed(batches):
    """Packs of a list's vectors, within a batch."""
    for batch in batches:
        lists, ids, rows = batch.column(0).to_numpy(), batch.column(1), _matrix(batch.column(2))
        packs = [found[at : at + PACK] for i in np.unique(lists) for found in (np.flatnonzero(lists == i),) for at in range(0, len(found), PACK)]
        if packs:
            yield pa.RecordBatch.from_arrays(
                [pa.array([lists[f[0]] for f in packs], pa.int32()), pa.array([ids.take(pa.array(f)).to_pylist() for f in packs], pa.list_(pa.int64())), pa.array([rows[f].ravel() for f in packs], pa.list_(pa.float64()))],
                names=["list", "ids", "rows"],
            )


def _met(index: VectorIndex, packs: DataFrame, k: int, digits: int, condition: Column | str | None) -> DataFrame:
    """(query_id, vec_id, score): of each pack of vectors, the k best of each query that looks into its list."""
    lists = [r["list"] for r in packs.select("list").distinct().collect()]  # numbers of lists
    rows = index.rows().where(F.col("list").isin(lists))
    if condition is not None:
        rows = rows.where(condition)
    kept = rows.select("list", F.col(f"`{index.id_col}`").cast("long").alias("id"), F.col(f"`{index.vec_col}`").cast("array<double>").alias("v"))
    pairs = kept.mapInArrow(_packed, "list int, ids array<long>, rows array<double>").join(broadcast_small(packs, size=BYTES), "list").select("ids", "rows", "names", "vectors")

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                ids, names = (np.asarray(batch.column(c)[i].values) for c in (0, 2))
                rows, queries = (np.asarray(batch.column(c)[i].values).reshape(len(n), -1) for c, n in ((1, ids), (3, names)))
                at, found, scores = top_scores(ids, rows, queries, k, digits)
                yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(found), pa.array(scores)], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(queries: DataFrame, index: VectorIndex, k: int, nprobe: int | None = 16, condition: Column | str | None = None, exact: bool = False, query_id: str = "query_id", query_vec: str = "query", digits: int = 6) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best rows of each query by exact cosine in the lists that it looks into; ties go by id.

    ``nprobe`` lists are looked into, all if it is None. ``condition``, over the index's columns, holds for the rows that count.
    ``exact`` looks then into every list that may hold a better row, by the lists' radii, so the result is that of all rows. Ids
    are integers; queries without an id or a vector have no rows.
    """
    given = queries.where(F.col(f"`{query_vec}`").isNotNull() & F.col(f"`{query_id}`").isNotNull()).select(F.col(f"`{query_id}`").cast("long").alias("id"), F.col(f"`{query_vec}`").cast("array<double>").alias("v"))
    if not index.sizes:
        return index.spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    first = _best(_met(index, _probes(given.withColumn("known", F.lit(None).cast("double")), index, nprobe, False), k, digits, condition), k)
    if not exact or nprobe is None or nprobe >= len(index.centres):
        return first
    last = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("known"))
    more = _met(index, _probes(given.join(broadcast_small(last), "id", "left").select("id", "v", "known"), index, nprobe, True), k, digits, condition)
    return _best(first.drop("rank").unionByName(more), k)


def probes_for(queries: DataFrame, index: VectorIndex, k: int, target: float = 0.95, sample: int = 64, query_id: str = "query_id", query_vec: str = "query") -> int:
    """The number of lists that queries must look into for ``target`` of their k best rows, measured on ``sample`` of them (those of
    the least hashes of their ids) by an exact search."""
    given = queries.where(F.col(f"`{query_vec}`").isNotNull() & F.col(f"`{query_id}`").isNotNull()).select(F.col(f"`{query_id}`").cast("long").alias("query_id"), F.col(f"`{query_vec}`").cast("array<double>").alias("query"))
    drawn = given.orderBy(F.xxhash64("query_id"), "query_id").limit(sample).toArrow()
    if not drawn.num_rows or not len(index.centres):
        return 1
    names = drawn.column("query_id").to_pylist()
    order = np.argsort(_angles(_matrix(drawn.column("query").combine_chunks()), index.centres), axis=1, kind="stable")
    places = {(name, int(i)): at for name, own in zip(names, order) for at, i in enumerate(own, 1)}
    best = search(index.spark.createDataFrame(drawn), index, k, 1, exact=True)
    where = index.rows().select(F.col(f"`{index.id_col}`").cast("long").alias("vec_id"), "list")
    found = sorted(places.get((r["query_id"], r["list"]), 1) for r in where.join(F.broadcast(best), "vec_id").select("query_id", "list").collect())  # k rows a drawn query
    return found[min(len(found), math.ceil(len(found) * target)) - 1] if found else 1


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the rows of an exact search that another one found."""
    keys = ["query_id", "vec_id"]
    hit, total = exact.select(*keys).join(found.select(*keys).withColumn("hit", F.lit(1)), keys, "left").agg(F.sum("hit"), F.count(F.lit(1))).first()
    return (hit or 0) / total if total else 1.0
