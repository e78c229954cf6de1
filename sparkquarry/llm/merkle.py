"""Merkle manifests of tables: a tree over the rows of each group, a tree over the groups' roots, and proofs of single rows.

The node store is kept outside of memory. Sorted leaves are cut into runs of ARITY ** HEIGHT; a run's nodes of HEIGHT levels are
made by one task and go to one Parquet folder a height. The tops of the runs are what the next height reads, so a tree of n
leaves takes log(n) / log(ARITY ** HEIGHT) jobs. Proofs are read the other way: a run's row, met by its coordinate, gives the
rest of the path of all its leaves, so leaves are never shuffled again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_small, removed, shared_folder, unused, written

#: Children of a node, levels of a run, and leaves of a run.
ARITY, HEIGHT = 3, 6
RUN = ARITY**HEIGHT
#: Rows, and bytes of their keys, of the table of groups up to which it is broadcast.
GROUPS, BYTES = 100_000, 8 << 20
#: Proof of a row: what stands left and right of its node in each run of siblings, from the leaves up.
PROOF = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value so that no two lists of values are written alike: ``-`` for null, else its UTF-8 byte count, ``:``, its text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def tree_of(group: Column) -> Column:
    """A key that sorts as the group does, null first, and is never null."""
    return F.when(group.isNull(), F.lit("-")).otherwise(F.concat(F.lit("s"), group.cast("string")))


@dataclass
class Manifest:
    """Folders of the node store by height: of the groups' trees and of the tree over them; ``root`` is null without rows."""

    spark: SparkSession
    folder: str
    heights: int
    top_folder: str
    top_heights: int
    root: str | None


def _depth(n: str) -> str:
    """SQL of the number of levels above n leaves: of powers of ARITY below n."""
    return f"aggregate(array({', '.join(f'{ARITY**k}L' for k in range(40))}), 0, (a, p) -> a + if(p < {n}, 1, 0))"


def numbered(nodes: DataFrame, order: list[str], made: list[str]) -> DataFrame:
    """nodes, which have ``tree``, with idx, their place from 0 in their tree by ``order``, and n, the tree's number of nodes.

    Rows are sorted in ranges of (tree, order), so that a tree with a third of all rows is many ranges; places follow from the
    sizes of the ranges before. The driver gets a number a range.
    """
    ranged = written(nodes.repartitionByRange("tree", *order).withColumn("range", F.spark_partition_id()), made)
    parts = ranged.groupBy("range", "tree").agg(F.count(F.lit(1)).alias("c"))
    total, sizes = 0, []
    for r in sorted(parts.groupBy("range").agg(F.sum("c").alias("c")).collect()):
        sizes.append((r["range"], total))
        total += r["c"]
    before = F.broadcast(nodes.sparkSession.createDataFrame(sizes, "range int, before long"))
    first = F.col("before") + F.sum("c").over(Window.partitionBy("range").orderBy("tree")) - F.col("c")
    trees = parts.join(before, "range").withColumn("first", first).groupBy("tree").agg(F.min("first").alias("first"), F.sum("c").alias("n"))
    trees = written(trees, made)
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("tree", *order)) - 1
    placed = ranged.join(before, "range").withColumn("place", place).drop("before", "range")
    return placed.join(broadcast_small(trees, GROUPS, BYTES), "tree").withColumn("idx", F.col("place") - F.col("first")).drop("place", "first")


def runs(nodes: DataFrame) -> DataFrame:
    """(tree, run, n, leaves, levels, top) of nodes (tree, idx, n, digest, payload): a row a run, with its leaves in order, the
    digests of each level from the leaves up, and the node above them all."""
    leaf = F.struct((F.col("idx") % RUN).cast("int").alias("at"), "digest", "payload")
    grouped = nodes.groupBy("tree", F.expr(f"idx div {RUN}").alias("run"), "n").agg(F.array_sort(F.collect_list(leaf)).alias("leaves"))
    parents = f"transform(sequence(0, (size(last) - 1) div {ARITY}), j -> sha2(array_join(slice(last, {ARITY} * j + 1, {ARITY}), ''), 256))"
    step = f"concat(acc, transform(array(element_at(acc, -1)), last -> {parents}))"
    levels = f"aggregate(slice(array({', '.join(map(str, range(HEIGHT)))}), 1, least({_depth('n')}, {HEIGHT})), array(transform(leaves, x -> x.digest)), (acc, l) -> {step})"
    return grouped.withColumn("levels", F.expr(levels)).withColumn("top", F.expr("element_at(element_at(levels, -1), 1)"))


def _stored(nodes: DataFrame, folder: str) -> int:
    """Write the runs of each height to a folder of its own under ``folder``; the number of heights."""
    height, spark = 0, nodes.sparkSession
    while True:
        runs(nodes).write.parquet(f"{folder}/height={height}")
        below, height = spark.read.parquet(f"{folder}/height={height}"), height + 1
        if (below.agg(F.max("n")).first()[0] or 0) <= RUN:
            return height
        nodes = below.where(f"n > {RUN}").selectExpr("tree", "run as idx", f"(n + {RUN - 1}) div {RUN} as n", "top as digest", "cast(null as string) as payload")


def _read(spark: SparkSession, folder: str, heights: int) -> list[DataFrame]:
    return [spark.read.parquet(f"{folder}/height={h}") for h in range(heights)]


def _roots(stores: list[DataFrame]) -> DataFrame:
    """(tree, root) of the trees of a store: their last run is a single one."""
    found = [s.where(f"n <= {RUN}").selectExpr("tree", "top as root") for s in stores]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def build(leaves: DataFrame, order: list[str]) -> Manifest:
    """Store the nodes over leaves: rows of (tree, leaf, payload), and the columns of ``order``, which must tell rows of a tree
    apart unless they are the same in all. ``tree`` and ``leaf`` are strings that aren't null.

    Without rows there is an empty store and no root. Leaves are read once.
    """
    spark, made = leaves.sparkSession, []
    manifest = Manifest(spark, shared_folder(spark, "merkle"), 0, shared_folder(spark, "merkle-top"), 0, None)
    own = leaves.withColumnRenamed("leaf", "digest")
    manifest.heights = _stored(numbered(own, order, made).select("tree", "idx", "n", "digest", "payload"), manifest.folder)
    groups = _roots(_read(spark, manifest.folder, manifest.heights)).selectExpr("'' as tree", "root as digest", "tree as payload")
    manifest.top_heights = _stored(numbered(groups, ["payload"], made).select("tree", "idx", "n", "digest", "payload"), manifest.top_folder)
    top = _roots(_read(spark, manifest.top_folder, manifest.top_heights)).first()
    manifest.root = top and top["root"]
    for folder in made:
        removed(spark, folder)
    return manifest


def _paths(stores: list[DataFrame], endings: DataFrame | None) -> DataFrame:
    """(tree, leaf, payload, root, proof) of each leaf of a store; ``endings`` (tree, ending) is what follows a tree's root."""
    siblings = f"""transform(slice(array({', '.join(f'{ARITY**l}' for l in range(HEIGHT))}), 1, size(levels) - 1), (p, l) -> transform(array(int(x.at div p)), c -> named_struct(
        'left', array_join(slice(levels[l], c - c % {ARITY} + 1, c % {ARITY}), ''), 'right', array_join(slice(levels[l], c + 2, {ARITY - 1} - c % {ARITY}), '')))[0])"""
    above = None
    for store in reversed(stores):
        last = store.where(f"n <= {RUN}").withColumn("root", F.col("top"))
        met = last.withColumn("ending", F.lit(None).cast(PROOF)) if endings is None else last.join(endings, "tree", "left")
        if above is not None:
            met = met.unionByName(store.where(f"n > {RUN}").join(above, ["tree", "run"]))
        leaf = f"transform(leaves, x -> struct(x.at as at, x.digest as leaf, x.payload as payload, concat({siblings}, coalesce(ending, cast(array() as {PROOF}))) as proof))"
        paths = met.select("tree", "run", "root", F.explode(F.expr(leaf)).alias("x"))
        above = paths.selectExpr("tree", f"run * {RUN} + x.at as run", "root", "x.proof as ending")
    return paths.select("tree", "root", "x.leaf", "x.payload", "x.proof")


def proofs(manifest: Manifest) -> DataFrame:
    """(tree, root, leaf, payload, proof) of each leaf: its tree's root, and the siblings from it to the manifest's root."""
    top = _paths(_read(manifest.spark, manifest.top_folder, manifest.top_heights), None)
    endings = top.selectExpr("payload as tree", "proof as ending")
    return _paths(_read(manifest.spark, manifest.folder, manifest.heights), endings)


def nodes(manifest: Manifest) -> DataFrame:
    """(tree, level, idx, digest) of each node of the groups' trees; a top that is a leaf of the next height occurs once."""
    out = None
    for height, store in enumerate(_read(manifest.spark, manifest.folder, manifest.heights)):
        kept = store.withColumn("whole", F.col("n") <= RUN).select("tree", "run", "whole", F.posexplode("levels").alias("l", "row"))
        rows = kept.where(f"l < {HEIGHT} or whole").select("tree", "run", "l", F.posexplode("row").alias("at", "digest"))
        scale = f"cast(pow({ARITY}, {HEIGHT} - l) as bigint)"
        rows = rows.selectExpr("tree", f"l + {height * HEIGHT} as level", f"run * {scale} + at as idx", "digest")
        out = rows if out is None else out.unionByName(rows)
    return out


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof give."""
    return F.aggregate(proof, leaf, lambda acc, p: digest(p["left"], acc, p["right"]))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def verified_rows(docs: DataFrame, tampered: Column, columns: list[str], id_col: str = "doc_id", group_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of docs, the leaves being its ``columns``.

    Where ``tampered``, a condition over docs, holds, a row is verified as if its text had lost its line feeds, else as it is.
    The rows of a group are in order of id, null first, rows of one id by their digest, so equal rows are equal leaves one after
    another. Any column may be null; a null group is a group of its own, the first. Empty tables give no rows; texts may have
    any length; columns that aren't named are ignored, whatever their names.
    """
    leaf = lambda text: digest(*(field(text if c == text_col else F.col(f"`{c}`")) for c in columns))
    text = F.col(f"`{text_col}`")
    changed = F.when(tampered & text.contains("\n"), leaf(F.replace(text, F.lit("\n"), F.lit(""))))
    ident = F.col(f"`{id_col}`")
    leaves = docs.select(tree_of(F.col(f"`{group_col}`")).alias("tree"), ident.alias("id"), leaf(text).alias("leaf"), changed.alias("changed"))
    leaves = leaves.withColumn("payload", F.struct("id", "changed"))
    manifest = build(leaves.select("tree", "id", "leaf", "payload"), ["id", "digest"])
    found = proofs(manifest).withColumn("folded_root", folded(F.coalesce("payload.changed", "leaf"), F.col("proof")))
    return found.select(
        F.col("payload.id").alias(id_col), "leaf", F.col("root").alias("subroot"), F.lit(manifest.root).cast("string").alias("root"),
        proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.lit(manifest.root)).alias("verified"),
    )
