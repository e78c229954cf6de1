"""Graphs as edge tables: bounded reachability, simple-path trees, exploitability."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import checkpoint_folder, dropped, written


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() in the folder the cluster names in spark.checkpoint.dir; a temporary one only where that is unset on one machine."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def reachable(edges: DataFrame, max_depth: int = 10, src: str = "src", dst: str = "dst", starts: DataFrame | None = None) -> DataFrame:
    """(src, dst, depth): nodes reachable in at most ``max_depth`` hops with their least depth, by a frontier that shrinks.

    ``starts``, a frame of one column, are the nodes to start from; without it all are, and the result has a row for each
    pair that is connected. A node on a cycle reaches itself. Each hop joins only the pairs found last with the edges.
    """
    edges = cut_lineage(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct())
    step = edges.select(F.col("src").alias("via"), F.col("dst").alias("next"))
    first = edges if starts is None else edges.join(starts.toDF("src").distinct(), "src", "left_semi")
    found = frontier = first.withColumn("depth", F.lit(1))
    for depth in range(2, max_depth + 1):
        fresh = frontier.select("src", F.col("dst").alias("via")).join(step, "via").select("src", F.col("next").alias("dst")).distinct()
        frontier = cut_lineage(fresh.join(found, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def simple_paths(edges: DataFrame, root: Column | str, max_depth: int = 6) -> DataFrame:
    """(path): all simple paths from a root, as arrays of nodes; a node occurs once on a path. A level is worked out once."""
    here = edges.select(F.col("src"), F.col("dst")).distinct()
    level = edges.sparkSession.range(1).select(F.array(F.lit(root) if isinstance(root, str) else root).alias("path"))
    found = level
    for _ in range(max_depth):
        level = cut_lineage(level.join(here, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path")))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def rooted(rows: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, root, depth) of each row of a hierarchy given by a parent's id, roots at 0, at any depth, by pointer doubling.

    Each row points to an ancestor and knows how far it is; in a round it takes over the pointer of what it points to, so the
    distance doubles, and rounds are the logarithm of the depth. Rows that point to a root are done and not joined again. Root and
    depth are null for rows on a cycle or below one, and for those whose uppermost parent isn't a row; ids are unique, and not null.
    """
    spark, made = rows.sparkSession, []
    known = rows.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent")).where("id is not null")
    here = known.select(F.col("id").alias("ptr"))
    start = known.join(here.withColumn("there", F.lit(True)), F.col("parent") == F.col("ptr"), "left")
    state = start.select("id", F.when(F.col("parent").isNull(), F.col("id")).otherwise(F.col("ptr")).alias("ptr"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("far"), F.col("parent").isNull().alias("top"))
    state = written(state, made)
    rounds = max(1, math.ceil(math.log2(max(2, state.count())))) + 1
    # a row is done if it is a root or points to one; what points nowhere has no root
    tops = state.where("top").select(F.col("id").alias("ptr"))
    done = written(state.join(tops, "ptr", "left_semi").select("id", F.col("ptr").alias("root"), F.col("far").alias("depth")), made)
    left = written(state.where("ptr is not null and not top").join(tops, "ptr", "left_anti").select("id", "ptr", "far"), made)
    found = done
    for _ in range(rounds):
        if left.isEmpty():
            break
        next_done = left.join(found.select(F.col("id").alias("ptr"), "root", "depth"), "ptr").select("id", "root", (F.col("far") + F.col("depth")).alias("depth"))
        next_left = left.join(left.select(F.col("id").alias("ptr"), F.col("ptr").alias("onward"), F.col("far").alias("more")), "ptr").select("id", F.col("onward").alias("ptr"), (F.col("far") + F.col("more")).alias("far"))
        found = found.unionByName(written(next_done, made))
        left = written(next_left, made)
    out = written(known.select("id").join(found, "id", "left").select(F.col("id").alias(id_col), "root", "depth"))
    dropped(spark, made)
    return out


def descendants(rows: DataFrame, id_col: str, parent_col: str, max_depth: int | None = None) -> DataFrame:
    """(root, id, depth): everything under each row that has no parent, itself included at 0, at any depth unless ``max_depth`` is given."""
    found = rooted(rows, id_col, parent_col).where("root is not null").select("root", F.col(id_col).alias("id"), "depth")
    return found if max_depth is None else found.where(F.col("depth") <= max_depth)


def exploitability(sink_score: Column, source_bonus: Column, variables: Column) -> Column:
    return F.least(F.lit(10.0), F.lit(5.0) + sink_score + source_bonus + F.least(variables * 0.5, F.lit(2.0)))
