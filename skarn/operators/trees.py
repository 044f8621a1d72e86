"""Paths and subtrees of adjacency lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.operators.components import checkpointed

DEPTH = 100  # titles of a path at most: what lies above them, or goes round a cycle, is left out


def tree_paths(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """id, path (titles from the root down), level of every one of ``nodes(id, parent_id, title)``.

    Nodes whose parent is null, empty or unknown are roots. Paths have the ``depth`` lowest titles; of a node on or below a cycle, these go
    round it. Each round doubles the hops that a path covers, so that few joins reach any depth.
    """
    known = nodes.select(F.col("id").alias("_known"))
    up = nodes.join(known, nodes["parent_id"] == known["_known"], "left").select(
        "id", F.col("_known").alias("_above"), F.array("title").alias("path")
    )
    up, covered = checkpointed(up), 1
    while covered < depth and not up.where("_above is not null").isEmpty():
        higher = up.select(F.col("id").alias("_above"), F.col("_above").alias("_next"), F.col("path").alias("_path"))
        longer = F.concat(F.coalesce("_path", F.array().cast("array<string>")), "path")
        up, covered = checkpointed(up.join(higher, "_above", "left").select("id", F.col("_next").alias("_above"), longer.alias("path"))), 2 * covered
    path = F.when(F.size("path") > depth, F.slice("path", -depth, depth)).otherwise(F.col("path"))
    return up.select("id", path.alias("path")).withColumn("level", F.size("path") - 1)


def subtree(nodes: DataFrame, roots: DataFrame, depth: int = DEPTH) -> DataFrame:
    """root_id and id of all descendants of ``roots(id)``, the roots themselves included."""
    level = checkpointed(roots.select(F.col("id").alias("root_id"), "id"))
    found = level
    for _ in range(depth):
        above = level.select("root_id", F.col("id").alias("parent_id"))
        level = checkpointed(nodes.join(above, "parent_id").select("root_id", "id"))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found.distinct()


def path_prefixes(paths: DataFrame, path: str = "path") -> DataFrame:
    """The distinct folders that lead to each path: path, parent_path, title, level from 0."""
    every = paths.select(F.posexplode(path).alias("level", "title"), F.col(path).alias("_p"))
    return every.select(
        F.slice("_p", 1, F.col("level") + 1).alias("path"),
        F.when(F.col("level") > 0, F.slice("_p", F.lit(1), F.col("level"))).alias("parent_path"), "title", "level",
    ).distinct()
