"""Ownership walks over an edge table (child, parent)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwork.sources.workspace import written


def corporate_walk(edges: DataFrame, depth: int) -> DataFrame:
    """root, node, level for every path upwards of at most ``depth`` edges without a repeated node.

    One join a level; a path carries its own nodes, so cycles end by themselves.
    """
    steps = edges.select("child", "parent")
    level = steps.where("child <> parent").select(F.col("child").alias("root"), F.col("parent").alias("node"), F.array("child", "parent").alias("seen"))
    found = []
    for k in range(1, depth + 1):
        found.append(level.select("root", "node", F.lit(k).alias("level")))
        if k < depth:
            level = level.join(steps, F.col("child") == F.col("node")).where(~F.array_contains("seen", F.col("parent"))).select("root", F.col("parent").alias("node"), F.array_append("seen", F.col("parent")).alias("seen"))
    return reduce(DataFrame.unionAll, found)


def depth_first_walk(edges: DataFrame, depth: int, order: str = "parent", max_rounds: int = 60) -> DataFrame:
    """root, node, level, path: what a depth-first walk upwards from each child lists, a node being expanded once, where it is met first, and up to ``depth`` edges away.

    A walk meets edges in the order of their paths (the values of ``order`` from
    the root on), so a node is expanded at the least path that leads to it from
    where another one is expanded. All roots take that least path together: each
    round takes the paths of the last one a step further and keeps one for each
    (root, node), until none changes. Sorted by ``path``, the rows of a root are in
    the order of its walk.
    """
    steps = written(edges.select("child", "parent", F.col(order).alias("step")).distinct(), "edges")
    roots = steps.select(F.col("child").alias("root"), F.col("child").alias("node"), F.array().cast("array<long>").alias("path")).distinct()
    met, state = roots, None
    for _ in range(max_rounds):
        further = met.where(F.size("path") < depth - 1).join(steps, F.col("node") == F.col("child"))
        further = further.select("root", F.col("parent").alias("node"), F.array_append("path", F.col("step").cast("long")).alias("path"))
        met = written(roots.unionByName(further).groupBy("root", "node").agg(F.min("path").alias("path")), "walk")
        new = met.agg(F.count("*"), F.sum(F.xxhash64("root", "node", "path").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"walks did not settle in {max_rounds} rounds")
    out = met.join(steps, F.col("node") == F.col("child"))
    return out.select("root", F.col("parent").alias("node"), (F.size("path") + 1).alias("level"), F.array_append("path", F.col("step").cast("long")).alias("path"))
