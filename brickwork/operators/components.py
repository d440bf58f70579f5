"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwork.sources.workspace import written


def hot_above(df: DataFrame, rows: int) -> int:
    """A key is hot with more of ``rows`` rows than this: at most eight keys a shuffle partition are, so they may be broadcast."""
    return max(100, rows // (8 * max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def join_grouped(df: DataFrame, grouped: DataFrame, key: str, n: str, rows: int) -> DataFrame:
    """Inner join of ``df``, of about ``rows`` rows, with one row a key that tells in ``n`` how many rows of ``df`` the key has.

    Rows of hot keys meet theirs by broadcast and stay where they are; the
    others are shuffled, no key with more than a small share of a partition.
    """
    above = hot_above(df, rows)
    columns = [c for c in grouped.columns if c not in (key, n)]
    hot = grouped.where(F.col(n) > above).select(key, F.struct(*columns).alias("__hot"))
    met = df.join(F.broadcast(hot), key, "left")
    few = met.where("__hot IS NULL").drop("__hot").join(grouped.where(F.col(n) <= above).drop(n), key)
    return met.where("__hot IS NOT NULL").select(*df.columns, "__hot.*").unionByName(few)


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """One star step over ``rows`` rows (u, v): each node points its larger (or smaller and own) neighbours at the least one.

    The least neighbour comes from a grouped minimum, with partial sums on the
    map side, and is joined back; no node's neighbours are ever gathered.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("m", "u").alias("m"), "n")
        moved = join_grouped(both.where("v > u"), least, "u", "n", 2 * rows).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        moved = join_grouped(down, least, "u", "n", rows).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of a link; the component is its least node.

    Self links and null ends say nothing. Each round is written to the shared
    folder, so lineage stays short and a lost executor costs one round at most.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    edges = written(edges, "links")
    state, rows = None, edges.count()
    for _ in range(max_rounds):
        edges = written(_star(_star(edges, True, rows), False, rows), "stars")
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state, rows = new, new[0]
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def primaries(merges: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """(old, new): every id that a list of merges replaces, with the one that stands at the end of its chain.

    Merges that hang together, through whatever chains, are one group; what none
    of its merges replaces stands for it, the least such id if there are several,
    and the least of all where they go in a circle.
    """
    known = written(merges.select(F.col(old).alias("old"), F.col(new).alias("new")).where("old <> new").distinct(), "merges")
    nodes = components(known, "old", "new")
    replaced = known.select(F.col("old").alias("node")).distinct().withColumn("gone", F.lit(True))
    first = nodes.join(replaced, "node", "left").groupBy("component").agg(F.coalesce(F.min(F.when(F.col("gone").isNull(), F.col("node"))), F.min("node")).alias("new"))
    return nodes.join(first, "component").where("node <> new").select(F.col("node").alias("old"), "new")
