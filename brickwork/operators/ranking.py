"""Ranked tiers, streaks, spans and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brickwork.sources.workspace import written


def priority_tiers(df: DataFrame, keys: list[str], score: Column, tie: Column, hot: float = 0.10, warm: float = 0.30) -> DataFrame:
    """hot, warm or cold by the rank of the score within each key; at least one hot row and one warm row."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(score.desc(), tie))
    out = df.withColumn("__rank", rank).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    # shares of whole counts in whole numbers, as a truncated product would be
    n_hot = F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(hot)))
    n_warm = F.greatest(n_hot + 1, F.floor(F.col("__n") * F.lit(warm)))
    tier = F.when(F.col("__rank") <= n_hot, "hot").when(F.col("__rank") <= n_warm, "warm").otherwise("cold")
    return out.withColumn("tier", tier).drop("__rank", "__n")


def leading_streak(df: DataFrame, keys: list[str], failed: Column, *newest_first: Column) -> DataFrame:
    """How many rows of each key fail in a row, from the newest on."""
    w = Window.partitionBy(*keys).orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, 0)
    good = F.sum(F.when(failed, 0).otherwise(1)).over(w)
    return df.select(*keys, good.alias("good")).groupBy(*keys).agg(F.count_if(F.col("good") == 0).alias("streak"))


def densest_span(df: DataFrame, keys: list[str], day: str, days: int, least: int) -> DataFrame:
    """For each key the span of ``days`` days after a row's day that holds most rows, the earliest on ties.

    Rows of one day are counted first, so a hot day is one row in the window.
    """
    daily = df.groupBy(*keys, day).agg(F.count("*").alias("c"))
    number = F.unix_date(day)
    w = Window.partitionBy(*keys).orderBy(number).rangeBetween(0, days)
    spans = daily.select(*keys, F.col(day).alias("starts"), F.sum("c").over(w).alias("n"))
    best = spans.groupBy(*keys).agg(F.max_by(F.struct("starts", "n"), F.struct("n", -F.unix_date("starts"))).alias("b"))
    return best.select(*keys, "b.starts", "b.n").where(F.col("n") >= least)


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset+1 to offset+limit of an order that ends in a unique key, with their position.

    The order and limit are a top-k, so only the page's rows reach the numbering.
    """
    top = df.orderBy(*order).limit(offset + limit)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*order))).where(F.col("pos") > offset)


def positions(df: DataFrame, keys: list[Column], pos: str = "pos") -> DataFrame:
    """Every row with its place in the whole order, from 1; ``keys`` must end with a unique one.

    The rows are sorted over all partitions; a place is that within the
    partition and the number of rows in the partitions before, so no task sees
    more than its own range.
    """
    here = F.monotonically_increasing_id()  # the partition above 33 bits, the row within it below
    placed = written(df.orderBy(*keys).withColumn("__at", here), "ordered")
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))  # one row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("__part", before.alias("__before")))
    place = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("__part", part).join(offsets, "__part").withColumn(pos, place).drop("__at", "__part", "__before")
