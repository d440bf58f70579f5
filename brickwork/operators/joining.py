"""Joins that recur in matching and attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_per_key(df: DataFrame, keys: list[str], *order: Column, keep: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``keep`` rows of each key in an order that should end in a tie-break; optionally with their rank."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= keep)
    return out if rank else out.drop(name)


def semi_on_any(left: DataFrame, right: DataFrame, left_keys: list[str], right_key: str) -> DataFrame:
    """Rows with any of several keys on the right: one equi join on the exploded keys, not an OR."""
    row = "__row"
    keyed = left.withColumn(row, F.monotonically_increasing_id()).withColumn("__key", F.explode(F.array_distinct(F.array(*left_keys))))
    found = keyed.join(right.select(F.col(right_key).alias("__key")).distinct(), "__key", "left_semi")
    return found.dropDuplicates([row]).drop(row, "__key")


def first_tier(tiers: list[DataFrame], key: str, *tie: Column) -> DataFrame:
    """For each key the match of the first tier that has one; ``tie`` orders matches within a tier."""
    labelled = [t.withColumn("tier", F.lit(i)) for i, t in enumerate(tiers, 1)]
    both = labelled[0]
    for t in labelled[1:]:
        both = both.unionByName(t)
    return best_per_key(both, [key], F.col("tier"), *tie)


def repoint(df: DataFrame, column: str, merges: DataFrame) -> DataFrame:
    """Replace merged ids (old -> new) in a reference column."""
    m = merges.select(F.col("old").alias("__old"), F.col("new").alias("__new"))
    return df.join(m, df[column] == F.col("__old"), "left").withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")


def repoint_all(tables: dict[str, tuple[DataFrame, list[str]]], merges: DataFrame) -> dict[str, DataFrame]:
    """Several tables, each with the reference columns in which merged ids are to be replaced."""
    out = {}
    for name, (df, columns) in tables.items():
        for column in columns:
            df = repoint(df, column, merges)
        out[name] = df
    return out


def containing(longer: DataFrame, text: str, shorter: DataFrame, part: str, least: int = 1) -> DataFrame:
    """(text, part): the distinct texts of one table with those of the other, of ``least`` letters or more, that are in them.

    A containment join as an equi join: a text of n letters is listed with its
    n * (n + 1) / 2 substrings and meets the others as a whole.
    """
    ends = lambda i: F.sequence(F.lit(least), F.greatest(F.length(text) - i + 1, F.lit(least)))
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.transform(ends(i), lambda k: F.substring(F.col(text), i, k))))
    listed = longer.select(text).where(F.length(text) >= least).distinct().select(text, F.explode(F.array_distinct(cuts)).alias(part))
    return listed.join(shorter.select(part).where(F.length(part) >= least).distinct(), part).select(text, part)
