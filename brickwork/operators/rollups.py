"""Counts, histograms and completeness measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def zero_filled(counts: DataFrame, dimension: DataFrame, key: str, value: str) -> DataFrame:
    """Every member of the dimension, with 0 where nothing was counted."""
    return dimension.join(counts, key, "left").select(*dimension.columns, F.coalesce(value, F.lit(0)).alias(value))


def histogram(df: DataFrame, value: Column, steps: list[tuple[str, Column]], otherwise: str, missing: str) -> DataFrame:
    """Counts by the first step that holds; null values have their own bucket."""
    bucket = F.when(value.isNull(), missing)
    for name, test in steps:
        bucket = bucket.when(test, name)
    return count_by(df.select(bucket.otherwise(otherwise).alias("bucket")), "bucket")


def filled(column: Column, *sentinels: str) -> Column:
    """1 where there is a value other than the sentinels (the empty text if none are given)."""
    return (column.isNotNull() & ~column.isin(*(sentinels or ("",)))).cast("int")


def fill_rates(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Share of non-null values in whole percent, rounded half to even or down."""
    rate = lambda c: F.lit(100.0) * F.count(c) / F.count("*")
    return df.agg(*[(F.bround(rate(c), 0) if how == "even" else F.floor(rate(c))).cast("long").alias(c) for c, how in columns.items()])
