"""Changes that can be taken back: a state, a change, and what the state was before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def backed_up(state: DataFrame, backup: DataFrame | None, key: str, fields: list[str], where: Column) -> DataFrame:
    """key and fields of the rows that a change is about to touch, after those backed up before: the first copy of a key stays."""
    found = state.where(where).select(key, *fields)
    return found if backup is None else backup.select(key, *fields).unionByName(found.join(backup.select(key), key, "left_anti"))


def changed(state: DataFrame, where: Column, changes: dict[str, Column]) -> DataFrame:
    """The state with new values where the condition holds."""
    holds = F.coalesce(where, F.lit(False))
    return state.select(*[F.when(holds, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in state.columns])


def taken_back(state: DataFrame, backup: DataFrame, key: str) -> DataFrame:
    """The state with all backed-up fields as they were; rows without a copy stay as they are."""
    fields = [c for c in backup.columns if c != key]
    old = backup.select(key, F.lit(True).alias("__old"), *[F.col(c).alias(f"__old_{c}") for c in fields])
    joined = state.join(old, key, "left")
    return joined.select(*[F.when(F.col("__old"), F.col(f"__old_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in state.columns])
