"""Functional mutation: (state, delta) -> new state, and what changed.

Each is one join on the key; a delta with several rows of a key is first
reduced to one by its sequence column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwork.operators.joining import best_per_key


def latest(delta: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    return best_per_key(delta, keys, F.desc(sequence)).drop(sequence)


def upsert(state: DataFrame, delta: DataFrame, keys: list[str], wins) -> DataFrame:
    """Full outer merge; ``wins(old, new)`` gives each field's value where a key is on both sides."""
    fields = [c for c in state.columns if c not in keys]
    d = delta.select(*keys, *[F.col(c).alias(f"new_{c}") for c in fields], F.lit(True).alias("in_delta"))
    s = state.withColumn("in_state", F.lit(True))
    both = F.col("in_state") & F.col("in_delta")
    value = lambda c: F.when(both, wins(F.col(c), F.col(f"new_{c}"))).when(F.col("in_state"), F.col(c)).otherwise(F.col(f"new_{c}"))
    return s.join(d, keys, "full").select(*keys, *[value(c).alias(c) for c in fields])


def non_null(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def truthy(old: Column, new: Column) -> Column:
    """Zero and the empty text do not overwrite."""
    text = new.cast("string")
    return F.when(new.isNull() | text.isin("", "0", "0.0", "false"), old).otherwise(new)


def fill_only(old: Column, new: Column) -> Column:
    return F.coalesce(F.nullif(old, F.lit("")), new)


def insert_ignore(state: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    return state.unionByName(delta.join(state.select(*keys), keys, "left_anti"))


def change_log(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per changed field: key, field, old and new value as text."""
    n = new.select(key, *[F.col(f).alias(f"new_{f}") for f in fields])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("old"), F.col(f"new_{f}").cast("string").alias("new")) for f in fields])
    changed = F.filter(pairs, lambda p: ~p.old.eqNullSafe(p.new))
    return old.select(key, *fields).join(n, key).select(key, F.inline(changed))


def by_precedence(writes: DataFrame, key: str, field: str, source: str, ranks: dict[str, int], sequence: str) -> DataFrame:
    """The write that stands for each key and field: highest source rank, then the latest; null writes say nothing."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in ranks.items() for x in p]), F.col(source)), F.lit(10))
    best = F.max_by(F.struct("value", source), F.struct(rank, sequence)).alias("b")
    return writes.where("value IS NOT NULL").groupBy(key, field).agg(best).select(key, field, "b.*")


def upsert_marked(state: DataFrame, delta: DataFrame, keys: list[str], wins, change: str = "change") -> DataFrame:
    """``upsert`` with a column that tells new, changed and unchanged rows; one row a key on both sides."""
    fields = [c for c in state.columns if c not in keys]
    old = state.select(*keys, F.struct(*fields).alias("old_fields"))
    new = upsert(state, delta, keys, wins)
    kind = F.when(F.col("old_fields").isNull(), "new").when(F.struct(*fields).eqNullSafe(F.col("old_fields")), "unchanged").otherwise("changed")
    return new.join(old, keys, "left").select(*keys, *fields, kind.alias(change))
