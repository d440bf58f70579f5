"""Gap filling as declared steps: what a step fills, what it reads, which tables it needs.

The steps are ordered so that each comes after those that fill what it reads;
each side table is reduced to one row a key and joined once, however many steps
use it; a step fills only what is missing, so missing values only decrease, and
the step that filled a field is kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """Fills fields of a row from its own columns and side tables, as far as they are missing.

    ``fills`` gives each field's value; the first field is the step's own, and
    the others are filled only where it is. ``reads`` names fields that
    other steps may fill first; ``uses`` names side tables.
    """

    name: str
    fills: dict[str, Column]
    reads: tuple[str, ...] = ()
    uses: tuple[str, ...] = ()
    where: Column | None = None


@dataclass(frozen=True)
class Side:
    """A table with one row a key, joined to a column of the row (or an expression of it)."""

    table: DataFrame
    key: str
    on: str | Column
    #: Fields that the expression reads, where steps may fill them first.
    reads: tuple[str, ...] = field(default=())


def missing(column: str, kind: str) -> Column:
    """Null or, in a text, empty."""
    return F.col(column).isNull() | (F.col(column) == "") if kind == "string" else F.col(column).isNull()


def ordered(steps: list[Step], sides: dict[str, Side]) -> list[Step]:
    """The steps so that what fills a field comes before what reads it; of one field's steps, the first declared comes first."""
    by_name = {s.name: s for s in steps}
    if len(by_name) < len(steps):
        raise ValueError("steps need names of their own")
    graph: dict[str, list[str]] = {s.name: [] for s in steps}
    for k, s in enumerate(steps):
        reads = {*s.reads, *(r for u in s.uses for r in sides[u].reads)}
        for j, other in enumerate(steps):
            if other is not s and (reads & set(other.fills) or j < k and set(s.fills) & set(other.fills)):
                graph[s.name].append(other.name)
    return [by_name[n] for n in TopologicalSorter(graph).static_order()]


def fill_gaps(df: DataFrame, steps: list[Step], sides: dict[str, Side] | None = None) -> DataFrame:
    """``df`` with its gaps filled, and ``filled_by``: a map from each filled field to its step.

    A side table is joined before the first step that uses it, after the steps
    that fill its key. Its columns must not clash with those of ``df``; they are
    dropped at the end.
    """
    sides, columns, kinds = sides or {}, df.columns, dict(df.dtypes)
    fields = list(dict.fromkeys(f for s in steps for f in s.fills))
    by = {f: f"__by_{f}" for f in fields}
    out = df.withColumns({b: F.lit(None).cast("string") for b in by.values()})
    joined: set[str] = set()
    for step in ordered(steps, sides):
        for name in step.uses:
            if name not in joined:
                side = sides[name]
                on = F.col(side.on) if isinstance(side.on, str) else side.on
                right = side.table.withColumnRenamed(side.key, f"__key_{name}")
                out = out.join(right, on == F.col(f"__key_{name}"), "left")
                joined.add(name)
        own = next(iter(step.fills))
        open_ = missing(own, kinds[own]) & (step.where if step.where is not None else F.lit(True))
        value = {f: F.col(f"__new_{f}") for f in step.fills}
        there = lambda f: value[f].isNotNull() & (value[f] != "") if kinds[f] == "string" else value[f].isNotNull()
        out = out.withColumns({f"__new_{f}": F.when(open_, v.cast(kinds[f])) for f, v in step.fills.items()})  # once each: looked at twice below
        out = out.withColumn("__done", F.coalesce(there(own), F.lit(False)))
        fits = {f: F.col("__done") if f == own else F.col("__done") & missing(f, kinds[f]) & there(f) for f in step.fills}
        new = {f: F.when(fits[f], value[f]).otherwise(F.col(f)) for f in step.fills} | {by[f]: F.when(fits[f], step.name).otherwise(F.col(by[f])) for f in step.fills}
        out = out.withColumns(new).drop("__done", *[f"__new_{f}" for f in step.fills])
    filled = F.map_filter(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(by[f]))]), lambda _, v: v.isNotNull())
    return out.select(*columns, filled.alias("filled_by"))
