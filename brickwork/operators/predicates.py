"""Filters of the listing and worklist screens, as columns and DataFrame functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Conjunction of the conditions that are given; None means no filter."""
    return reduce(lambda d, c: d.filter(c), [c for c in conditions if c is not None], df)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def present(column: Column, wanted: bool | None) -> Column | None:
    """Tri-state presence: the empty text counts as missing."""
    if wanted is None:
        return None
    has = column.isNotNull() & (column != "")
    return has if wanted else column.isNull() | (column == "")


def within(column: Column, low=None, high=None) -> Column | None:
    """One- or two-sided range, both ends included; null is outside."""
    bounds = [c for c in (column >= low if low is not None else None, column <= high if high is not None else None) if c is not None]
    return reduce(lambda a, b: a & b, bounds) if bounds else None


def one_of(column: Column, values: list) -> Column | None:
    return column.isin(values) if values else None


def none_of(column: Column, values: list, keep_null: bool) -> Column:
    """NOT IN; with keep_null a missing value passes, else it is dropped as in SQL."""
    return column.isNull() | ~column.isin(values) if keep_null else ~column.isin(values)


def matches_any(term: str, columns: list[Column]) -> Column:
    """Case-insensitive containment in any column; % and _ in the term stay wildcards."""
    return any_of([c.ilike(f"%{term}%") for c in columns])


def number_or_text(term: str, key: Column, columns: list[Column]) -> Column:
    """Text search that also compares a digits-only term with the key."""
    text = matches_any(term, columns)
    return text | (key == int(term)) if term.isdigit() else text


def expiring(end: Column, as_of: Column, days: int) -> Column:
    return end.between(as_of, F.date_add(as_of, days))


def stale(checked: Column, as_of: Column, days: int) -> Column:
    return checked.isNull() | (checked < F.date_sub(as_of, days))


def fresh(first: Column, fallback: Column, since: Column) -> Column:
    """On or after a day; the fallback date decides where the first is missing."""
    return (first >= since) | (first.isNull() & (fallback >= since))


def contains_any(text: Column, keywords: list[str]) -> Column:
    """Plain substring containment, not whole words."""
    return any_of([F.contains(text, F.lit(k)) for k in keywords])


def visible_rows(df: DataFrame, role: str, user: int, owner: Column) -> DataFrame:
    """Analysts see their own rows only."""
    return df.filter(owner == user) if role == "bd_analyst" else df


def masked(column: Column, role: str) -> Column:
    """Personal data is null for viewers."""
    return F.when(F.lit(role) != "viewer", column)


def mapped(column: Column, values: dict[str, str], default: Column | None = None) -> Column:
    """Dictionary lookup with a default (null without one)."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    found = F.try_element_at(table, column)
    return found if default is None else F.coalesce(found, default)
