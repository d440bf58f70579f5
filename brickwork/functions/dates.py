"""Dates in the several ways that sources write them, each source with its own list, the first that fits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The formats of each family of sources, in the order in which they are tried.
FAMILIES = {
    "portal": ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss"],
    "certificate": ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy", "d MMM yyyy"],
    "written": ["dd-MM-yyyy", "dd/MM/yyyy", "yyyy-MM-dd", "d MMM yyyy", "d MMMM yyyy"],
    "notice": ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd"],
}
#: Families whose last resort is the day that the text begins with.
LEADING_DAY = ("notice",)


def parsed_date(text: Column, family: str) -> Column:
    """The day that a text names, null for one that fits no format of its family. A time of day or zone does not move the day."""
    trimmed = F.trim(text)
    day = F.coalesce(*[_day(trimmed, f) for f in FAMILIES[family]])
    return F.coalesce(day, F.try_to_date(F.regexp_extract(trimmed, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")) if family in LEADING_DAY else day


def _day(text: Column, pattern: str) -> Column:
    """By one format: the whole text has to fit, and the day is the one written."""
    if "XXX" not in pattern:
        return F.try_to_date(text, pattern)
    return F.when(F.try_to_timestamp(text, F.lit(pattern)).isNotNull(), F.try_to_date(F.left(text, F.lit(10)), "yyyy-MM-dd"))
