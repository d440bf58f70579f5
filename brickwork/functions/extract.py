"""Postcodes and numbers in texts, by the several rules that sources call for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brickwork.functions.names import first_number
from brickwork.functions.schemes import unit_count

#: The families of postcode patterns.
POSTCODES = {
    "strict": r"\b([Gg][Ii][Rr] 0[Aa]{2})|(([A-Za-z][0-9]{1,2})|(([A-Za-z][A-Ha-hJ-Yj-y][0-9]{1,2})|(([A-Za-z][0-9][A-Za-z])|([A-Za-z][A-Ha-hJ-Yj-y][0-9][A-Za-z]?))))\s*[0-9][A-Za-z]{2}\b",
    "any": r"(?i)[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}",
    "word": r"(?i)\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b",
    "tail": r"[A-Za-z]{1,2}[0-9][A-Za-z0-9]?\s*[0-9][A-Za-z]{2}$",
}
#: Numbers of beds and homes, and the bounds they must keep.
BED_PATTERNS = [
    r"(?i)\b(\d{2,4})\s*(?:bed[\s-]?spaces|beds|bedrooms|student\s+rooms|student\s+beds)\b",
    r"(?i)\b(\d{2,4})\s*(?:studios|en[\s-]?suite\s+rooms?|cluster\s+rooms?)\b",
    r"(?i)(?:home\s+to|accommodates?|houses?|hosts?)\s+(\d{2,4})\s+students?",
]
DOCUMENT_PATTERNS = [
    r"(?i)(\d{1,5})\s*(?:residential\s+)?(?:units?|apartments?|flats?|dwellings?|homes?)",
    r"(?i)(?:comprising|totalling|total of|providing|delivering)\s*(\d{1,5})\s*(?:units?|apartments?|flats?|dwellings?|homes?)",
    r"(?i)(?:number of (?:units?|dwellings?|apartments?|flats?|homes?))\s*[:\-]?\s*(\d{1,5})",
]
BED_BOUNDS, DOCUMENT_BOUNDS, FIELD_BOUNDS = (20, 5000), (2, 10_000), (1, 50_000)
SIZE_UNITS = {"large": 50, "major": 15}


def postcode_of(text: Column, family: str) -> Column:
    """The first postcode by a family's pattern: with one space before its last three characters, at the end of the text as it is written."""
    found = F.upper(F.trim(F.regexp_extract(text, POSTCODES[family], 0)))
    if family == "tail":
        return F.when(found != "", found)
    close = F.regexp_replace(found, r"\s+", "")
    return F.when(F.length(close) >= 5, F.concat(F.left(close, F.length(close) - 3), F.lit(" "), F.right(close, F.lit(3))))


def bed_count(text: Column) -> Column:
    return first_number(text, BED_PATTERNS, *BED_BOUNDS)


def most_units(text: Column) -> Column:
    """The largest plausible number of homes that a document names, by any pattern."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), 1) for p in DOCUMENT_PATTERNS]))
    return F.array_max(F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda n: n.between(*DOCUMENT_BOUNDS)))


def field_units(fields: list[Column], description: Column) -> Column:
    """The first field that is a plausible number of homes, else the number in the description."""
    whole = [f.cast("string").try_cast("double").try_cast("int") for f in fields]
    return F.coalesce(*[F.when(n.between(*FIELD_BOUNDS), n) for n in whole], unit_count(description))


def size_units(size: Column, description: Column) -> Column:
    """The number in the description, else what applications of a size class have at least."""
    known = F.create_map(*[F.lit(x) for p in SIZE_UNITS.items() for x in p])
    return F.coalesce(unit_count(description), F.try_element_at(known, F.coalesce(F.lower(size), F.lit(""))))
