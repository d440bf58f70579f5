"""What can fill a gap: values found in texts and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brickwork.functions.names import first_number

#: The patterns, words and bounds of the gap filler.
TEXT_POSTCODE = r"(?i)\b([A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2})\b"
UNIT_PATTERNS = [
    r"(?i)(\d{1,5})\s*(?:residential\s+)?(?:units?|dwellings?|flats?|apartments?|homes?|houses?|beds?|bedrooms?|rooms?)",
    r"(?i)(?:provision of|comprising|containing|creating|delivering|erection of)\s+(\d{1,5})\s+(?:new\s+)?(?:units?|dwellings?|flats?|apartments?|homes?)",
    r"(?i)(\d{1,5})\s*(?:bed|bedroom)\s+(?:scheme|development|block|property)",
]
BTR_WORDS = [
    "build to rent", "btr", "private rented", "purpose built rental", "co-living", "coliving", "multifamily", "multi-family", "rental scheme", "institutional rent", "prs",
]
PBSA_WORDS = [
    "student accommodation", "pbsa", "purpose built student", "student housing", "student hall", "student residence", "halls of residence", "university accommodation",
]
COUNCIL_SUFFIXES = [" council", " borough council", " district council", " city council", " county council", " metropolitan borough council"]
SUPPLIER_SUFFIXES = [" ltd", " limited", " plc", " llp", " inc", " group", " holdings", " uk", " (uk)"]
MOST_UNITS, LEAST_NAME, ASSUMED_YEARS = 10_000, 6, 3


def text_postcode(text: Column) -> Column:
    """The first postcode of a text, upper-case as written; null if it has under five characters."""
    found = F.upper(F.trim(F.regexp_extract(text, TEXT_POSTCODE, 1)))
    return F.when(F.length(found) >= 5, found)


def text_units(text: Column) -> Column:
    return first_number(text, UNIT_PATTERNS, 1, MOST_UNITS)


def council_names(name: Column) -> Column:
    """A council's name, lower-case, as it is and without each ending that it has."""
    norm = F.trim(F.lower(name))
    short = [F.when(F.endswith(norm, F.lit(s)), F.trim(F.left(norm, F.length(norm) - len(s)))) for s in COUNCIL_SUFFIXES]
    return F.array_compact(F.array(norm, *short))


def supplier_key(name: Column) -> Column:
    """A supplier's name without company endings, lower-case letters, digits and spaces."""
    out = F.trim(F.lower(name))
    for suffix in SUPPLIER_SUFFIXES:
        out = F.replace(out, F.lit(suffix), F.lit(""))
    return F.trim(F.regexp_replace(out, "[^a-z0-9 ]", ""))


def annual_value(total: Column, starts: Column, ends: Column) -> Column:
    """Value a year, cut to a whole number: by the days from start to end, else over the years assumed."""
    days = F.datediff(ends, starts)
    return F.when(total > 0, F.when(days > 0, (total / (days / 365.25)).cast("long")).otherwise((total / ASSUMED_YEARS).cast("long")))
