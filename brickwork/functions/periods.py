"""Days, durations and contract periods named in texts, as column expressions.

Amounts beyond a thousand years or so say nothing: they count as absent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, from here to START_AND_TERM: the wordings that are understood.

MONTHS = "(january|jan|february|feb|march|mar|april|apr|may|june|jun|july|jul|august|aug|september|sep|sept|october|oct|november|nov|december|dec)"
ISO = r"\b(\d{4})-(\d{2})-(\d{2})\b"
LONG = rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+{MONTHS}\s+(\d{{4}})\b"
NUMERIC = r"\b(\d{2})[/\-](\d{2})[/\-](\d{4})\b"
MONTH_YEAR = rf"\b{MONTHS}\s+(\d{{4}})\b"
CHAIN = r"(?i)\b(\d{1,2})\s*\+\s*(\d{1,2})(?:\s*\+\s*(\d{1,2}))?\s*(?:year|yr)s?\b"
TERM = r"(?:for\s+(?:a\s+)?(?:period\s+of\s+)?|initial\s+term\s+of\s+|(?:contract|agreement)\s+(?:term\s+(?:of\s+)?|for\s+)?)"
TERM_MONTHS = rf"(?i){TERM}(\d+)\s*months?"
TERM_YEARS = rf"(?i){TERM}(\d+)\s*[\-–]?\s*years?"
N_YEAR = r"(?i)\b(\d+)\s*[\-–]?\s*year\b"
OPTION = r"(?i)(?:with\s+(?:an?\s+)?option\s+to\s+extend\s+(?:for\s+)?|option\s+to\s+extend\s+by\s+|plus\s+(?:an?\s+)?|with\s+(?:an?\s+)?(?:further\s+)?extension\s+of\s+)(\d+)\s*[\-–]?\s*(years?|months?)"
START_LABEL = r"(?i)(?:start\s*date|commencement\s*date|commencing|start(?:ing)?)\s*[:;]?\s*(.+?)(?:[,;.]|\s+(?:end|to|until|$))"
END_LABEL = r"(?i)(?:end\s*date|expiry\s*date|termination\s*date|expir(?:y|ing|es?)\s*(?:date|on)?|to\s+expire(?:\s+on)?|ending|completes?\s+on)\s*[:;]?\s*(.+?)(?:[,;.]|$)"
PERIOD = r"(?i)(?:contract\s+period|period\s+of\s+contract|term)\s*[:;]?\s*(.+?)(?:\.|$)"
UP_TO = r"\s+(?:to|until|through|[-–—])\s+"
PERIOD_RANGE = rf"(?i)^(?:from\s+)?(.+?){UP_TO}(.+)"
LONG_DAY = rf"\d{{1,2}}(?:st|nd|rd|th)?\s+{MONTHS.replace('(', '(?:')}\s+\d{{4}}"
RANGES = [
    rf"(?i)(?:from|running\s+from|run\s+from)\s+(.+?){UP_TO}(.+?)(?:[.,;]|\s+(?:with|plus|and\s+option)|$)",
    rf"(?i)({LONG_DAY}){UP_TO}({LONG_DAY})",
    rf"(\d{{4}}-\d{{2}}-\d{{2}}){UP_TO}(\d{{4}}-\d{{2}}-\d{{2}})",
    rf"(\d{{2}}/\d{{2}}/\d{{4}}){UP_TO}(\d{{2}}/\d{{2}}/\d{{4}})",
]
START_AND_TERM = r"(?i)(?:commencing|starting|from|beginning)\s+(.+?)\s+for\s+(\d+)\s*[\-–]?\s*(years?|months?)"

#: A month and year count as a day of their own only where no day stands before them.
ANY_DAY = rf"(?i){ISO}|{LONG}|{NUMERIC}|\b(?=[a-z])(?<!\d(?:st|nd|rd|th)?\s{{0,9}}){MONTH_YEAR}"
#: Months beyond this are no duration.
MOST_MONTHS = 12_000


def _bound(value: Column, expression) -> Column:
    """An expression of a value that is worked out once."""
    return F.get(F.transform(F.array(value), expression), F.lit(0))


def day_of(text: Column, months: bool = True) -> Column:
    """The day a short text names: ISO, day month-name year, dd/mm/yyyy, else a month's first day (unless without ``months``); an invalid day falls to the next form."""

    def form(pattern, tidy, plain, layout):
        found = F.regexp_extract(text, "(?i)" + pattern, 0)
        # A parse that fails is dear, so it is tried only on what was found.
        return F.when((found != "") & ~F.contains(found, F.lit("0000")), F.try_to_date(F.regexp_replace(found, tidy, plain), layout))

    forms = [
        (ISO, "-", "-", "yyyy-MM-dd"),
        (LONG, r"^(\d{1,2})[A-Za-z]*\s+([A-Za-z]{3})[A-Za-z]*\s+", "$1 $2 ", "d MMM yyyy"),
        (NUMERIC, "[/-]", "/", "dd/MM/yyyy"),
        (MONTH_YEAR, r"^([A-Za-z]{3})[A-Za-z]*\s+", "1 $1 ", "d MMM yyyy"),
    ]
    return F.coalesce(*[form(*f) for f in (forms if months else forms[:-1])])


def days_in(text: Column) -> Column:
    """All valid days of a text with their positions (from 0), from left to right; a text without any gives an empty array."""
    width = lambda parts: F.aggregate(parts, F.lit(0), lambda n, part: n + F.length(part))
    day = lambda match: F.when(F.rlike(match, F.lit("^[0-9]")), day_of(match, months=False)).otherwise(day_of(match))

    def placed(cut):
        at = lambda k: width(F.slice(cut["between"], F.lit(1), k + 1)) + width(F.slice(cut["found"], F.lit(1), k))
        return F.transform(cut["found"], lambda match, k: F.struct(at(k).alias("position"), day(match).alias("day")))

    cut = F.struct(F.split(text, ANY_DAY, -1).alias("between"), F.regexp_extract_all(text, F.lit(ANY_DAY), 0).alias("found"))
    return F.filter(_bound(cut, placed), lambda x: x["day"].isNotNull())


def contract_months(text: Column) -> Column:
    """'5+2+2 years' whole; else the months or years of a term, else 'N year', with the options to extend added; null without any."""
    number = lambda pattern, k=1: F.regexp_extract(text, pattern, k).try_cast("int")
    chain = number(CHAIN, 1) + number(CHAIN, 2) + F.coalesce(number(CHAIN, 3), F.lit(0))
    in_bounds = lambda n: F.when(n <= MOST_MONTHS, n)
    years, year = number(TERM_YEARS), number(N_YEAR)
    base = F.coalesce(in_bounds(number(TERM_MONTHS)), F.when(years <= MOST_MONTHS // 12, years * 12), F.when(year.between(1, 30), year * 12))
    count = lambda n, unit: F.when(F.startswith(F.lower(unit), F.lit("year")) & n.between(1, 20), n * 12).when(F.startswith(F.lower(unit), F.lit("month")) & n.between(1, 240), n).otherwise(0)
    options = F.zip_with(F.regexp_extract_all(text, F.lit(OPTION), 1), F.regexp_extract_all(text, F.lit(OPTION), 2), lambda n, unit: count(n.try_cast("int"), unit))
    return F.coalesce(F.when(chain.between(1, 40), chain * 12), base + F.aggregate(options, F.lit(0), lambda a, n: a + n))


def contract_period(text: Column) -> Column:
    """Start and end of a contract, as a struct.

    Each is the first that is found by labels, by a labelled period, by a range
    of days, by a start with its term, by the known start with a duration
    anywhere, and by the first two days of the text in either order.
    """
    period = F.trim(F.regexp_extract(text, PERIOD, 1))
    ranges = [(text, pattern) for pattern in RANGES]
    term = F.regexp_extract(text, START_AND_TERM, 2).try_cast("int") * F.when(F.startswith(F.lower(F.regexp_extract(text, START_AND_TERM, 3)), F.lit("year")), 12).otherwise(1).cast("long")
    fragments = lambda label, k: F.array(F.regexp_extract(text, label, 1), *[F.regexp_extract(t, p, k) for t, p in [(period, PERIOD_RANGE), *ranges]])
    first = lambda parts: F.get(F.array_compact(F.transform(parts, lambda part: day_of(part))), F.lit(0))
    parts = F.struct(
        first(fragments(START_LABEL, 1)).alias("starts"),
        first(fragments(END_LABEL, 2)).alias("ends"),
        day_of(F.regexp_extract(text, START_AND_TERM, 1)).alias("begun"),
        F.when(term <= MOST_MONTHS, term).cast("int").alias("term"),
    )
    rest = F.struct(F.when(F.rlike(text, F.lit("(?i)year|yr|month")), contract_months(text)).alias("months"), F.transform(days_in(text), lambda x: x["day"]).alias("days"))

    def decided(p):
        known, ended = F.coalesce(p["starts"], p["begun"]), F.coalesce(p["ends"], F.add_months(p["begun"], p["term"]))

        def with_rest(q):
            pair = F.when(F.size(q["days"]) >= 2, F.array_sort(F.slice(q["days"], 1, 2)))
            alone = F.when((F.size(q["days"]) == 1) & known.isNull(), F.get(q["days"], F.lit(0)))
            ends = F.coalesce(F.add_months(alone, q["months"]), ended, F.add_months(known, q["months"]), F.get(pair, F.lit(1)))
            return F.struct(F.coalesce(known, F.get(pair, F.lit(0)), alone).alias("starts"), ends.alias("ends"))

        # Durations and all days of the text are looked for only where an end is still open.
        return F.when(known.isNotNull() & ended.isNotNull(), F.struct(known.alias("starts"), ended.alias("ends"))).otherwise(_bound(rest, with_rest))

    return _bound(parts, decided)


def backfilled(starts: Column, ends: Column, text: Column, proxies: dict[str, Column]) -> Column:
    """starts, ends and the source of what was filled, as a struct, by the term that a text tells.

    A known start gives the end ("duration"); without both dates the first of the
    ``proxies`` that is there stands for the start. A known end, or a text without
    a term, leaves both as they are.
    """
    months = contract_months(text)
    proxy = F.coalesce(*proxies.values())
    told = ends.isNull() & (months > 0)
    no_start = told & starts.isNull()
    begins = F.when(no_start, proxy).otherwise(starts)
    source = F.when(told & starts.isNotNull(), "duration")
    for name, day in proxies.items():
        source = source.when(no_start & day.isNotNull(), name)
    return F.struct(begins.alias("starts"), F.when(told, F.add_months(begins, months)).otherwise(ends).alias("ends"), source.alias("source"))
