"""Normalisers and extractors of names, addresses, numbers and dates, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about which company is meant.
COMPANY_WORDS = (
    "real estate partners", "real estate", "developments", "development", "properties", "holdings", "partners",
    "limited liability partnership", "limited", "group", "ltd", "llp", "plc", "inc", "llc", "uk", "co",
)
#: Street words and their short forms.
STREET_WORDS = {
    "road": "rd", "street": "st", "avenue": "ave", "lane": "ln", "drive": "dr", "crescent": "cres", "terrace": "tce", "close": "cl",
    "court": "ct", "place": "pl", "square": "sq", "gardens": "gdns", "grove": "gr", "park": "pk", "north": "n", "south": "s",
    "east": "e", "west": "w", "mount": "mt", "saint": "st", "floor": "fl", "building": "bldg", "apartment": "apt",
}
#: Status words, looked for in this order.
STATUS_WORDS = (
    ("pending", "Pending"), ("under consideration", "Pending"), ("registered", "Submitted"), ("submitted", "Submitted"),
    ("received", "Submitted"), ("valid", "Validated"), ("approved", "Approved"), ("granted", "Approved"), ("permitted", "Approved"),
    ("permit", "Approved"), ("decided", "Decided"), ("refuse", "Refused"), ("rejected", "Refused"), ("withdrawn", "Withdrawn"), ("appeal", "Appeal"),
)
#: Fixed value: the shape of a postcode.
POSTCODE = r"([A-Za-z]{1,2}[0-9][A-Za-z0-9]?\s*[0-9][A-Za-z]{2})"


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def company_name(name: Column) -> Column:
    """Lower case, company words removed in up to three passes, other signs to spaces."""
    words = r"\b(?:" + "|".join(COMPANY_WORDS) + r")\b"
    text = F.lower(F.trim(name))
    for _ in range(3):
        text = F.regexp_replace(text, words, "")
    return squeeze(F.regexp_replace(text, r"[^\w\s]", " "))


def company_tail(name: Column) -> Column:
    """The variant that drops one legal form at the end only."""
    return F.trim(F.regexp_replace(F.upper(F.trim(name)), r"\s+(LIMITED|LTD\.?|PLC|LLP)$", ""))


#: What comes before and after an authority's name, looked for in this order, one of each.
AUTHORITY_PREFIXES = ["london borough of ", "royal borough of ", "city of ", "borough of ", "metropolitan borough of ", "district of ", "county of ", "council of the ", "the "]
AUTHORITY_SUFFIXES = [
    " borough council", " district council", " city council", " county council", " metropolitan district council", " metropolitan borough council", " council",
    " dc", " bc", " cc", " mbc", " mdc",
]
#: Application states of a portal.
PORTAL_STATES = {"Undecided": "Pending", "Permitted": "Approved", "Conditions": "Approved", "Refused": "Refused", "Withdrawn": "Withdrawn", "Appeal": "Appeal", "Referred": "Pending", "Not Available": "Unknown", "Other": "Unknown"}
#: A planning reference, and how descriptions name an applicant.
PLANNING_REFERENCE = r"\d+/|/\d+"
APPLICANT_PATTERNS = [
    r"(?:applicant|developer|client|proposed by|submitted by)[:\s]+([A-Z][A-Za-z\s&']+?)(?:\.|,|$)",
    r"on behalf of\s+([A-Z][A-Za-z\s&']+?)(?:\.|,|\s+for|\s+at|$)",
]


def authority_name(name: Column) -> Column:
    """Lower case, without the first prefix that fits, then without the first suffix that fits; empty for null."""
    text = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    out = F
    for p in AUTHORITY_PREFIXES:
        out = out.when(F.startswith(text, F.lit(p)), F.substr(text, F.lit(len(p) + 1)))
    text = out.otherwise(text)
    out = F
    for s in AUTHORITY_SUFFIXES:
        out = out.when(F.endswith(text, F.lit(s)), F.left(text, F.length(text) - len(s)))
    return F.trim(out.otherwise(text))


def portal_state(raw: Column) -> Column:
    """A portal's state, by the table, else by the words of the status."""
    known = F.create_map(*[F.lit(x) for p in PORTAL_STATES.items() for x in p])
    return F.coalesce(F.try_element_at(known, F.coalesce(raw, F.lit(""))), status(raw))


def applicant_of(name: Column, description: Column) -> Column:
    """The applicant's name unless it is a planning reference, else the first that the description names, of 4 to 99 characters."""
    own = F.when((name != "") & ~name.rlike(PLANNING_REFERENCE), name)
    found = [F.trim(F.regexp_extract(description, p, 1)) for p in APPLICANT_PATTERNS]
    return F.coalesce(own, *[F.when(F.length(f).between(4, 99), f) for f in found])


def title_key(name: Column) -> Column:
    """A name for comparison with a register's: without forms and common words."""
    text = F.regexp_replace(F.lower(name), "[^a-z0-9 ]", " ")
    return squeeze(F.regexp_replace(text, r"\b(limited|ltd|plc|llp|the|of|and|company|co|uk|group)\b", " "))


def name_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def address(text: Column) -> Column:
    """Lower case without the postcode and signs, street words short."""
    plain = squeeze(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), POSTCODE, ""), r"[^\w\s]", " "))
    short = F.create_map(*[F.lit(x) for pair in STREET_WORDS.items() for x in pair])
    return F.array_join(F.transform(F.split(plain, " "), lambda w: F.coalesce(F.try_element_at(short, w), w)), " ")


def postcode(text: Column) -> Column:
    """The first postcode as outward and inward part, null if there is none."""
    found = F.upper(F.replace(F.regexp_extract(text, POSTCODE, 1), F.lit(" "), F.lit("")))
    return F.when(found != "", F.concat_ws(" ", F.substring(found, F.lit(1), F.length(found) - 3), F.right(found, F.lit(3))))


def outward(code: Column) -> Column:
    return F.split_part(code, F.lit(" "), F.lit(1))


def company_number(number: Column) -> Column:
    """Upper case, digits padded to eight places; longer ones stay whole."""
    text = F.upper(F.trim(number))
    return F.when(text.rlike("^[0-9]{1,7}$"), F.lpad(text, 8, "0")).otherwise(text)


def status(raw: Column) -> Column:
    """The first status word that occurs decides, so 'not permitted' counts as approved."""
    text = F.lower(F.trim(raw))
    out = F.when(raw.isNull() | (raw == ""), "Unknown")
    for word, name in STATUS_WORDS:
        out = out.when(F.contains(text, F.lit(word)), name)
    return out.otherwise("Unknown")


def first_number(text: Column, patterns: list[str], low: int, high: int) -> Column:
    """The number of the first pattern whose number lies within bounds."""

    def one(p):
        n = F.regexp_extract(text, p, 1)
        value = F.when(n != "", F.replace(n, F.lit(","), F.lit("")).try_cast("int"))
        return F.when(value.between(low, high), value)

    return F.coalesce(*map(one, patterns))


UNIT_PATTERNS = [r"(?i)([0-9][0-9,]*)\s*(?:no\.?\s*)?(?:residential\s+)?(?:units|flats|apartments|dwellings|homes)", r"(?i)(?:up to|comprising)\s+([0-9][0-9,]*)", r"(?i)([0-9][0-9,]*)\s*(?:bed|studio)"]


def any_date(text: Column) -> Column:
    """ISO, day month-name year, dd/mm/yyyy, month-name year (its first day); an invalid one falls to the next."""
    get = lambda p: F.regexp_extract(text, p, 0)
    months = "(January|February|March|April|May|June|July|August|September|October|November|December)"
    forms = [(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "yyyy-MM-dd", ""), (r"[0-9]{1,2} " + months + " [0-9]{4}", "d MMMM yyyy", ""), (r"[0-9]{2}/[0-9]{2}/[0-9]{4}", "dd/MM/yyyy", ""), (months + " [0-9]{4}", "d MMMM yyyy", "1 ")]
    return F.coalesce(*[F.try_to_date(F.concat(F.lit(before), get(p)), form) if before else F.try_to_date(get(p), form) for p, form, before in forms])


def months_between_days(start: Column, end: Column) -> Column:
    """Calendar months; the day of the month does not count."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def duration_months(text: Column) -> Column:
    """'5+2+2 years' and 'N months' and 'N years' as months, null where nothing fits."""
    chain = F.regexp_extract(text, r"([0-9]+(?:\s*\+\s*[0-9]+)+)\s*(?:years|year|yrs)", 1)
    total = F.aggregate(F.transform(F.regexp_extract_all(chain, F.lit("([0-9]+)"), 1), lambda x: x.cast("int")), F.lit(0), lambda a, b: a + b)
    months = F.regexp_extract(text, r"([0-9]+)\s*(?:months|month)", 1).try_cast("int")
    years = F.regexp_extract(text, r"([0-9]+)\s*-?\s*(?:years|year|yrs)", 1).try_cast("int")
    return F.coalesce(F.when((chain != "") & (total <= 40), total * 12), months, F.when(years.between(1, 30), years * 12))


def visible_text(html: Column) -> Column:
    """Text without scripts, styles and tags."""
    plain = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return squeeze(F.regexp_replace(plain, r"<[^>]*>", " "))


def domain(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^(?:[a-z]+://)?([^/:?#]+)", 1), r"^www\.", "")


def tokens(name: Column, least: int, stop: list[str]) -> Column:
    """Distinct words of at least so many letters, without stop words, in order of appearance."""
    found = F.regexp_extract_all(F.lower(name), F.lit(f"([a-z0-9]{{{least},}})"), 1)
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(stop)))


def any_keyword(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


#: The other ways in which names are made comparable, each for its own keys. How: legal forms at the end only, forms anywhere, whole words, or signs alone.
NAME_VARIANTS = {
    "register": ("end", [" LIMITED", " LTD", " PLC", " LLP", " INC", " CORP", " LLC"]),
    "ingest": ("anywhere, signs stay", [" limited", " ltd", " plc", " llp", " inc", " council", " borough", " county", " city", " metropolitan", " district"]),
    "attribution": ("anywhere", [" limited", " ltd", " plc", " llp", " inc", " lp", " cic"]),
    "student": ("anywhere", [" ltd", " limited", " plc", " llp", " inc", " uk"]),
    "gaps": ("anywhere, spaces stay", [" ltd", " limited", " plc", " llp", " inc", " group", " holdings", " uk", " (uk)"]),
    "letters": ("signs", []),
    "buyers": ("words", ["the", "of", "and", "ltd", "limited", "plc", "llp", "group", "trust", "council", "borough", "city", "london", "mayor", "burgesses"]),
    "providers": ("words", ["the", "of", "and", "ltd", "limited", "plc", "llp", "group", "housing", "association", "trust", "society", "homes", "registered", "provider"]),
    "numbers": ("words", ["limited", "ltd", "plc", "llp", "the", "of", "and", "company", "co", "uk", "group"]),
    "plain": ("lower", []),
}


def name_variant(name: Column, variant: str) -> Column:
    """A name by one of ``NAME_VARIANTS``; keys of different variants must not be compared."""
    how, words = NAME_VARIANTS[variant]
    if how == "end":
        text = F.upper(F.trim(name))
        for word in words:
            text = F.when(F.endswith(text, F.lit(word)), F.substring(text, F.lit(1), F.length(text) - len(word))).otherwise(text)
        return squeeze(F.regexp_replace(text, "[^A-Z0-9 ]", ""))
    text = F.lower(name)
    if how == "lower":
        return text
    if how == "signs":
        return name_key(F.coalesce(name, F.lit("")))
    if how == "words":
        plain = F.regexp_replace(F.coalesce(text, F.lit("")), "[^a-z0-9 ]", " ")
        return squeeze(F.regexp_replace(plain, rf"\b({'|'.join(words)})\b", " "))
    text = F.trim(text)
    for word in words:
        text = F.replace(text, F.lit(word), F.lit(""))
    if how == "anywhere, signs stay":
        return squeeze(text)
    return squeeze(F.regexp_replace(text, r"[^a-z0-9\s]", "")) if how == "anywhere" else F.trim(F.regexp_replace(text, "[^a-z0-9 ]", ""))


def spaced_postcode(code: Column, least: int = 0) -> Column:
    """A postcode with one space before its last three characters, if it has none and at least so many characters; sources differ in that number."""
    text = squeeze(F.upper(code))
    return F.when(F.contains(text, F.lit(" ")) | (F.length(text) < least), text).otherwise(F.trim(F.concat(F.substring(text, F.lit(1), F.greatest(F.length(text) - 3, F.lit(0))), F.lit(" "), F.right(text, F.lit(3)))))
