"""Certificates, confidence, checks of fields, estimates and self-operation: column expressions with their tables as parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwork.functions.names import any_keyword, squeeze

# Fixed values, from here to SELF_MANAGED: letters, sources, bounds, codes and names.

LETTERS = {"A": 7, "B": 6, "C": 5, "D": 4, "E": 3, "F": 2, "G": 1}
TRUSTED_SOURCES = ["hmlr_ccod", "companies_house", "arl_btr", "arl_btr_open_operating", "epc_new_dwelling", "epc", "operator_scraper", "pbsa_operator"]
SCHEME_TYPES = ["BTR", "PBSA", "Co-living", "Senior Living", "Residential", "Mixed-use"]
SCHEME_STATES = ["operational", "under_construction", "planned", "decommissioned"]
CODE_DURATIONS = {
    "70332": (72, "housing_management"), "70333": (72, "housing_management"), "70330": (60, "property_management"), "79993": (48, "facilities_management"),
    "50700": (48, "maintenance"), "45211": (36, "construction"), "98341": (24, "accommodation"), "55100": (24, "hotel_accommodation"),
    "55200": (24, "camping"), "55250": (24, "short_lets"),
}
WORD_DURATIONS = [
    ("housing management", 72, "housing_management"), ("tenant management", 72, "housing_management"), ("estate management", 60, "property_management"),
    ("property management", 60, "property_management"), ("block management", 60, "property_management"), ("facilities management", 48, "facilities_management"),
    ("concierge", 36, "concierge"), ("repairs and maintenance", 48, "maintenance"), ("housing maintenance", 48, "maintenance"), ("maintenance", 36, "maintenance"),
    ("cleaning", 36, "cleaning"), ("landscaping", 36, "landscaping"), ("insurance", 24, "insurance"), ("temporary accommodation", 24, "temporary_accommodation"),
    ("student accommodation", 60, "student_accommodation"), ("build to rent", 60, "btr_management"), ("care home", 60, "care_home"),
    ("supported housing", 60, "supported_housing"), ("sheltered housing", 60, "sheltered_housing"),
]
BRAND_OPERATORS = {
    "unite students": "UNITE STUDENTS LIMITED", "unite group": "UNITE STUDENTS LIMITED", "iq student": "iQ Student Accommodation", "vita student": "Vita Student",
    "chapter ": "Chapter Living", "moda living": "Moda Living", "moda,": "Moda Living", "grainger": "GRAINGER REAL ESTATE LIMITED", "get living": "Get Living",
    "quintain": "Quintain Living", "essential living": "Essential Living", "urbanbubble": "urbanbubble", "fresh property": "Fresh Property Group",
    "fresh student": "Fresh Property Group", "homes for students": "Homes for Students", "student roost": "Student Roost", "yugo": "Yugo",
    "collegiate": "Collegiate AC", "mezzino": "Mezzino", "prestige student": "Prestige Student Living", "hello student": "Hello Student",
    "downing students": "Downing Students", "study inn": "Study Inn", "abodus": "Abodus Students", "host student": "Host", "crm students": "CRM Students",
    "scape": "Scape Living", "urbanest": "Urbanest", "nido": "Nido Living", "true student": "True Student", "dandara living": "Dandara Living",
    "simple life": "Simple Life", "l&g ": "Legal & General Affordable Homes", "legal & general": "Legal & General Affordable Homes", "way of life": "Way of Life",
    "greystar": "Greystar", "apo ": "Apo", "uncle ": "UNCLE", "folio london": "Folio London", "fizzy living": "Fizzy Living",
}
NEVER_OPERATORS = [
    "bank", "capital", "invest", "fund", "reit", "pension", "barratt", "persimmon", "bellway", "taylor wimpey", "redrow", "berkeley", "crest nicholson",
    "vistry", "countryside", "cala ", "miller homes", "david wilson", "charles church", "keepmoat", "avant homes", "story homes", "bloor", "gleeson", "jelson",
    "developments", "construction", "contractors",
]
SELF_MANAGED = [
    "housing", "council", "borough", "mayor and burgesses", "city of", "peabody", "notting hill genesis", "notting hill home", "sovereign network", "home group",
    "anchor hanover", "abri group", "stonewater", "settle group", "torus", "guinness partnership", "places for people", "riverside group", "a2dominion",
    "livewest", "moat homes", "paragon asra", "orbit ", "midland heart", "vivid", "hyde ", "swan ", "bromford", "wandle", "octavia", "one manchester",
    "salix homes", "onward homes", "yorkshire housing", "karbon homes", "believe housing", "thirteen group", "flagship", "futures housing",
]


def certificates(ratings: Column) -> Column:
    """What an array of letters says, as a struct: how many count, the most frequent (first seen of equals), the mean, and whether it lies below D. Without a valid letter all is null but ``available`` and ``needs_improvement``, which are false."""
    points = F.create_map(*[F.lit(x) for pair in LETTERS.items() for x in pair])
    valid = F.filter(F.transform(F.array_compact(ratings), lambda r: F.trim(F.upper(r))), lambda r: r.isin(*LETTERS))
    total = F.aggregate(valid, F.lit(0), lambda a, r: a + F.element_at(points, r))
    counted = F.transform(F.array_distinct(valid), lambda r, k: F.struct(F.size(F.filter(valid, lambda x: x == r)).alias("n"), (-k).alias("order"), r.alias("letter")))
    some = F.coalesce(F.size(valid) > 0, F.lit(False))
    mean = F.when(some, total / F.size(valid))
    return F.struct(
        some.alias("available"),
        F.when(some, F.size(valid)).alias("assessed"),
        F.array_max(counted)["letter"].alias("predominant"),
        F.bround(mean, 1).alias("average"),
        F.coalesce(mean < LETTERS["D"], F.lit(False)).alias("needs_improvement"),
    )


def lock_confidence(fields: dict[str, Column], locks: Column, trusted: list[str] | None = None) -> Column:
    """Sum over the filled fields: a whole share if locked by hand, 0.8 by a trusted source, else 0.4; ``locks`` maps field to source."""
    share = 1.0 / len(fields)

    def part(name, value):
        source = F.try_element_at(locks, F.lit(name))
        trust = F.when(source == "manual", share).when(source.isin(trusted or TRUSTED_SOURCES), share * 0.8).otherwise(share * 0.4)
        return F.when(value.isNull(), 0.0).otherwise(trust)

    return F.bround(F.least(F.lit(1.0), reduce(lambda a, b: a + b, [part(*f) for f in fields.items()], F.lit(0.0))), 3)


def checked_field(field: str, value: Column) -> Column:
    """A text as the field's normal value and an error, one of them null; a null value is no error."""
    text, date = F.trim(value), F.try_to_date(F.left(value, F.lit(10)), "yyyy-MM-dd")
    if field == "num_units":
        good, why = F.when(text.try_cast("int").between(1, 5000), text.try_cast("int").cast("string")), "must be an integer from 1 to 5000"
    elif field == "postcode":
        code = squeeze(F.upper(value))
        code = F.when(~F.contains(code, F.lit(" ")) & (F.length(code) >= 5), F.concat(F.substring(code, F.lit(1), F.greatest(F.length(code) - 3, F.lit(0))), F.lit(" "), F.right(code, F.lit(3)))).otherwise(code)
        good, why = F.when(code.rlike(r"^[A-Z]{1,2}\d[A-Z\d]?\s\d[A-Z]{2}$"), code), "is no postcode"
    elif field in ("scheme_type", "status"):
        known = SCHEME_TYPES if field == "scheme_type" else SCHEME_STATES
        good, why = F.when(value.isin(known), value), "must be one of " + ", ".join(known)
    elif field in ("contract_start_date", "contract_end_date"):
        good, why = date.cast("string"), "must be a date as YYYY-MM-DD"
    elif field.endswith("_company_id"):
        good, why = text.try_cast("long").cast("string"), "must be an integer"
    elif field in ("performance_rating", "satisfaction_score", "financial_health_score"):
        good, why = F.when(text.try_cast("double").between(0, 100), text.try_cast("double").cast("string")), "must be a number from 0 to 100"
    else:
        good, why = value, ""
    return F.struct(good.alias("value"), F.when(value.isNotNull() & good.isNull(), f"{field} {why}").alias("error"))


def typical_duration(codes: Column, text: Column) -> Column:
    """Months and category of the first code that is listed by its first five digits, else of the first wording found, as a struct; null without any."""
    entry = lambda months, category, source: F.struct(F.lit(months).alias("months"), F.lit(category).alias("category"), F.lit(source).alias("source"))
    known = F.create_map(*[x for code, (m, c) in CODE_DURATIONS.items() for x in (F.lit(code), entry(m, c, "code"))])
    by_code = F.get(F.array_compact(F.transform(codes, lambda c: F.try_element_at(known, F.left(c, F.lit(5))))), F.lit(0))
    lowered = F.lower(text)
    return F.coalesce(by_code, *[F.when(F.contains(lowered, F.lit(w)), entry(m, c, "wording")) for w, m, c in WORD_DURATIONS])


def _padded(name: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.coalesce(name, F.lit(""))), F.lit(" "))


def self_operated(owner: Column, owner_type: Column) -> Column:
    """Why an owner runs its scheme itself; null for investors, house builders and all others."""
    name = _padded(owner)
    managed = any_keyword(name, SELF_MANAGED) | F.coalesce(F.contains(owner_type, F.lit("SOCIETY")), F.lit(False))
    return F.when(owner.isNull() | any_keyword(name, NEVER_OPERATORS), None).when(managed, "self-managed").when(any_keyword(name, list(BRAND_OPERATORS)), "brand owner")


def brand_operator(scheme: Column) -> Column:
    """The operator that the first brand in a scheme's name stands for."""
    name = _padded(scheme)
    return F.coalesce(*[F.when(F.contains(name, F.lit(fragment)), operator) for fragment, operator in BRAND_OPERATORS.items()])


def comparisons(schemes: DataFrame, group: str) -> DataFrame:
    """One sentence for each set of schemes someone lists to compare: how many, the best, those at risk by score.

    Takes columns id, name, score and risk; ties go to the smaller id. A set is
    what a person looks at side by side, so its names fit one row.
    """
    risky = F.col("risk").isin("critical", "high")
    found = schemes.groupBy(group).agg(
        F.count("*").alias("n"),
        F.min_by(F.struct("name", "score"), F.struct(-F.col("score"), F.col("id"))).alias("best"),
        F.array_sort(F.collect_list(F.when(risky, F.struct((-F.col("score")).alias("s"), "id", "name")))).alias("risky"),
    )
    text = F.concat(F.lit("Compared "), F.col("n"), F.lit(" schemes. Highest BD score: "), F.col("best.name"), F.lit(" ("), F.col("best.score"), F.lit(")."))
    names = F.array_join(F.transform("risky", lambda r: r["name"]), ", ")
    more = F.concat(F.lit(" "), F.size("risky"), F.lit(" scheme(s) with critical/high contract risk: "), names, F.lit("."))
    return found.select(group, F.concat(text, F.when(F.size("risky") > 0, more).otherwise("")).alias("summary"))
