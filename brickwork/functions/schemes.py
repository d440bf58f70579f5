"""What a scheme or contract is, by rule tables over its texts and codes: column expressions that take the table as a parameter."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from brickwork.functions.rounding import half_even, weighted_sum

from brickwork.functions.names import first_number

# Fixed values, from here to CONTRACT_KEYWORDS: words, names, codes and patterns that decide what a text is taken for.

SCHEME_KEYWORDS = {
    "BTR": [
        "build to rent", "btr", "private rented sector", "prs", "build-to-rent", "rental apartments", "purpose built rental", "rental scheme", "private rent",
        "rented apartments", "rented homes", "for rent", "managed rental", "single-ownership rental", "single ownership rental", "professionally managed rental",
        "long-term rental", "long term rental", "purpose-built rental", "private rental sector", "build for rent", "build-for-rent", "operational residential",
        "rental tenure", "rental housing tenure", "professionally-managed", "co-living and build-to-rent", "private rental homes", "private rented homes",
        "long-term lease rental", "single-family rental", "single family rental",
    ],
    "PBSA": ["student", "pbsa", "purpose built student", "student accommodation", "university accommodation", "student housing", "student halls", "student bedrooms"],
    "Co-living": ["co-living", "co living", "shared living", "coliving"],
    "Senior": [
        "retirement", "extra care", "assisted living", "c2 use", "later living", "care home", "sheltered", "elderly", "over 55", "over 60", "nursing home",
        "dementia", "age restricted", "senior living", "retirement village",
    ],
    "Affordable": ["affordable hous", "social rent", "shared ownership", "council housing", "housing association", "affordable units", "social housing", "affordable rent"],
}

APPLICANT_KEYWORDS = {
    "BTR": [
        "greystar", "quintain", "get living", "moda", "apo group", "apache capital", "realstar", "way of life", "fizzy living", "essential living", "grainger",
        "platform", "cortland", "native living", "native group", "lifestory", "ridgeback", "delancey", "ddr", "yoo capital",
        "m&g real estate", "m&g investments", "legal & general affordable", "legal and general affordable", "l&g affordable", "l&g modular",
        "aviva investors", "patrizia", "pgim real estate", "invesco real estate", "lasalle investment", "schroders capital", "gcp", "gcp infrastructure",
        "round hill capital", "long harbour", "tristan capital",
        "berkeley group", "berkeley homes", "lendlease", "british land", "land securities", "landsec", "regal london", "regal homes",
        "ballymore", "telford homes", "vistry partnerships", "muse developments", "argent related", "argent llp", "u+i", "urban&civic",
        "sage housing", "blackstone real estate", "sigma capital", "thriving", "sage homes",
        "henley investments", "wise living", "uncle", "the collective", "vita group", "vita living", "fjm",
        "arena central", "court collaboration", "calthorpe estates", "goodstone living", "apsley house capital", "mclaren property", "glenbrook",
        "packaged living", "jrl group", "stanhope", "topland", "mcaleer & rushe", "olympian homes", "legacie developments", "ridgemont living", "modaplan",
        "simple life", "placefirst", "urbanbubble", "lloyds living", "savills im", "allsop letting", "downing living", "watkin jones", "collegiate ac",
    ],
    "PBSA": [
        "unite students", "unite group", "iq student", "iq accommodation", "fresh student living", "vita student", "vita group", "scape living",
        "scape student", "the student housing company", "study inn", "host student", "host real estate", "downing students", "prime student living",
        "crm students", "campus living villages", "global student accommodation", "gsa", "blackstone bidco", "homes for students", "yugo",
        "true student", "chapter living", "urbanest", "nido student", "mansion student", "the student lodge", "fusion students",
        "student castle", "x1 lettings", "watkin jones",
    ],
    "Senior": [
        "mccarthy stone", "churchill retirement", "audley group", "audley villages", "inspired villages", "retirement villages group", "anchor hanover",
        "barchester healthcare", "bupa care", "care uk", "hc-one", "lifestory retirement", "auriens", "elysian residences",
    ],
}

RESIDENTIAL_KEYWORDS = [
    "residential", "dwellings", "flats", "apartments", "housing", "houses", "bungalows", "maisonettes", "bedroom", "bed ", "new build", "new dwelling",
    "new homes", "storey",
]

UNIT_COUNT_PATTERNS = [
    r"(?i)(?:circa|approximately|approx\.?|around|some|of\s+up\s+to)\s+(\d[\d,]*)\s+(?:residential|dwellings?|units?|homes?|apartments?|flats?|bedrooms?)",
    r"(?i)(?:maximum|minimum)\s+of\s+(\d[\d,]*)\s+(?:dwellings?|units?|homes?|apartments?|flats?|houses?|residential)",
    r"(?i)(\d[\d,]*)\s*(?:no\.?\s*)?(?:[a-z0-9][a-z0-9-]+\s+){0,3}(?:units|flats|apartments|dwellings?|dwellinghouses?|homes|rooms|bed\s*spaces|houses|bungalows|maisonettes|townhouses)",
    r"(?i)(\d[\d,]*)\s*(?:no\.?\s*)?(?:residential\s*)?(?:units|flats|apartments|dwellings?|dwellinghouses?|homes|rooms|bed\s*spaces|houses|bungalows|maisonettes|townhouses)",
    r"(?i)(?:erection|construction|development|provision|creation|demolition and erection)\s+of\s+(\d[\d,]*)\s",
    r"(?i)(\d[\d,]*)\s*(?:x\s*)?(?:\d+\s*bed(?:room)?)",
    r"(?i)comprising\s+(\d[\d,]*)\s",
    r"(?i)up\s+to\s+(\d[\d,]*)\s*(?:residential\s*)?(?:units|flats|apartments|dwellings|homes)",
    r"(?i)(\d[\d,]*)\s*-?\s*unit",
    r"(?i)for\s+(\d[\d,]*)\s+(?:houses|dwellings|homes|flats|apartments|residential)",
    r"(?i)(\d[\d,]*)\s*(?:one|two|three|four|1|2|3|4)\s*bed(?:room)?",
]

CPV_TYPES = {
    "70332000": "Social Housing", "70333000": "Managed Rental", "70330000": "Managed Scheme", "70300000": "Managed Scheme", "98341000": "Supported Housing",
    "79993000": "Facilities Management", "50700000": "Facilities Management", "50710000": "Facilities Management", "50711000": "Facilities Management",
    "50712000": "Facilities Management", "45211000": "Residential Development", "45211341": "Residential Development", "45211340": "Residential Development",
    "90910000": "Estate Services", "90911000": "Estate Services", "77310000": "Estate Services", "45453000": "Housing Refurbishment",
    "45300000": "Housing Maintenance", "45330000": "Housing Maintenance", "45421000": "Housing Maintenance", "55100000": "BTR", "55250000": "BTR", "55200000": "Co-living",
}

TENDER_KEYWORDS = [
    (["social housing", "council housing", "housing association", "registered provider", "housing revenue"], "Social Housing"),
    (["affordable", "shared ownership", "right to buy"], "Affordable"),
    (["sheltered", "extra care", "retirement", "later living", "senior living", "assisted living", "warden"], "Senior"),
    (["supported housing", "supported living", "hostel", "refuge", "temporary accommodation", "homelessness"], "Supported Housing"),
    (["build to rent", "btr", "co-living", "co living"], "BTR"),
    (["student", "pbsa", "purpose built student"], "PBSA"),
    (["care home", "domiciliary", "nursing"], "Care"),
    (["facilities management", "fm services", "building management"], "Facilities Management"),
    (["repairs", "maintenance", "responsive repair", "planned maintenance", "retrofit", "decarbonisation"], "Housing Maintenance"),
    (["cleaning", "grounds maintenance", "estate services", "communal"], "Estate Services"),
    (["property management", "lettings", "estate management", "block management"], "Managed Scheme"),
    (["housing management", "tenancy management", "tenant", "rent collection", "arrears"], "Housing Management"),
]

CONTRACT_KEYWORDS = {
    "maintenance": ["maintenance", "repairs", "responsive repair", "planned maintenance", "servicing", "upkeep", "refurbishment", "retrofit"],
    "construction": ["construction", "building", "new build", "development", "demolition", "erection", "groundworks", "civil engineering"],
    "cleaning": ["cleaning", "janitorial", "housekeeping", "window cleaning", "deep clean", "waste collection"],
    "management": ["management", "property management", "housing management", "estate management", "asset management", "facilities management"],
    "security": ["security", "CCTV", "concierge", "door entry", "surveillance"],
    "IT_services": ["software", "IT ", "digital", "technology", "system", "platform", "cloud", "hosting", "data", "network"],
    "consultancy": ["consultancy", "advisory", "consultant", "professional services", "specialist advice"],
    "design": ["architect", "design", "planning", "surveying", "landscape"],
    "energy": ["energy", "heating", "gas", "electricity", "boiler", "solar", "insulation", "EPC", "decarbonisation", "retrofit"],
    "care_support": ["care", "support", "assisted living", "sheltered", "extra care", "warden", "supported housing", "domiciliary"],
    "temporary_accommodation": ["temporary accommodation", "homelessness", "rough sleeping", "emergency accommodation", "hostel"],
    "legal_financial": ["legal", "solicitor", "insurance", "audit", "financial", "accounting", "valuation"],
    "recruitment": ["recruitment", "staffing", "agency worker", "temporary staff"],
    "grounds": ["grounds", "landscaping", "gardening", "tree", "grass"],
    "furniture_supplies": ["furniture", "furnishing", "supplies", "equipment", "goods", "food", "catering"],
    "telecom": ["telephony", "broadband", "internet", "connectivity", "telecoms"],
    "transport": ["transport", "fleet", "vehicle", "removal", "logistics"],
}

SIC_SECTORS = {
    "01": "Agriculture", "02": "Forestry", "03": "Fishing", "05": "Mining", "06": "Oil & Gas", "07": "Mining", "08": "Mining", "09": "Mining",
    "10": "Food & Beverage", "11": "Food & Beverage", "12": "Tobacco", "13": "Textiles", "14": "Textiles", "15": "Textiles", "16": "Wood & Paper",
    "17": "Wood & Paper", "18": "Printing", "19": "Petroleum", "20": "Chemicals", "21": "Pharmaceuticals", "22": "Plastics & Rubber",
    "23": "Building Materials", "24": "Metals", "25": "Metal Products", "26": "Electronics", "27": "Electrical Equipment", "28": "Machinery",
    "29": "Automotive", "30": "Transport Equipment", "31": "Furniture", "32": "Other Manufacturing", "33": "Repair & Installation",
    "35": "Energy & Utilities", "36": "Water Supply", "37": "Sewerage", "38": "Waste Management", "39": "Remediation", "41": "Construction",
    "42": "Civil Engineering", "43": "Specialised Construction", "45": "Motor Vehicles", "46": "Wholesale Trade", "47": "Retail Trade",
    "49": "Transport", "50": "Water Transport", "51": "Air Transport", "52": "Warehousing & Logistics", "53": "Postal & Courier", "55": "Accommodation",
    "56": "Food & Beverage Services", "58": "Publishing", "59": "Media & Film", "60": "Broadcasting", "61": "Telecommunications", "62": "IT & Software",
    "63": "Information Services", "64": "Financial Services", "65": "Insurance", "66": "Financial Services", "68": "Real Estate",
    "69": "Legal & Accounting", "70": "Management Consultancy", "71": "Architecture & Engineering", "72": "Scientific R&D",
    "73": "Advertising & Marketing", "74": "Professional Services", "75": "Veterinary", "77": "Rental & Leasing", "78": "Recruitment",
    "79": "Travel & Tourism", "80": "Security", "81": "Facilities Management", "82": "Office Administration", "84": "Public Administration",
    "85": "Education", "86": "Healthcare", "87": "Residential Care", "88": "Social Work", "90": "Arts & Entertainment", "91": "Libraries & Museums",
    "92": "Gambling", "93": "Sports & Recreation", "94": "Membership Organisations", "95": "Repair Services", "96": "Other Personal Services",
    "97": "Households as Employers", "98": "Households", "99": "International Organisations",
}

#: A tender is about housing if it holds one of these words, or a code is one of these or begins with one of the prefixes.
HOUSING_KEYWORDS = [
    "housing", "tenant", "residential", "dwelling", "sheltered", "supported living", "social housing", "affordable", "rented", "lettings",
    "property management", "estate management", "housing management", "housing maintenance", "registered provider", "housing association",
    "accommodation", "homelessness", "repairs and maintenance", "voids", "care home", "extra care", "retirement", "supported housing",
    "temporary accommodation", "block management", "communal", "leasehold", "freehold", "housing stock", "council housing", "almshouse", "hostel",
    "refuge", "domestic property", "housing revenue", "housing benefit", "tenant engagement", "resident engagement", "right to buy",
    "shared ownership", "housing register", "key worker", "build to rent", "purpose built student", "co-living", "senior living", "later living",
    "assisted living", "domiciliary", "warden", "concierge", "landlord services", "rent collection", "arrears", "tenancy management",
    "housing officer", "disrepair", "decarbonisation", "retrofit", "building safety", "fire safety", "housing contract", "managed accommodation",
    "managed housing", "property services", "grounds maintenance housing", "cleaning housing", "cleaning communal", "lift maintenance",
    "planned maintenance", "responsive maintenance", "asset management housing", "stock condition",
]
HOUSING_CODES = ["70330000", "70332000", "70333000", "79993000", "98341000", "50700000", "45211000", "45211341", "45211340", "55100000", "55250000", "55200000"]
HOUSING_PREFIXES = ["703", "7033", "98341", "45211", "50700", "50710", "50711", "50712", "79993", "45453", "45300", "45330", "45421", "90910", "90911", "77310", "50000"]

#: Points of a certificate's letter; any other letter counts OTHER_POINTS.
EPC_POINTS = {"A": 100, "B": 85, "C": 70, "D": 55, "E": 40, "F": 25, "G": 10}
OTHER_POINTS = 50


def has_any(lowered: Column, words: list[str]) -> Column:
    """Whether a lower-case text holds one of the words, also inside others; false for null. One compiled pattern, however many words."""
    return F.coalesce(F.rlike(lowered, F.lit("|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in words))), F.lit(False))


def scheme_type(description: Column, applicant: Column, agent: Column, keywords=None, applicants=None, residential=None) -> Column:
    """The one type that the applicant, the agent or the description stand for; Mixed for several, Residential or Unknown for none."""
    keywords, applicants = keywords or SCHEME_KEYWORDS, applicants or APPLICANT_KEYWORDS
    text, who = F.lower(description), F.lower(F.concat_ws(" ", F.when(applicant != "", applicant), F.when(agent != "", agent)))
    tests = {kind: has_any(text, words) for kind, words in keywords.items()}
    for kind, words in applicants.items():
        tests[kind] = tests.get(kind, F.lit(False)) | has_any(who, words)
    kinds = F.array_compact(F.array(*[F.when(test, kind) for kind, test in tests.items()]))
    other = F.when(has_any(text, residential or RESIDENTIAL_KEYWORDS), "Residential").otherwise("Unknown")
    return F.when(F.size(kinds) > 1, "Mixed").otherwise(F.coalesce(F.get(kinds, F.lit(0)), other))


def unit_count(description: Column, patterns=None, low: int = 1, high: int = 50_000) -> Column:
    """The number of homes that a description tells, by the first pattern whose number lies within bounds."""
    return first_number(description, patterns or UNIT_COUNT_PATTERNS, low, high)


def contract_type(codes: Column, description: Column, cpv=None, keywords=None, default: str = "Managed Scheme") -> Column:
    """By the first code that is listed, else a telling scheme type of the description, else the first keyword list that fits, else the default."""
    known = F.create_map(*[F.lit(x) for pair in (cpv or CPV_TYPES).items() for x in pair])
    by_code = F.get(F.array_compact(F.transform(codes, lambda c: F.try_element_at(known, c))), F.lit(0))
    none = F.lit(None).cast("string")
    by_type = scheme_type(description, none, none)
    by_type = F.when(~by_type.isin("Unknown", "Residential"), by_type)
    text = F.lower(description)
    by_word = F.coalesce(*[F.when(has_any(text, words), kind) for words, kind in keywords or TENDER_KEYWORDS])
    return F.coalesce(by_code, by_type, by_word, F.lit(default))


def about_housing(codes: Column, text: Column) -> Column:
    """Whether a tender is about housing by its codes or its text; false where both are null."""
    listed = F.exists(F.array_compact(codes), lambda c: c.isin(HOUSING_CODES) | F.rlike(c, F.lit(f"^(?:{'|'.join(HOUSING_PREFIXES)})")))
    return F.coalesce(listed, F.lit(False)) | has_any(F.lower(text), HOUSING_KEYWORDS)


def most_keywords(text: Column, classes=None) -> Column:
    """The class with most of its keywords in the text, the first of equals; null without any."""
    words_in = lambda t, words: F.size(F.filter(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(t, w)))  # noqa: E731  lists of words as data, not as code
    ranks = lambda t: F.array(*[F.struct(words_in(t, words).alias("n"), F.lit(-k).alias("order"), F.lit(name).alias("name")) for k, (name, words) in enumerate((classes or CONTRACT_KEYWORDS).items())])
    ranked = F.get(F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), ranks), F.lit(0))  # the text is lowered once
    best = F.array_max(ranked)
    return F.when(best["n"] > 0, best["name"])


def sic_sector(codes: Column, sectors=None) -> Column:
    """The sector of the first code whose two leading digits are listed."""
    known = F.create_map(*[F.lit(x) for pair in (sectors or SIC_SECTORS).items() for x in pair])
    return F.get(F.array_compact(F.transform(codes, lambda c: F.try_element_at(known, F.substring(F.trim(c), 1, 2)))), F.lit(0))


def performance_rating(epc: Column, revenue: Column, starts: Column, ends: Column, units: Column, postcode: Column, confidence: Column) -> Column:
    """Mean of the weighted certificate points (``epc``: letter -> number), the completeness of the record and 100 times its confidence; parts that are not there don't count."""
    points = F.create_map(*[F.lit(x) for pair in EPC_POINTS.items() for x in pair])
    total = F.aggregate(F.map_values(epc), F.lit(0).cast("long"), lambda a, v: a + v)
    weighted = F.aggregate(F.map_entries(epc), F.lit(0).cast("long"), lambda a, e: a + F.coalesce(F.try_element_at(points, e["key"]), F.lit(OTHER_POINTS)) * e["value"])
    there = lambda c, n: F.when(c, n).otherwise(0)
    complete = there(F.coalesce(revenue != 0, F.lit(False)), 20) + there(starts.isNotNull(), 15) + there(ends.isNotNull(), 15) + there(F.coalesce(units != 0, F.lit(False)), 15)
    complete = complete + there(F.coalesce(postcode != "", F.lit(False)), 15) + there(F.coalesce(F.size(epc) > 0, F.lit(False)), 20)
    parts = F.array_compact(F.array(F.when(total > 0, weighted / total), complete.cast("double"), F.when(confidence != 0, confidence * 100)))
    return F.bround(F.aggregate(parts, F.lit(0.0), lambda a, v: a + v) / F.size(parts), 1)


def legacy_breakdown(as_of: Column, ends: Column, performance: Column, satisfaction: Column, finance: Column, units: Column) -> Column:
    """The five parts of the earlier score, as a struct."""
    months = F.datediff(ends, as_of) / 30.0
    proximity = F.when(ends.isNull(), 30.0).when(months <= 6, 100.0).when(months <= 12, 80.0).when(months <= 24, 50.0).otherwise(20.0)
    size = F.when(units > 500, 100.0).when(units > 200, 70.0).when(units > 100, 50.0).otherwise(30.0)
    half = F.lit(50.0)
    parts = {"contract_proximity": proximity, "performance_gap": F.coalesce(100.0 - performance, half), "market_opportunity": F.coalesce(100.0 - satisfaction, half), "relationship_strength": F.coalesce(finance, half), "scheme_size": size}
    return F.struct(*[F.bround(c.cast("double"), 1).alias(k) for k, c in parts.items()])


#: What the parts weigh, and the priorities from a score on.
LEGACY_WEIGHTS = {"contract_proximity": 0.35, "performance_gap": 0.25, "market_opportunity": 0.15, "relationship_strength": 0.15, "scheme_size": 0.10}
LEGACY_PRIORITIES = [(70, "high"), (45, "medium")]


def legacy_score(parts: Column) -> Column:
    return half_even(weighted_sum(LEGACY_WEIGHTS, parts))


def legacy_priority(score: Column) -> Column:
    out = F
    for least, name in LEGACY_PRIORITIES:
        out = out.when(score >= least, name)
    return out.otherwise("low")
