"""Contract risk, performance trend, regulatory grades, owner types and noise, as structs of what was found and why."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days a month; levels by months left, with the action and the factor that goes with them.
MONTH_DAYS = 30.44
EXPIRED = ("critical", "Contract has expired. Immediate action required: confirm holdover terms or initiate new tender.", "Contract is past expiry date.")
RISK_STEPS = [
    (3, "critical", "Engage with client immediately. Prepare proposal for contract renewal or competitive bid.", "Less than 3 months until expiry."),
    (6, "high", "Schedule introductory meeting. Prepare competitive analysis and service proposal.", "Less than 6 months until expiry."),
    (12, "medium", "Begin relationship building. Research incumbent performance and client satisfaction.", "Less than 12 months until expiry."),
    (24, "low", "Monitor and build awareness. Add to long-term pipeline tracking.", None),
]
MINIMAL = ("minimal", "No immediate action needed. Review at next quarterly pipeline review.", None)
UNKNOWN = ("unknown", "Confirm contract end date with operations team.", "Contract end date not recorded.")
WEAK_RATING, WEAK_HEALTH, LARGE_UNITS, WINDOW_DAYS = 50, 40, 200, 365
#: States by the mean rating, with trend and recommendation.
STATES = [
    (80, "strong", "stable", "Maintain current approach. Low risk of operator change."),
    (60, "adequate", "stable", "Monitor closely. Prepare competitive positioning in case of decline."),
    (40, "underperforming", "declining", "Active opportunity. Begin building case for service improvement pitch."),
    (None, "poor", "declining", "High-priority opportunity. Operator likely to be replaced. Prepare proposal immediately."),
]
UNRATED = 50.0
#: Risk by the worst grade, financial health by the viability grade.
GRADE_RISK = {1: 15.0, 2: 30.0, 3: 65.0, 4: 85.0}
VIABILITY_HEALTH = {"V1": 95.0, "V2": 75.0, "V3": 45.0, "V4": 20.0}
#: Names of funds, and countries that are not offshore.
FUND_NAME = r"(?i)\b(capital|partners|equity|invest(?:ment|ments)?|fund|asset management|holdings?|ventures|real estate|reit|infrastructure|pension|l\.?p\.?|g\.?p\.?|sarl|s\.a\.r\.l)\b"
ONSHORE = r"(?i)england|wales|scotland|united kingdom|uk"
#: Classes of applications that are noise, by their descriptions; the same by type; types never taken for noise, and the units from which on nothing is.
NOISE = {
    "single-dwelling extensions": r"single.storey|two.storey|rear extension|side extension|front extension|loft conversion|conservatory|outbuilding|porch|garage conversion|garden room",
    "tree work": r"fell.{0,20}tree|prune|crown reduc|tree work|tree pres|tpo",
    "telecoms / signage": r"telecom|antenna mast|signage|advertis|hoarding|fascia sign",
    "listed building / heritage": r"listed building|heritage|conservation area",
    "discharge of conditions": r"discharge of condition|approval of detail|details pursuant",
    "small change of use": r"change of use",
    "works to existing dwelling": r"replacement window|external rendering|cladding replac|roof replac|reroofing",
}
NOISE_TYPES = r"tree|conditions|discharge|telecom|advertis|listed|heritage|prior approv|non.?material"
PROTECTED = ["BTR", "PBSA", "Co-living", "Senior", "Affordable", "Mixed"]
UNIT_FLOOR = 10


def _stepped(value: Column, steps: list[tuple], place: int, reaches) -> Column:
    out = F
    for step in steps:
        out = out.when(reaches(value, step[0]), F.lit(step[place]).cast("string"))
    return out


def contract_risk(ends: Column, as_of: Column, performance: Column, satisfaction: Column, health: Column, units: Column) -> Column:
    """level, months and days left, action, the day the renewal window opens, and the factors in order."""
    days = F.datediff(ends, as_of)
    months = days / MONTH_DAYS

    def told(place: int) -> Column:
        inner = _stepped(months, RISK_STEPS, place + 1, lambda v, limit: v <= limit).otherwise(F.lit(MINIMAL[place]).cast("string"))
        return F.when(ends.isNull(), UNKNOWN[place]).when(days <= 0, EXPIRED[place]).otherwise(inner)

    known = ends.isNotNull()
    weak = lambda value, limit, before, after: F.when(known & (value < limit), F.concat(F.lit(before), value.cast("double").cast("string"), F.lit(after)))
    factors = F.array_compact(
        F.array(
            told(2),
            weak(performance, WEAK_RATING, "Low performance rating (", "/100) increases likelihood of operator change."),
            weak(satisfaction, WEAK_RATING, "Low satisfaction score (", "/100) suggests client may seek alternatives."),
            weak(health, WEAK_HEALTH, "Poor financial health (", "/100) may indicate operational difficulties."),
            F.when(known & (units >= LARGE_UNITS), F.concat(F.lit("Large scheme ("), units.cast("string"), F.lit(" units) represents significant revenue opportunity."))),
        )
    )
    window = F.when(known, F.greatest(F.date_sub(ends, WINDOW_DAYS), as_of))
    return F.struct(told(0).alias("level"), F.bround(months, 1).alias("months"), days.alias("days"), told(1).alias("action"), window.alias("window"), factors.alias("factors"))


def assessed(value: Column, place: int = 1) -> Column:
    """What a metric from 0 to 100 stands for (1: state, 2: trend, 3: recommendation)."""
    return _stepped(value, STATES[:-1], place, lambda v, limit: v >= limit).otherwise(STATES[-1][place])


def performance_trend(ratings: dict[str, Column], poor_letter: Column) -> Column:
    """state, trend, mean, recommendation, and factors: each rating that is there with its assessment, and the certificates' letter if they need improvement."""
    there = F.filter(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in ratings.items()]), lambda r: r["value"].isNotNull())
    total = F.aggregate(there, F.lit(0.0), lambda a, r: a + r["value"])
    mean = F.when(F.size(there) > 0, total / F.nullif(F.size(there), F.lit(0))).otherwise(UNRATED)
    rated = F.transform(there, lambda r: F.struct(r["metric"].alias("metric"), r["value"].cast("string").alias("value"), assessed(r["value"]).alias("assessment")))
    letter = F.struct(F.lit("epc_rating").alias("metric"), poor_letter.alias("value"), F.lit("needs_improvement").alias("assessment"))
    factors = F.concat(rated, F.filter(F.array(letter), lambda r: r["value"].isNotNull()))
    return F.struct(assessed(mean).alias("state"), assessed(mean, 2).alias("trend"), F.bround(mean, 1).alias("mean"), assessed(mean, 3).alias("recommendation"), factors.alias("factors"))


def regulatory_grades(governance: Column, viability: Column, consumer: Column) -> Column:
    """label, risk by the worst of the grades, financial health by the viability; what is no grade from 1 to 4 says nothing."""
    grades = F.filter(F.array(governance, viability, consumer), lambda g: F.coalesce(F.rlike(g, F.lit("^[GVC][1-4]$")), F.lit(False)))
    worst = F.array_max(F.transform(grades, lambda g: F.substring(g, 2, 1).cast("int")))
    lookup = lambda table, key: F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), key)
    return F.struct(F.array_join(grades, "/").alias("label"), F.when(worst.isNotNull(), lookup(GRADE_RISK, F.coalesce(worst, F.lit(0)))).alias("risk"), F.when(viability.isNotNull(), lookup(VIABILITY_HEALTH, F.coalesce(viability, F.lit("")))).alias("health"))


def owner_type(name: Column, country: Column, individual: Column, chain: Column) -> Column:
    """The likely kind of an ultimate owner: by its country, its name, whether a person is in the chain, whether there is one (``chain``)."""
    fund = F.coalesce(name.rlike(FUND_NAME), F.lit(False))
    offshore = F.coalesce((country != "") & ~country.rlike(ONSHORE), F.lit(False))
    out = F.when(offshore, F.concat(F.when(fund, "OFFSHORE FUND (").otherwise("OFFSHORE ENTITY ("), country, F.lit(")")))
    return out.when(fund, "PE / FUND / INSTITUTIONAL").when(individual, "PRIVATE INDIVIDUAL(S)").when(~chain, "NO PSC DATA (listed/exempt?)").otherwise("CORPORATE GROUP")


def noise_classes(description: Column) -> Column:
    """All classes of noise that a description falls in, in order."""
    text = F.lower(F.coalesce(description, F.lit("")))
    return F.array_compact(F.array(*[F.when(text.rlike(p), k) for k, p in NOISE.items()]))


def may_go(units: Column, kind: Column, floor: int = UNIT_FLOOR) -> Column:
    """Whether an application's size and type let it be taken for noise."""
    return (F.coalesce(units, F.lit(0)) < floor) & (kind.isNull() | ~kind.isin(PROTECTED))
