"""Explainable scores: weighted parts, each a chain of thresholds with a default for missing input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brickwork.functions.rounding import half_even, weighted_sum

#: Desirability by scheme type.
TYPE_SCORES = {"BTR": 100.0, "PBSA": 85.0, "Co-living": 80.0, "Senior": 70.0, "Affordable": 60.0, "Mixed": 65.0, "Residential": 50.0, "Unknown": 30.0}
#: By planning stage.
STAGE_SCORES = {
    "submitted": 100.0, "pending": 95.0, "pending decision": 95.0, "validated": 95.0, "pre-application": 75.0, "pre-app": 75.0, "approved": 60.0,
    "permissioned": 60.0, "allocated": 50.0, "conditions": 40.0, "decided": 40.0, "appeal": 35.0, "refused": 5.0, "withdrawn": 5.0,
}
#: Weights of the parts.
APPLICATION_WEIGHTS = {"size": 0.30, "scheme_type": 0.25, "planning_stage": 0.20, "recency": 0.15, "applicant_signal": 0.10}
SCHEME_WEIGHTS = {"contract_urgency": 0.35, "csat_gap": 0.25, "occupancy_gap": 0.20, "financial_distress": 0.20}
COMPANY_WEIGHTS = {"portfolio": 0.40, "growth": 0.35, "relationship": 0.25}


def ladder(value: Column, steps: list[tuple[float, float]], last: float, at_least: bool) -> Column:
    """The score of the first step that the value reaches (at_least) or stays within."""
    out = None
    for limit, score in steps:
        test = value >= limit if at_least else value <= limit
        out = F.when(test, score) if out is None else out.when(test, score)
    return out.otherwise(last)


def below(value: Column, steps: list[tuple[float, float]], last: float) -> Column:
    out = None
    for limit, score in steps:
        out = F.when(value < limit, score) if out is None else out.when(value < limit, score)
    return out.otherwise(last)


def looked_up(key: Column, scores: dict[str, float], default: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in scores.items() for x in p]), key), F.lit(default))


# The steps and points of all parts below.
def size_score(units: Column) -> Column:
    return F.when(units.isNull() | (units <= 0), 20.0).otherwise(ladder(units, [(500, 100.0), (300, 90.0), (200, 80.0), (100, 65.0), (50, 50.0)], 30.0, True))


def recency_score(submitted: Column, as_of: Column) -> Column:
    return F.when(submitted.isNull(), 30.0).otherwise(ladder(F.datediff(as_of, submitted), [(30, 100.0), (90, 80.0), (180, 55.0), (365, 30.0)], 10.0, False))


def applicant_score(name: Column, developers: tuple[str, ...]) -> Column:
    text = F.lower(F.trim(name))
    agent = text.rlike("c/o |agent|mss |mr |mrs ")
    return F.when(name.isNull() | (name == ""), 20.0).when(text.rlike("|".join(developers)), 100.0).when(agent, 25.0).otherwise(50.0)


def urgency_score(months: Column) -> Column:
    return F.when(months.isNull(), 35.0).otherwise(ladder(months, [(6, 100.0), (12, 85.0), (24, 55.0)], 20.0, False))


def gap(legacy: Column, default: float) -> Column:
    """What is missing to 100 in an older 0 to 100 field, or a default."""
    return F.when(legacy.isNotNull(), F.greatest(F.lit(0.0), 100.0 - legacy)).otherwise(default)


def rating_score(rating: Column, legacy: Column) -> Column:
    return F.when(rating > 0, below(rating, [(3.5, 100.0), (4.0, 70.0), (4.5, 35.0)], 10.0)).otherwise(gap(legacy, 40.0))


def occupancy_score(rate: Column, legacy: Column) -> Column:
    return F.when(rate.between(0, 1), below(rate * 100, [(80, 100.0), (92, 60.0), (98, 25.0)], 10.0)).otherwise(gap(legacy, 45.0))


def distress_score(arrears: Column, health: Column) -> Column:
    return F.when(arrears.between(0, 100), arrears).otherwise(gap(health, 40.0))


def composite(weights: dict[str, float], parts: dict[str, Column]) -> Column:
    """Weighted sum in exact decimals, clamped to 0 to 100 and rounded to one place, ties to even; 0 if a part is null."""
    return half_even(F.least(F.greatest(weighted_sum(weights, parts), F.lit(0).cast("decimal(10,0)")), F.lit(100).cast("decimal(10,0)")))
