"""Matching of incoming records with known ones: by reference, by a similar name among the newest, by place and operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwork.operators.joining import first_tier
from brickwork.operators.similar import best_similar


def match_records(incoming: DataFrame, known: DataFrame, newest: int = 2000, least: int = 80) -> DataFrame:
    """(row, match, tier): the known record of each incoming one, by the first tier that has one.

    ``incoming``: row, reference, title, postcode, operator; ``known``: id,
    reference, name, postcode, operator (operators by their normalised names).
    Tier 1 is an equal reference (the least id), tier 2 the most alike of the
    ``newest`` records' names at ``least`` of 100 or more (the newest of equals),
    tier 3 an equal postcode and operator (the least id). Only as many records
    as ``newest`` tells meet by similarity; all meet by keys.
    """
    pick = lambda key, df: df.groupBy(*key).agg(F.min("id").alias("match"))
    by_reference = incoming.where("reference <> ''").join(pick(["reference"], known.where("reference <> ''")), "reference").select("row", "match")
    recent = known.orderBy(F.desc("id")).limit(newest).select((-F.col("id")).alias("newness"), "name")
    by_name = best_similar(incoming.select("row", "title"), "row", "title", recent, "newness", "name", least).select("row", (-F.col("newness")).alias("match"))
    place = ["postcode", "operator"]
    by_place = incoming.where("postcode <> '' AND operator <> ''").join(pick(place, known.where("postcode <> '' AND operator <> ''")), place).select("row", "match")
    return first_tier([by_reference, by_name, by_place], "row", F.col("match")).select("row", "match", "tier")
