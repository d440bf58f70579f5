"""Alerts of several kinds, each raised once: what is known already stays as it is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far ahead contracts count as expiring, how long applications are new and failures recent, and from which score on.
EXPIRY_DAYS, NEW_HOURS, FAILED_HOURS, LEAST_SCORE = 90, 1, 2, 70


def expiring(schemes: DataFrame, as_of: Column) -> DataFrame:
    """Schemes (id, name, ends) whose contract ends within EXPIRY_DAYS."""
    days = F.datediff("ends", F.to_date(as_of))
    title = F.concat(F.lit("Contract expiring: "), F.coalesce("name", F.lit("")), F.lit(" ("), days, F.lit(" days remaining)"))
    return schemes.where(days.between(0, EXPIRY_DAYS)).select(F.lit("contract_expiring").alias("kind"), F.lit("existing_scheme").alias("entity"), "id", title.alias("title"))


def high_scores(applications: DataFrame, as_of: Column) -> DataFrame:
    """Applications (id, reference, score, created) of the last NEW_HOURS that score LEAST_SCORE or more."""
    title = F.concat(F.lit("High-value application: "), F.coalesce("reference", F.lit("")), F.lit(" (score: "), F.col("score"), F.lit(")"))
    new = applications.where((F.col("created") >= as_of - F.expr(f"INTERVAL {NEW_HOURS} HOURS")) & (F.col("score") >= LEAST_SCORE))
    return new.select(F.lit("new_application").alias("kind"), F.lit("planning_application").alias("entity"), "id", title.alias("title"))


def failures(runs: DataFrame, as_of: Column) -> DataFrame:
    """Runs (id, source, status, started) of the last FAILED_HOURS that failed."""
    title = F.concat(F.lit("Scraper failed: "), F.coalesce("source", F.lit("Unknown")))
    failed = runs.where((F.col("status") == "failed") & (F.col("started") >= as_of - F.expr(f"INTERVAL {FAILED_HOURS} HOURS")))
    return failed.select(F.lit("scraper_failure").alias("kind"), F.lit("scraper_run").alias("entity"), "id", title.alias("title"))


def not_yet_raised(found: list[DataFrame], known: DataFrame) -> DataFrame:
    """Alerts of these kinds without one in ``known`` (kind, entity, id, is_read) already; a read alert of a contract lets a new one through."""
    standing = known.where((F.col("kind") != "contract_expiring") | ~F.col("is_read")).select("kind", "entity", "id")
    return reduce(DataFrame.unionByName, found).join(standing, ["kind", "entity", "id"], "left_anti").dropDuplicates(["kind", "entity", "id"])
