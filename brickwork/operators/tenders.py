"""Tenders merged into schemes and their contracts as one pass: validation, matching, fills, supersession."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwork.operators.joining import best_per_key
from brickwork.operators.matching import match_records
from brickwork.sources.workspace import written

#: What a contract may be worth at most, the type that says nothing, and the longest name.
MOST_VALUE, ANY_KIND, NAME_LETTERS = 10_000_000_000, "Managed Scheme", 500
FILLS = ["operator", "owner", "manager", "postcode", "starts", "reference"]


def is_valid(value: Column, starts: Column, ends: Column) -> Column:
    """No value or one above 0 and below MOST_VALUE; an end that is not before the start."""
    return (value.isNull() | ((value > 0) & (value < MOST_VALUE))) & (starts.isNull() | ends.isNull() | (ends >= starts))


def merge_tenders(schemes: DataFrame, contracts: DataFrame, tenders: DataFrame, newest: int = 2000, least: int = 80) -> tuple[DataFrame, DataFrame]:
    """Schemes and contracts after a batch of tenders.

    ``schemes``: id, name, reference, address, postcode, kind, operator, owner,
    manager, starts, ends; ``contracts``: scheme, reference, starts, ends, value,
    is_current; ``tenders``: row, reference, title, address, postcode, kind, operator,
    owner, manager, starts, ends, value. Operators are company ids.

    Tenders that are not valid say nothing. A tender finds its scheme by
    :func:`match_records`; those of one title that find none make one scheme with
    the id ``new:<least row>`` (ids are texts in the result), the others keep theirs.
    Empty fields of a scheme take the first value that its tenders have, in the
    order of ``row``; an end takes the latest, a type that says nothing the first
    that does, an address also where it is only the name. Each reference that a
    scheme has no contract of becomes one, that of the last tender is current, and
    those before are not.
    """
    good = written(tenders.where(is_valid(F.col("value"), F.col("starts"), F.col("ends"))), "tenders")
    known = schemes.select("id", "reference", "name", "postcode", F.col("operator").cast("string").alias("operator"))
    asked = good.select("row", "reference", "title", "postcode", F.col("operator").cast("string").alias("operator"))
    found = match_records(asked, known, newest, least).select("row", F.col("match").cast("string").alias("scheme"))
    first = good.join(found, "row", "left_anti").groupBy("title").agg(F.concat(F.lit("new:"), F.min("row")).alias("made"))
    placed = good.join(found, "row", "left").join(first, "title", "left").withColumn("scheme", F.coalesce("scheme", "made")).drop("made")
    placed = written(placed, "placed")

    told = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("row")))
    kind = F.min_by("kind", F.when(F.col("kind") != ANY_KIND, F.col("row")))
    new = placed.groupBy("scheme").agg(*[told(c).alias(f"new_{c}") for c in [*FILLS, "address"]], kind.alias("new_kind"), F.max("ends").alias("new_ends"), F.min_by("title", "row").alias("title"), F.min_by("kind", "row").alias("first_kind"))
    s = schemes.withColumn("id", F.col("id").cast("string")).withColumn("stood", F.lit(True)).join(new, F.col("id") == F.col("scheme"), "full")
    stood = F.col("stood").isNotNull()
    fill = lambda c: F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.coalesce(f"new_{c}", c)).otherwise(F.col(c))
    bare = F.col("address").isNull() | (F.col("address") == "") | (F.col("address") == F.col("name"))
    kind = F.when(~stood, F.coalesce("new_kind", "first_kind")).when(F.col("kind").isNull() | (F.col("kind") == ANY_KIND), F.coalesce("new_kind", "kind")).otherwise(F.col("kind"))
    fields = {"id": F.coalesce("id", "scheme"), "name": F.when(stood, F.col("name")).otherwise(F.left("title", F.lit(NAME_LETTERS))), "address": F.when(bare, F.coalesce("new_address", "address")).otherwise(F.col("address")), "kind": kind, "ends": F.greatest("ends", "new_ends")}
    fields |= {c: fill(c) for c in FILLS}
    changed = F.when(~stood, "created").when(F.col("scheme").isNotNull(), "updated")
    after = s.select(*[fields[c].alias(c) for c in schemes.columns], changed.alias("change"))

    standing = contracts.withColumn("scheme", F.col("scheme").cast("string"))
    fresh = placed.join(standing.select("scheme", "reference"), ["scheme", "reference"], "left_anti")
    fresh = best_per_key(fresh.where("reference <> ''"), ["scheme", "reference"], F.col("row")).unionByName(fresh.where("reference IS NULL OR reference = ''"))
    last = fresh.groupBy("scheme").agg(F.max("row").alias("last"))
    old = standing.join(last, "scheme", "left").withColumn("is_current", F.col("is_current") & F.col("last").isNull()).select(*contracts.columns)
    added = fresh.join(last, "scheme").withColumn("is_current", F.col("row") == F.col("last")).select(*contracts.columns)
    return after, old.unionByName(added)
