"""Contacts from several sources, made one and merged into what is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIELDS = ["email", "phone", "link", "title"]


def one_of_each(contacts: DataFrame, keys: list[str], order: str = "row", confidence: str = "confidence") -> DataFrame:
    """One contact a key: that of the highest confidence, the first of equals; its gaps are filled by those that came after it, in their order.

    What came before the best one says nothing, as it was given up for it.
    """
    best = F.max(F.struct(F.coalesce(confidence, F.lit(-1.0)).alias("c"), (-F.col(order)).alias("before"))).over(Window.partitionBy(*keys))
    ranked = contacts.withColumn("__best", -best["before"]).where(F.col(order) >= F.col("__best"))
    there = lambda c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col(order))
    first = [F.coalesce(F.min_by(c, there(c)), F.min_by(c, order)).alias(c) for c in FIELDS]
    rest = [c for c in contacts.columns if c not in [*keys, *FIELDS]]
    return ranked.groupBy(*keys).agg(*first, *[F.min_by(c, order).alias(c) for c in rest]).select(*contacts.columns)


def merged_contacts(known: DataFrame, found: DataFrame) -> DataFrame:
    """Known contacts (id, company, name, email, phone, link, title, source, confidence) after found ones (row, company and the same).

    A found contact is a known one of its company by email, else by name (the least
    id); with as much confidence or more its fields, where there are any, replace
    the known ones, and its source and confidence. Others are new (a null id). Of
    several found for one contact the most confident counts, the last of equals.
    """
    ids = lambda *keys: known.where(F.col(keys[-1]) != "").groupBy(*keys).agg(F.min("id").alias(f"by_{keys[-1]}"))
    met = found.join(ids("company", "email"), ["company", "email"], "left").join(ids("company", "name"), ["company", "name"], "left").withColumn("id", F.coalesce("by_email", "by_name"))
    best = F.struct("confidence", "row")
    fields = [*FIELDS, "source", "confidence"]
    news = met.where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct(*fields), best).alias("n"))
    k = known.join(news, "id", "left")
    wins = F.coalesce(F.col("n.confidence") >= F.coalesce("confidence", F.lit(0.0)), F.lit(False))
    value = lambda c: F.when(wins & F.col(f"n.{c}").isNotNull() & (F.col(f"n.{c}").cast("string") != ""), F.col(f"n.{c}")).otherwise(F.col(c)).alias(c)
    old = k.select(*[value(c) if c in fields else F.col(c) for c in known.columns])
    fresh = met.where("id IS NULL").groupBy("company", "name").agg(F.max_by(F.struct(*fields), best).alias("n")).select(F.lit(None).cast(known.schema["id"].dataType).alias("id"), "company", "name", "n.*")
    return old.unionByName(fresh.select(*known.columns))
