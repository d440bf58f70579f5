"""Loads of title and rent files, and councils from postcodes: matched, and replaced by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwork.operators.joining import best_per_key

#: Words of scheme names that tell nothing apart.
COMMON_WORDS = ["the", "and", "house", "court", "student", "students", "hall", "halls", "apartments"]


def title_rows(df: DataFrame, source: str) -> DataFrame:
    """Rows of a title file for the table of owners: trimmed, with a postcode key, a numeric price or null, and the day as yyyy-mm-dd; empty fields are null.

    Rows without a title number, and the file's own count row, go.
    """
    text = lambda c: F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))
    clean = lambda c: F.nullif(F.translate(F.regexp_replace(c, "[\\t\\n\\r]", " "), "\\\\", "/"), F.lit(""))
    price, day = text("Price Paid"), text("Date Proprietor Added")
    written = F.when(F.size(F.split(day, "-")) == 3, F.when(F.length(F.split_part(day, F.lit("-"), F.lit(1))) == 2, F.concat_ws("-", *[F.split_part(day, F.lit("-"), F.lit(k)) for k in (3, 2, 1)]))).otherwise(day)
    rows = df.where((text("Title Number") != "") & ~F.startswith(text("Title Number"), F.lit("Row Count")))
    columns = {"title_number": text("Title Number"), "tenure": text("Tenure"), "postcode": text("Postcode"), "pc_key": F.replace(F.upper(text("Postcode")), F.lit(" "), F.lit("")), "price_paid": F.when(price.rlike("^[0-9]+$"), price).otherwise(""), "date_added": F.coalesce(written, day)}
    return rows.select(F.lit(source).alias("source"), *[clean(c).alias(name) for name, c in columns.items()])


def name_words(name: Column) -> Column:
    """The words of three letters and more that tell a scheme apart."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(r"[a-z]{3,}"), 0)), F.array(*map(F.lit, COMMON_WORDS)))


def matched_rents(rents: DataFrame, schemes: DataFrame) -> DataFrame:
    """The rents (row, url, postcode, name and figures) with ``scheme``; those without one go.

    By an equal address first (the greatest id); else of the schemes of the postcode
    that with the most words of the name in common, one at least (the least id of
    equals); else the postcode's only scheme, if the name has no words. ``schemes``:
    id, url, postcode, name.
    """
    key = lambda c: F.replace(F.upper(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit(""))
    by_url = schemes.where("url IS NOT NULL").groupBy(F.col("url")).agg(F.max("id").alias("by_url"))
    asked = rents.withColumns({"__key": key(F.col("postcode")), "__words": name_words(F.col("name"))}).join(by_url, "url", "left")
    there = schemes.where(F.coalesce("postcode", F.lit("")) != "").select(F.col("id").alias("__id"), key(F.col("postcode")).alias("__key"), name_words(F.col("name")).alias("__own"))
    open_ = asked.where("by_url IS NULL AND __key <> ''")
    words = open_.select("row", "__key", F.explode("__words").alias("w")).join(there.select("__id", "__key", F.explode("__own").alias("w")), ["__key", "w"])
    shared = words.groupBy("row", "__id").agg(F.count("*").alias("n"))  # pairs that share a word only, not all of a postcode
    best = best_per_key(shared, ["row"], F.desc("n"), F.col("__id")).select("row", F.col("__id").alias("by_name"))
    alone = there.groupBy("__key").agg(F.min("__id").alias("only"), F.count("*").alias("k")).where("k = 1").drop("k")
    out = asked.join(best, "row", "left").join(alone, "__key", "left")
    scheme = F.coalesce("by_url", "by_name", F.when(F.size("__words") == 0, F.col("only")))
    return out.withColumn("scheme", scheme).where("scheme IS NOT NULL").select(*rents.columns, "scheme")


def replaced_by_source(state: DataFrame, rows: DataFrame, sources: list[str]) -> DataFrame:
    """The state without the rows of these sources, and the new rows."""
    return state.where(F.col("source").isNull() | ~F.col("source").isin(sources)).unionByName(rows)


def councils_filled(schemes: DataFrame, lookup: DataFrame, councils: DataFrame) -> DataFrame:
    """Schemes (id, postcode, council) with councils filled, and ``council_name`` where one has to be made.

    First the commonest council of the postcode's outward part among schemes that
    have one (the least of equals); then that of the looked-up district (``lookup``:
    postcode, district), by its name whatever the case (``councils``: id, name).
    """
    outward = F.upper(F.split_part(F.col("postcode"), F.lit(" "), F.lit(1)))
    known = schemes.where("council IS NOT NULL AND postcode <> ''").groupBy(outward.alias("outward"), "council").agg(F.count("*").alias("n"))
    common = known.groupBy("outward").agg(F.min_by("council", F.struct(-F.col("n"), F.col("council"))).alias("common"))
    key = lambda c: F.replace(F.upper(c), F.lit(" "), F.lit(""))
    named = councils.groupBy(F.lower("name").alias("k")).agg(F.min("id").alias("named"))
    districts = lookup.where(F.trim("district") != "").groupBy(key(F.col("postcode")).alias("pc")).agg(F.min(F.trim("district")).alias("district")).withColumn("k", F.lower("district")).join(named, "k", "left")
    out = schemes.withColumns({"outward": outward, "pc": key(F.col("postcode"))}).join(common, "outward", "left").join(districts.drop("k"), "pc", "left")
    filled = F.coalesce("council", "common", "named")
    return out.select("id", "postcode", filled.alias("council"), F.when(filled.isNull(), F.col("district")).alias("council_name"))
