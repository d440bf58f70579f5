"""What changed between two dated snapshots of a register, and what it means: new vehicles of developers, land that companies hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brickwork.functions.names import company_number

#: From so many titles on, a holding is of medium priority; so many postcodes are named.
MEDIUM_TITLES, NAMED_POSTCODES = 5, 20


def register_changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, change ("new", "gone", "changed"), the fields as they are now (or last were), and the names of those that changed."""
    old = before.select(key, F.struct(*fields).alias("old"))
    new = after.select(key, F.struct(*fields).alias("new"))
    both = old.join(new, key, "full")
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    names = F.array_compact(F.array(*[F.when(F.col("old").isNotNull() & F.col("new").isNotNull() & ~F.col(f"old.{f}").eqNullSafe(F.col(f"new.{f}")), f) for f in fields]))
    return both.select(key, change.alias("change"), F.coalesce("new", "old").alias("now"), names.alias("fields")).where("change IS NOT NULL").select(key, "change", "now.*", "fields")


def tracked_vehicles(found: DataFrame, companies: DataFrame) -> DataFrame:
    """What each company found in a register means for the known ones: number, name, sic, developer, action, company, parent.

    ``found``: number, name, norm_name, sic, developer (normalised name of who set
    it up); ``companies``: id, number, norm_name, sic. By an equal number: "update"
    if the codes differ, else "known"; else by name: "number" if the known company
    has none, else "known"; else "new", with the parent of the developer's name, and
    an opportunity. One row a number; of one number's rows the least name counts.
    """
    named = found.where("number <> '' AND name <> ''")
    once = named.groupBy("number").agg(F.min_by(F.struct("name", "norm_name", "sic", "developer"), F.struct("name", "developer")).alias("f")).select("number", "f.*")
    least = lambda key: companies.where(F.col(key) != "").groupBy(F.col(key).alias(f"__{key}")).agg(F.min_by(F.struct("id", "number", "sic"), "id").alias(f"by_{key}"))
    by_number, by_name = least("number"), least("norm_name")
    parent = companies.where("norm_name <> ''").groupBy(F.col("norm_name").alias("developer")).agg(F.min("id").alias("parent"))
    met = once.join(by_number, F.col("number") == F.col("__number"), "left").join(by_name, F.col("norm_name") == F.col("__norm_name"), "left").join(parent, "developer", "left")
    by_number, by_name = F.col("by_number"), F.col("by_norm_name")
    update = F.when(F.col("sic").isNotNull() & ~F.col("sic").eqNullSafe(by_number["sic"]), "update").otherwise("known")
    action = F.when(by_number.isNotNull(), update).when(by_name.isNotNull(), F.when(F.coalesce(by_name["number"], F.lit("")) == "", "number").otherwise("known")).otherwise("new")
    company = F.coalesce(by_number["id"], by_name["id"])
    title = F.when(action == "new", F.concat(F.lit("New SPV: "), "name"))
    return met.select("number", "name", "developer", action.alias("action"), company.alias("company"), F.when(action == "new", F.col("parent")).alias("parent"), title.alias("opportunity"))


def land_opportunities(titles: DataFrame, companies: DataFrame, known: DataFrame) -> DataFrame:
    """company, action, title, description, priority: what the titles that a company holds make of it.

    ``titles``: title, number (of the holder), postcode, tenure ("Freehold" or
    "Leasehold"); ``companies``: id, name, number; ``known``: company, of which an
    opportunity exists ("update" it, else "create" one). Numbers meet in their
    canonical form. Counts are summed before the join.
    """
    held = titles.select(company_number(F.col("number")).alias("number"), "title", "postcode", "tenure").where("number <> ''").distinct()
    counted = held.groupBy("number").agg(
        F.count_distinct("title").alias("n"),
        F.count_distinct(F.when(F.col("tenure") == "Freehold", F.col("title"))).alias("freehold"),
        F.count_distinct(F.when(F.col("tenure") == "Leasehold", F.col("title"))).alias("leasehold"),
    )
    places = held.where("postcode <> ''").select("number", "postcode").distinct()
    first = places.withColumn("place", F.row_number().over(Window.partitionBy("number").orderBy("postcode"))).where(F.col("place") <= NAMED_POSTCODES)
    listed = first.groupBy("number").agg(F.array_join(F.array_sort(F.collect_list("postcode")), ", ").alias("postcodes"))
    own = companies.select(F.col("id").alias("company"), "name", company_number(F.col("number")).alias("number")).where("number <> ''")
    met = own.join(counted, "number").join(listed, "number", "left").join(known.select("company", F.lit(True).alias("known")).distinct(), "company", "left")
    text = F.concat(F.lit("Land Registry CCOD shows "), "name", F.lit(" (CH: "), "number", F.lit(") owns "), "n", F.lit(" title(s) ("), "freehold", F.lit(" freehold, "), "leasehold", F.lit(" leasehold). Postcodes: "), F.coalesce("postcodes", F.lit("")))
    title = F.concat(F.lit("Land ownership: "), "name", F.lit(" ("), "n", F.lit(" titles)"))
    return met.select("company", F.when(F.col("known"), "update").otherwise("create").alias("action"), title.alias("title"), text.alias("description"), F.when(F.col("n") < MEDIUM_TITLES, "Low").otherwise("Medium").alias("priority"))
