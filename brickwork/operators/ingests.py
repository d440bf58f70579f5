"""Registers of providers, stock, judgements, sites and councils, merged into what is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwork.functions.prose import valid_company
from brickwork.operators.joining import best_per_key, containing

#: Links of the register's own pages that are no providers; states of those struck off; how much more than it owns an operator manages.
NO_PROVIDERS = [
    "a to z list of landlords", "individual social housing providers and regulatory judgements", "regulatory judgements and enforcement notices",
    "regulatory judgements, enforcement notices and gradings", "registered providers of social housing",
]
STRUCK_OFF = r"deregister|removed"
MANAGES_MORE = 1.2
LANDLORDS = ["RP", "LRP"]
#: Fixed value: so many letters of an area's name are looked for in councils' names.
NAME_LETTERS = 30


def matched_companies(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """The rows with ``company``: the least id of the same registration, else of the same normalised name, else null.

    ``rows`` and ``companies`` have registration and norm_name, ``companies`` id too.
    """
    least = lambda key: companies.where(F.col(key) != "").groupBy(F.col(key).alias(f"__{key}")).agg(F.min("id").alias(f"__by_{key}"))
    out = rows
    for key in ("registration", "norm_name"):
        out = out.join(least(key), F.col(key) == F.col(f"__{key}"), "left")
    return out.withColumn("company", F.coalesce("__by_registration", "__by_norm_name")).select(*rows.columns, "company")


def merged_providers(companies: DataFrame, providers: DataFrame) -> DataFrame:
    """Companies after a list of providers, with ``change``: "updated", "created" (a null id) or null.

    ``companies``: id, name, norm_name, kind, address, registration; ``providers``:
    row, name, norm_name, registration, address, status, provider_type. Providers
    struck off or without a valid name say nothing; of several rows of one company
    (or one new name) the first counts. A company becomes a landlord unless it is
    one; its address and registration are filled where they are missing.
    """
    kind = F.when(F.coalesce("provider_type", F.lit("PRP")) == "PRP", "RP").otherwise("LRP")
    good = providers.where((F.trim("name") != "") & valid_company(F.trim("name")) & ~F.coalesce(F.lower("status").rlike(STRUCK_OFF), F.lit(False)))
    met = matched_companies(good.withColumn("new_kind", kind), companies)
    known = best_per_key(met.where("company IS NOT NULL"), ["company"], F.col("row")).select(F.col("company").alias("id"), "new_kind", F.col("address").alias("new_address"), F.col("registration").alias("new_registration"))
    c = companies.join(known, "id", "left")
    kind_now = F.when(F.col("new_kind").isNotNull() & (F.col("kind").isNull() | ~F.col("kind").isin(LANDLORDS)), F.col("new_kind")).otherwise(F.col("kind"))
    filled = lambda c: F.when((F.coalesce(F.col(c), F.lit("")) == "") & (F.col(f"new_{c}") != ""), F.col(f"new_{c}")).otherwise(F.col(c))
    now = [kind_now.alias("kind"), filled("address").alias("address"), filled("registration").alias("registration")]
    changed = ~(kind_now.eqNullSafe(F.col("kind")) & filled("address").eqNullSafe(F.col("address")) & filled("registration").eqNullSafe(F.col("registration")))
    old = c.select("id", "name", "norm_name", *now, F.when(changed, "updated").alias("change"))
    new = best_per_key(met.where("company IS NULL"), ["norm_name"], F.col("row"))
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    return old.unionByName(new.select(F.lit(None).cast(companies.schema["id"].dataType).alias("id"), F.trim("name").alias("name"), "norm_name", F.col("new_kind").alias("kind"), empty("address").alias("address"), empty("registration").alias("registration"), F.lit("created").alias("change")))


def with_stock(companies: DataFrame, stock: DataFrame) -> DataFrame:
    """Companies (id, kind, registration, norm_name, owned, managed, for_others) with the figures of a return (row, registration, norm_name, owned, managed, for_others).

    The last row of a company counts, figures that it lacks stay; a landlord, or a
    company of no kind, that manages over MANAGES_MORE times what it owns is an operator.
    """
    met = matched_companies(stock.where("norm_name <> ''"), companies).where("company IS NOT NULL")
    last = best_per_key(met, ["company"], F.desc("row")).select(F.col("company").alias("id"), *[F.col(c).alias(f"new_{c}") for c in ("owned", "managed", "for_others")])
    out = companies.join(last, "id", "left")
    more = (F.col("new_owned") > 0) & (F.col("new_managed") > F.col("new_owned") * MANAGES_MORE) & (F.col("kind").isNull() | F.col("kind").isin(LANDLORDS))
    figures = [F.coalesce(f"new_{c}", c).alias(c) for c in ("owned", "managed", "for_others")]
    return out.select("id", F.when(more, "Operator").otherwise(F.col("kind")).alias("kind"), "registration", "norm_name", *figures)


def judged_schemes(schemes: DataFrame, judgements: DataFrame, health: Column) -> DataFrame:
    """Schemes (id, name, operator, kind, rating, health) after judgements (row, provider, company, governance) of companies, with ``change``.

    A company's first scheme (the least id) takes the last judgement's rating and
    ``health`` where there are any; a company without a scheme gets one.
    """
    good = judgements.where(F.col("company").isNotNull() & ~F.lower(F.trim("provider")).isin(NO_PROVIDERS) & valid_company(F.trim("provider"))).withColumn("new_health", health)
    last = best_per_key(good, ["company"], F.desc("row")).select("company", "provider", "governance", "new_health")
    first = schemes.where("operator IS NOT NULL").groupBy(F.col("operator").alias("company")).agg(F.min("id").alias("scheme"))
    met = last.join(first, "company", "left")
    told = met.where("scheme IS NOT NULL").select(F.col("scheme").alias("id"), "governance", "new_health", F.lit("enriched").alias("change"))
    rating = F.coalesce(F.nullif(F.col("governance"), F.lit("")), "rating")
    old = schemes.join(told, "id", "left").select("id", "name", "operator", "kind", rating.alias("rating"), F.coalesce("new_health", "health").alias("health"), "change")
    name = F.concat(F.trim("provider"), F.lit(" - Social Housing"))
    new = met.where("scheme IS NULL").select(F.lit(None).cast(schemes.schema["id"].dataType).alias("id"), name.alias("name"), F.col("company").alias("operator"), F.lit("Social Housing").alias("kind"), F.col("governance").alias("rating"), F.col("new_health").alias("health"), F.lit("created").alias("change"))
    return old.unionByName(new)


def merged_sites(state: DataFrame, sites: DataFrame, councils: DataFrame) -> DataFrame:
    """Sites (reference, council, address, postcode, latitude, longitude, units, status) after a register's rows (row, reference, organisation, and the rest).

    Rows without a reference, a place, or a known organisation (councils: id,
    organisation) say nothing. A new site comes as it is; of a known one only
    units, postcode and coordinates are filled where they are missing. Of several
    rows of one site the first makes it, and later ones fill what it lacks.
    """
    keys, fills = ["reference", "council"], ["postcode", "latitude", "longitude", "units"]
    own = councils.where("organisation <> ''").groupBy("organisation").agg(F.min("id").alias("council"))
    good = sites.where("reference <> '' AND (address <> '' OR postcode <> '')").join(own, "organisation")
    there = lambda c: F.when(F.col(c).cast("string") != "", F.col("row"))
    first = lambda c: F.coalesce(F.min_by(c, there(c)), F.min_by(c, "row")) if c in fills else F.min_by(c, "row")
    fields = [c for c in state.columns if c not in keys]
    delta = good.groupBy(*keys).agg(*[first(c).alias(c) for c in fields])
    known = state.select(*keys, F.struct(*fields).alias("old"))
    both = known.join(delta, keys, "full")
    value = lambda c: F.when(F.col("old").isNull(), F.col(c)).when(F.lit(c in fills), F.coalesce(F.when(F.col(f"old.{c}").cast("string") != "", F.col(f"old.{c}")), F.col(c))).otherwise(F.col(f"old.{c}"))
    return both.select(*keys, *[value(c).alias(c) for c in fields])


def council_figures(councils: DataFrame, rows: DataFrame) -> DataFrame:
    """id and the figures of the areas: (row, area, and columns of figures), each at the least council whose name holds the area's, else its first word.

    Of several areas of one council the last row counts.
    """
    norm = rows.where(F.trim("area") != "").withColumn("norm", F.left(F.lower(F.trim("area")), F.lit(NAME_LETTERS))).withColumn("word", F.element_at(F.split(F.lower(F.trim("area")), r"\s+"), 1))
    names = councils.select("id", F.lower("name").alias("council_name"))

    def holding(column: str) -> DataFrame:
        pairs = containing(names, "council_name", norm.select(column), column)
        return pairs.join(names, "council_name").groupBy(column).agg(F.min("id").alias(f"by_{column}"))

    met = norm.join(holding("norm"), "norm", "left").join(holding("word"), "word", "left").withColumn("id", F.coalesce("by_norm", "by_word")).where("id IS NOT NULL")
    figures = [c for c in rows.columns if c not in ("row", "area")]
    return best_per_key(met, ["id"], F.desc("row")).select("id", "area", *figures)
