"""Who owns and runs a scheme: sources in the order of trust, each filling nulls only, with the step that did it.

Candidates are one row a key before they meet the schemes, so no join
multiplies rows. All sources known by postcode meet the schemes in one join.
Schemes without a key match nothing; a postcode with very many schemes is a
skewed left side, which adaptive execution splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwork.functions.names import outward, postcode

#: Steps of the owner, in order of trust; the short run leaves out titles and addresses.
FULL = ("title", "directory", "application", "address", "contract", "outward")
SHORT = ("directory", "application", "contract", "outward")
#: A company counts as the owner of an outward code from so many schemes on.
LEAST_IN_OUTWARD = 3


def fill(df: DataFrame, field: str, candidates: list[tuple[str, Column]]) -> DataFrame:
    """The field's first non-null value of itself and the candidates; <field>_step names the candidate that filled it."""
    step = F.coalesce(*[F.when(value.isNotNull(), F.lit(name)) for name, value in candidates])
    before = F.col(f"{field}_step") if f"{field}_step" in df.columns else F.lit(None).cast("string")
    return df.withColumns({f"{field}_step": F.coalesce(before, F.when(F.col(field).isNull(), step)), field: F.coalesce(F.col(field), *[value for _, value in candidates])})


def backfilled_postcode(code: Column, address: Column, name: Column) -> Column:
    """The postcode, else the first one in address and name; without an address there is nothing to look in."""
    text = F.concat_ws(" ", address, name)
    return F.coalesce(F.nullif(code, F.lit("")), F.when(address != "", postcode(text)))


def merged(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of several sources as one row a key: the first non-null value of each column, where each source has one row a key."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy(key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in rows.columns if c != key])


def most_frequent(df: DataFrame, key: str, value: str, least: int = 1, name: str | None = None) -> DataFrame:
    """Each key's most frequent value, of those that occur so often; ties to the smaller value."""
    counts = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(name or f"found_{value}"))


def attribute(schemes: DataFrame, titles: DataFrame, applications: DataFrame, companies: DataFrame, contracts: DataFrame, steps: tuple[str, ...] = FULL, trusted: str = "directory") -> DataFrame:
    """Schemes with postcode, owner, operator and council filled, and the steps that filled them.

    ``schemes``: id, name, address, postcode, source, owner, operator, council;
    ``titles``: number, postcode, company; ``applications``: id, postcode,
    company, submitted; ``companies``: id, postcode of the registered address;
    ``contracts``: id, scheme, client, operator. Ties go to the smallest number,
    the latest application (then the greatest id), the smallest company, the
    smallest contract. Filled fields never change, so nulls only decrease.
    """
    s = schemes.withColumn("postcode", backfilled_postcode(F.col("postcode"), F.col("address"), F.col("name")))
    ours, use = s.where((F.col("source") == trusted) & F.col("postcode").isNotNull()), set(steps)
    by_postcode = [ours.groupBy("postcode").agg(F.min_by("owner", F.when(F.col("owner").isNotNull(), F.col("id"))).alias("directory"), F.min_by("operator", F.when(F.col("operator").isNotNull(), F.col("id"))).alias("directory_operator"))]
    if "title" in use:
        by_postcode.append(titles.where("company IS NOT NULL").groupBy("postcode").agg(F.min_by("company", "number").alias("title")))
    if "application" in use:
        by_postcode.append(applications.where("company IS NOT NULL").groupBy("postcode").agg(F.max_by("company", F.struct("submitted", "id")).alias("application")))
    if "address" in use:
        by_postcode.append(companies.groupBy("postcode").agg(F.min("id").alias("address_company")))
    by_scheme = contracts.groupBy(F.col("scheme").alias("id")).agg(F.min_by("client", F.when(F.col("client").isNotNull(), F.col("id"))).alias("contract"), F.min_by("operator", F.when(F.col("operator").isNotNull(), F.col("id"))).alias("contract_operator"))
    x = s.join(merged([p.where("postcode IS NOT NULL") for p in by_postcode], "postcode"), "postcode", "left").join(by_scheme, "id", "left")
    source = {"address": "address_company"}
    x = fill(x, "owner", [(step, F.col(source.get(step, step))) for step in steps if step != "outward"])
    x = fill(x, "operator", [("directory", F.col("directory_operator")), ("contract", F.col("contract_operator"))])
    x = x.select(*schemes.columns, "owner_step", "operator_step", outward(F.col("postcode")).alias("outward"))
    near = most_frequent(x, "outward", "owner", LEAST_IN_OUTWARD)
    place = most_frequent(x, "outward", "council")
    x = x.join(near, "outward", "left").join(place, "outward", "left")
    if "outward" in use:
        x = fill(x, "owner", [("outward", F.col("found_owner"))])
    x = fill(x, "council", [("outward", F.col("found_council"))])
    return x.select(*schemes.columns, "owner_step", "operator_step", "council_step")
