"""Readers of the register files: positional CSV, title CSV, JSON lines and nested JSON; and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The 16 positions of a price-paid line.
PRICE_PAID = ("transaction_id", "price", "date", "postcode", "property_type", "old_new", "duration", "paon", "saon", "street", "locality", "town", "district", "county", "ppd_category", "record_status")
SLOT = "Proprietor Name ({0})", "Company Registration No. ({0})", "Proprietorship Category ({0})", "Country Incorporated ({0})"


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def price_paid(raw: DataFrame, line: str = "value") -> DataFrame:
    """New-build sales of a headerless file: exactly 16 fields, not deleted, with price, date and postcode."""
    schema = ", ".join(f"{c} string" for c in PRICE_PAID)
    fields = F.from_csv(F.col(line), F.lit(schema + ", extra string"), {"mode": "PERMISSIVE"})
    rows = raw.where(F.size(F.split(line, ",")) >= len(PRICE_PAID)).select(fields.alias("f")).select("f.*").where("extra IS NULL AND record_status IS NOT NULL")
    rows = rows.where("old_new = 'Y' AND record_status <> 'D'")
    clean = rows.select(F.translate("transaction_id", "{}", "").alias("transaction_id"), F.col("price").try_cast("long").alias("price"), F.try_to_date(F.substring("date", 1, 10), "yyyy-MM-dd").alias("date"), F.upper(F.trim("postcode")).alias("postcode"), "property_type", "town")
    return clean.where("price IS NOT NULL AND date IS NOT NULL AND postcode <> ''")


def proprietors(columns: list[str]) -> Column:
    """The proprietor slots of a title row from left to right, up to the first empty name."""
    slots = F.array(*[F.struct(*[(F.col(f"`{n.format(k)}`") if n.format(k) in columns else F.lit(None).cast("string")).alias(a) for n, a in zip(SLOT, ("name", "ch_number", "category", "country"))]) for k in range(1, 5)])
    first_empty = F.array_position(F.transform(slots, lambda s: F.coalesce(F.trim(s["name"]) == "", F.lit(True))), True)
    return F.slice(slots, F.lit(1), F.when(first_empty == 0, F.lit(4)).otherwise((first_empty - 1).cast("int")))


def titles(df: DataFrame) -> DataFrame:
    """Title rows with a number and at least one proprietor."""
    out = df.withColumn("proprietors", proprietors(df.columns))
    return out.where("`Title Number` <> '' AND size(proprietors) > 0").select(F.col("`Title Number`").alias("title_number"), F.col("`Postcode`").alias("postcode"), "proprietors")


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    return titles(spark.read.csv(path, header=True, encoding="UTF-8"))


_PERIOD, _VALUE = "struct<startDate:string,endDate:string>", "struct<amount:double,currency:string>"
RELEASE = (
    f"ocid string, date string, tag array<string>, buyer struct<name:string>, contracts array<struct<period:{_PERIOD},value:{_VALUE}>>, "
    f"awards array<struct<suppliers:array<struct<name:string>>,value:{_VALUE},contractPeriod:{_PERIOD}>>, "
    f"tender struct<title:string,description:string,value:{_VALUE},contractPeriod:{_PERIOD},items:array<struct<classification:struct<id:string>>>>"
)


def _day(text: Column) -> Column:
    return F.try_to_date(F.substring(F.trim(text), 1, 10), "yyyy-MM-dd")


def _first(items: Column, get) -> Column:
    """The first value that there is among those of an array's elements."""
    return F.get(F.array_compact(F.transform(items, get)), F.lit(0))


def _codes(tender: Column) -> Column:
    return F.filter(F.transform(F.coalesce(tender["items"], F.array()), lambda i: i["classification"]["id"]), lambda c: F.rlike(c, F.lit(r"^\d{8}$")))


def releases(df: DataFrame, json: str = "value") -> DataFrame:
    """Tender releases: ocid, title, starts, ends, value, supplier, codes; the first of each that there is, in contracts, the tender's period, awards."""
    r = df.select(F.from_json(json, RELEASE).alias("r")).select("r.*")
    amount = lambda x: F.when(x["value"]["amount"] > 0, x["value"]["amount"])
    day = lambda end: F.coalesce(_first(F.col("contracts"), lambda c: _day(c["period"][end])), _day(F.col(f"tender.contractPeriod.{end}")), _first(F.col("awards"), lambda a: _day(a["contractPeriod"][end])))
    supplier = _first(F.col("awards"), lambda a: F.nullif(F.trim(F.get(a["suppliers"], F.lit(0))["name"]), F.lit("")))
    value = F.coalesce(_first(F.col("contracts"), amount), _first(F.col("awards"), amount))
    return r.select("ocid", F.col("tender.title").alias("title"), day("startDate").alias("starts"), day("endDate").alias("ends"), value.alias("value"), supplier.alias("supplier"), _codes(F.col("tender")).alias("codes"))


def signed_releases(df: DataFrame, json: str = "value") -> DataFrame:
    """The same of registers where the signed state counts: the contract with the latest end (the first of equals, else the last contract), then the last award, then the tender."""
    r = df.select(F.from_json(json, RELEASE).alias("r")).select("r.*").where("ocid <> ''")
    ends = F.transform(F.col("contracts"), lambda c, i: F.struct(_day(c["period"]["endDate"]).alias("end"), (-i).alias("before")))
    latest = F.array_max(F.filter(ends, lambda e: e["end"].isNotNull()))
    last = lambda items: F.get(items, F.size(items) - 1)
    contract = F.coalesce(F.get("contracts", -latest["before"]), last(F.col("contracts")))
    r = r.withColumn("contract", contract).withColumn("award", last(F.col("awards")))
    day = lambda end: F.coalesce(_day(F.col(f"contract.period.{end}")), _day(F.col(f"award.contractPeriod.{end}")), _day(F.col(f"tender.contractPeriod.{end}")))
    value = F.coalesce("contract.value.amount", "award.value.amount", "tender.value.amount")
    supplier = F.coalesce(F.get("award.suppliers", F.lit(0))["name"], F.lit(""))
    return r.select("ocid", F.col("tender.title").alias("title"), day("startDate").alias("starts"), day("endDate").alias("ends"), value.alias("value"), supplier.alias("supplier"), _codes(F.col("tender")).alias("codes"))


def embedded_json(html: Column, marker: str) -> Column:
    """The JSON text of the script element with this id."""
    found = F.regexp_extract(html, rf"(?is)<script[^>]*id=[\"']{marker}[\"'][^>]*>(.*?)</script>", 1)
    return F.when(found != "", found)


def replace_partitions(df: DataFrame, path: str, column: str) -> None:
    """Delete-then-load by source: only the partitions in ``df`` are overwritten."""
    df.write.partitionBy(column).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def owner_chains(spark: SparkSession, path: str) -> DataFrame:
    """Documents with a company and its chain of owners: one row an owner, with its place in the chain."""
    docs = spark.read.schema("result struct<company:string,chain:array<struct<name:string>>>").json(path, multiLine=True)
    return docs.select("result.company", F.posexplode("result.chain").alias("place", "owner")).select("company", "place", F.col("owner.name").alias("owner"))
