"""Merge, audit and incremental queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickwork.operators import changes as c
from brickwork.registry import query, table

#: How much a source is trusted.
SOURCE_RANKS = {"manual": 100, "hmlr_ccod": 80, "companies_house": 80, "arl": 60, "epc": 60, "operator": 50, "pbsa": 50, "tenders": 40, "rsh": 35, "ai": 20, "regex": 10}
STATE = "SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 3 <> 0 THEN p_type ELSE '' END AS kind, p_size AS units FROM part WHERE p_partkey % 5 <> 0"
DELTA = "SELECT p_partkey AS id, concat(p_name, '*') AS name, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 <> 1 THEN p_brand END AS kind, CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE p_size + 1 END AS units FROM part WHERE p_partkey % 2 = 0"


def _both(spark, d):
    part = table(spark, d, "part")
    return tuple(spark.sql(x.replace("FROM part", "FROM {part}"), part=part) for x in (STATE, DELTA))


def _merged(rule) -> str:
    fields = ", ".join(f"CASE WHEN s.id IS NULL THEN d.{f} WHEN d.id IS NULL THEN s.{f} ELSE {rule(f)} END AS {f}" for f in ("name", "kind", "units"))
    return f"SELECT coalesce(s.id, d.id) AS id, {fields} FROM ({STATE}) s FULL JOIN ({DELTA}) d ON s.id = d.id"


@query("upsert", _merged(lambda f: f"coalesce(d.{f}, s.{f})"))
def upsert(spark, d):
    return c.upsert(*_both(spark, d), ["id"], c.non_null)


@query("upsert_truthy", _merged(lambda f: f"CASE WHEN d.{f} IS NULL OR CAST(d.{f} AS VARCHAR) IN ('', '0') THEN s.{f} ELSE d.{f} END"))
def upsert_truthy(spark, d):
    return c.upsert(*_both(spark, d), ["id"], c.truthy)


@query("upsert_fill", _merged(lambda f: f"coalesce(nullif(s.{f}, ''), d.{f})" if f != "units" else "coalesce(s.units, d.units)"))
def upsert_fill(spark, d):
    state, delta = _both(spark, d)
    return c.upsert(state, delta, ["id"], lambda old, new: F.coalesce(F.when(old.cast("string") != "", old), new))


@query("insert_ignore", f"SELECT * FROM ({STATE}) s UNION ALL SELECT * FROM ({DELTA}) d WHERE NOT EXISTS (SELECT 1 FROM ({STATE}) s WHERE s.id = d.id)")
def insert_ignore(spark, d):
    return c.insert_ignore(*_both(spark, d), ["id"])


@query("change_log", f"SELECT s.id, f.field, CASE f.field WHEN 'name' THEN s.name WHEN 'kind' THEN s.kind ELSE CAST(s.units AS VARCHAR) END AS old, CASE f.field WHEN 'name' THEN d.name WHEN 'kind' THEN d.kind ELSE CAST(d.units AS VARCHAR) END AS new FROM ({STATE}) s JOIN ({DELTA}) d USING (id) CROSS JOIN (SELECT unnest(['name', 'kind', 'units']) AS field) f WHERE old IS DISTINCT FROM new")
def change_log(spark, d):
    return c.change_log(*_both(spark, d), "id", ["name", "kind", "units"])


_RANK = "CASE source WHEN 'manual' THEN 100 WHEN 'companies_house' THEN 80 WHEN 'epc' THEN 60 ELSE 10 END"
_WRITES = "SELECT l_orderkey AS id, CASE l_linenumber % 2 WHEN 0 THEN 'units' ELSE 'operator' END AS field, CASE l_returnflag WHEN 'A' THEN 'manual' WHEN 'N' THEN 'epc' ELSE 'unlisted' END AS source, CASE WHEN l_quantity > 5 THEN CAST(l_suppkey AS STRING) END AS value, l_linenumber * 100000 + l_partkey AS seq FROM lineitem"


@query("set_field", f"SELECT id, field, arg_max(value, {_RANK} * 10000000000::BIGINT + seq * 100 + CAST(value AS BIGINT) % 100) AS value, max({_RANK}) AS rank FROM ({_WRITES}) w WHERE value IS NOT NULL GROUP BY 1, 2")
def set_field(spark, d):
    writes = spark.sql(_WRITES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, d, "lineitem"))
    writes = writes.withColumn("order", F.col("seq") * 100 + F.col("value").cast("long") % 100)
    best = c.by_precedence(writes, "id", "field", "source", SOURCE_RANKS, "order")
    rank = F.when(F.col("source") == "manual", 100).when(F.col("source") == "epc", 60).otherwise(10)
    return best.select("id", "field", "value", rank.alias("rank"))


@query("validate", "SELECT p_partkey, CASE WHEN p_size NOT BETWEEN 5 AND 45 THEN 'units' WHEN p_type NOT IN ('SMALL', 'LARGE', 'MEDIUM', 'PROMO') THEN 'type' END AS error, CASE WHEN p_size BETWEEN 5 AND 45 AND p_type IN ('SMALL', 'LARGE', 'MEDIUM', 'PROMO') THEN p_size END AS units FROM part")
def validate(spark, d):
    error = F.when(~F.col("p_size").between(5, 45), "units").when(~F.col("p_type").isin("SMALL", "LARGE", "MEDIUM", "PROMO"), "type")
    return table(spark, d, "part").select("p_partkey", error.alias("error"), F.when(error.isNull(), F.col("p_size")).alias("units"))


@query("supersede", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey, l_suppkey) = 1 AS is_current FROM lineitem")
def supersede(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_shipdate"), F.desc("l_linenumber"), "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.row_number().over(w) == 1).alias("is_current"))


@query("monotone_update", "SELECT o_orderkey, greatest(o_orderdate, coalesce(m, o_orderdate)) AS ends, CASE WHEN o_orderpriority = '5-LOW' THEN coalesce(k, '5-LOW') ELSE o_orderpriority END AS kind FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS m, max(l_returnflag) AS k FROM lineitem GROUP BY 1) x ON l_orderkey = o_orderkey")
def monotone_update(spark, d):
    new = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("m"), F.max("l_returnflag").alias("k"))
    kind = F.when(F.col("o_orderpriority") == "5-LOW", F.coalesce("k", F.lit("5-LOW"))).otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").join(new, "o_orderkey", "left").select("o_orderkey", F.greatest("o_orderdate", "m").alias("ends"), kind.alias("kind"))


@query("validate_contract", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_extendedprice > 0 AND l_extendedprice < 1e10 AND l_shipdate >= o_orderdate")
def validate_contract(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    ok = (F.col("l_extendedprice") > 0) & (F.col("l_extendedprice") < 1e10) & (F.col("l_shipdate") >= F.col("o_orderdate"))
    return table(spark, d, "lineitem").join(o, "l_orderkey").where(ok).select("l_orderkey", "l_linenumber", "l_partkey")


@query("contact_dedupe", "SELECT user_id, event_type, arg_max(event_id, value * 1000000 + event_id / 1000000.0) AS best, count(*) AS merged FROM events GROUP BY 1, 2")
def contact_dedupe(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("value", "event_id")).alias("best"), F.count("*").alias("merged"))


@query("split_table", "SELECT 'moved' AS part, p_partkey, CAST(NULL AS BIGINT) AS link FROM part WHERE p_brand = 'Brand#1' UNION ALL SELECT 'kept', p_partkey, CASE WHEN p_partkey % 20 NOT IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#1') THEN p_partkey % 20 END FROM part WHERE p_brand <> 'Brand#1'")
def split_table(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", (F.col("p_partkey") % 20).alias("link"))
    moved = p.where("p_brand = 'Brand#1'")
    gone = moved.select(F.col("p_partkey").alias("link"), F.lit(True).alias("gone"))
    kept = p.where("p_brand <> 'Brand#1'").join(gone, "link", "left").select(F.lit("kept").alias("part"), "p_partkey", F.when(F.col("gone").isNull(), F.col("link")).alias("link"))
    return moved.select(F.lit("moved").alias("part"), "p_partkey", F.lit(None).cast("long").alias("link")).unionAll(kept)


@query("delete_noise", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_totalprice < 20000)")
def delete_noise(spark, d):
    noise = table(spark, d, "orders").where("o_totalprice < 20000").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(noise, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("replace_source", f"SELECT id, name FROM ({STATE}) s WHERE kind <> 'PROMO' UNION ALL SELECT id, name FROM ({DELTA}) d WHERE kind = 'Brand#3'")
def replace_source(spark, d):
    state, delta = _both(spark, d)
    return state.where("kind <> 'PROMO'").unionByName(delta.where("kind = 'Brand#3'")).select("id", "name")


@query("bulk_update", "SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN 'X' ELSE o_orderstatus END AS status FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) x ON c_custkey = o_custkey")
def bulk_update(spark, d):
    ids = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("X").alias("new"))
    return table(spark, d, "orders").join(ids, "o_custkey", "left").select("o_orderkey", F.coalesce("new", "o_orderstatus").alias("status"))


@query("collapse_listings", "SELECT p_size, p_type, count(*) FILTER (WHERE p_partkey % 3 <> 0) AS adverts, coalesce(min(p_partkey) FILTER (WHERE p_partkey % 3 = 0), min(p_partkey)) AS block FROM part GROUP BY 1, 2")
def collapse_listings(spark, d):
    """Room adverts fold into the real block of their place, else the first advert stands for it."""
    real = F.col("p_partkey") % 3 == 0
    return table(spark, d, "part").groupBy("p_size", "p_type").agg(F.count_if(~real).alias("adverts"), F.coalesce(F.min(F.when(real, F.col("p_partkey"))), F.min("p_partkey")).alias("block"))


@query("new_alerts", "SELECT e.event_id, e.user_id FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events x WHERE x.event_type = 'error' AND x.user_id = e.user_id AND x.ts >= e.ts - INTERVAL 24 HOUR AND (x.ts < e.ts OR (x.ts = e.ts AND x.event_id < e.event_id)))")
def new_alerts(spark, d):
    """An alert is raised unless the same user had one within 24 hours before."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").where("event_type = 'error'").withColumn("before", F.lag("ts").over(w))
    return e.where(F.col("before").isNull() | (F.col("before") < F.col("ts") - F.expr("INTERVAL 24 HOURS"))).select("event_id", "user_id")
