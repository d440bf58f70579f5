"""Scoring, classification, attribution and graph queries (R, E, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickwork.functions import names
from brickwork.functions.rounding import weighted_sql
from brickwork.operators import scoring as s
from brickwork.operators.graph import corporate_walk
from brickwork.operators.joining import best_per_key
from brickwork.plans.filters import DEVELOPERS, applications, with_applications
from brickwork.registry import query, table

AS_OF = "DATE '1998-01-01'"
_TYPES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in s.TYPE_SCORES.items())
_STAGES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in s.STAGE_SCORES.items())


@query(
    "score_application",
    with_applications(
        ", parts AS (SELECT id, CASE WHEN num_units IS NULL OR num_units <= 0 THEN 20.0 WHEN num_units >= 500 THEN 100.0 WHEN num_units >= 300 THEN 90.0 WHEN num_units >= 200 THEN 80.0 WHEN num_units >= 100 THEN 65.0 WHEN num_units >= 50 THEN 50.0 ELSE 30.0 END::DOUBLE AS size, "
        f"(CASE scheme_type {_TYPES} ELSE CASE WHEN scheme_type IS NULL THEN 30.0 ELSE 20.0 END END)::DOUBLE AS scheme_type, (CASE lower(trim(status)) {_STAGES} ELSE 30.0 END)::DOUBLE AS planning_stage, "
        f"CASE WHEN submission_date IS NULL THEN 30.0 WHEN {AS_OF} - submission_date <= 30 THEN 100.0 WHEN {AS_OF} - submission_date <= 90 THEN 80.0 WHEN {AS_OF} - submission_date <= 180 THEN 55.0 WHEN {AS_OF} - submission_date <= 365 THEN 30.0 ELSE 10.0 END::DOUBLE AS recency, "
        f"CASE WHEN applicant_name IS NULL OR applicant_name = '' THEN 20.0 WHEN regexp_matches(lower(trim(applicant_name)), '{'|'.join(DEVELOPERS)}') THEN 100.0 WHEN regexp_matches(lower(trim(applicant_name)), 'c/o |agent|mss |mr |mrs ') THEN 25.0 ELSE 50.0 END::DOUBLE AS applicant_signal FROM apps) "
        f"SELECT *, {weighted_sql(s.APPLICATION_WEIGHTS, {k: k for k in s.APPLICATION_WEIGHTS})} AS composite FROM parts"
    ),
)
def score_application(spark, d):
    parts = {
        "size": s.size_score(F.col("num_units")),
        "scheme_type": s.looked_up(F.coalesce("kind", F.lit("Unknown")), s.TYPE_SCORES, 20.0),
        "planning_stage": s.looked_up(F.lower(F.trim("status")), s.STAGE_SCORES, 30.0),
        "recency": s.recency_score(F.col("submission_date"), F.expr(AS_OF)),
        "applicant_signal": s.applicant_score(F.col("applicant_name"), DEVELOPERS),
    }
    scored = applications(spark, d).withColumnRenamed("scheme_type", "kind").select("id", *[c.alias(k) for k, c in parts.items()])
    return scored.withColumn("composite", s.composite(s.APPLICATION_WEIGHTS, {k: F.col(k) for k in parts}))


@query(
    "score_scheme",
    "WITH c AS (SELECT l_orderkey, max(l_shipdate) AS ends FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), x AS (SELECT o_orderkey, coalesce(ends, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END) AS e, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 51) / 10.0 END AS rating, CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 120) * 1.0 END AS legacy, "
    "CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 103) / 100.0 END AS occ, CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey % 130) * 1.0 END AS arrears FROM orders LEFT JOIN c ON l_orderkey = o_orderkey), "
    "m AS (SELECT *, (year(e) - 1998) * 12 + month(e) - 1 AS months FROM x), p AS (SELECT o_orderkey, (CASE WHEN months IS NULL THEN 35.0 WHEN months <= 6 THEN 100.0 WHEN months <= 12 THEN 85.0 WHEN months <= 24 THEN 55.0 ELSE 20.0 END)::DOUBLE AS contract_urgency, "
    "(CASE WHEN rating > 0 THEN CASE WHEN rating < 3.5 THEN 100.0 WHEN rating < 4.0 THEN 70.0 WHEN rating < 4.5 THEN 35.0 ELSE 10.0 END ELSE CASE WHEN legacy IS NOT NULL THEN greatest(0, 100 - legacy) ELSE 40.0 END END)::DOUBLE AS csat_gap, "
    "(CASE WHEN occ BETWEEN 0 AND 1 THEN CASE WHEN occ::DOUBLE * 100 < 80 THEN 100.0 WHEN occ::DOUBLE * 100 < 92 THEN 60.0 WHEN occ::DOUBLE * 100 < 98 THEN 25.0 ELSE 10.0 END ELSE CASE WHEN legacy IS NOT NULL THEN greatest(0, 100 - legacy) ELSE 45.0 END END)::DOUBLE AS occupancy_gap, "
    "(CASE WHEN arrears BETWEEN 0 AND 100 THEN arrears ELSE CASE WHEN legacy IS NOT NULL THEN greatest(0, 100 - legacy) ELSE 40.0 END END)::DOUBLE AS financial_distress FROM m) "
    f"SELECT *, {weighted_sql(s.SCHEME_WEIGHTS, {k: k for k in s.SCHEME_WEIGHTS})} AS composite FROM p",
)
def score_scheme(spark, d):
    key = F.col("o_orderkey")
    contract = table(spark, d, "lineitem").where("l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("ends"))
    o = table(spark, d, "orders").join(contract, "o_orderkey", "left").withColumn("end", F.coalesce("ends", F.when(key % 3 != 0, F.col("o_orderdate"))))
    some = lambda n, v: F.when(key % n != 0, v)
    legacy = F.when(key % 4 == 0, (key % 120) * F.lit(1.0))
    parts = {
        "contract_urgency": s.urgency_score(names.months_between_days(F.expr(AS_OF), F.col("end"))),
        "csat_gap": s.rating_score(some(5, (key % 51) / 10.0), legacy),
        "occupancy_gap": s.occupancy_score(some(7, (key % 103) / 100.0), legacy),
        "financial_distress": s.distress_score(some(6, (key % 130) * F.lit(1.0)), legacy),
    }
    scored = o.select("o_orderkey", *[c.alias(k) for k, c in parts.items()])
    return scored.withColumn("composite", s.composite(s.SCHEME_WEIGHTS, {k: F.col(k) for k in parts}))


@query(
    "score_company",
    "WITH a AS (SELECT o_custkey AS k, count(*) AS schemes, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01') AS recent, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01') AS previous, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS pipeline FROM orders GROUP BY 1), "
    "x AS (SELECT c_custkey, coalesce(schemes, 0) AS n, coalesce(recent, 0) AS r, coalesce(previous, 0) AS p, coalesce(pipeline, 0) AS q, c_acctbal > 5000 AS contact FROM customer LEFT JOIN a ON k = c_custkey), "
    "y AS (SELECT c_custkey, (CASE WHEN n >= 20 THEN 100.0 WHEN n >= 10 THEN 80.0 WHEN n >= 5 THEN 60.0 WHEN n >= 1 THEN 40.0 ELSE 10.0 END)::DOUBLE AS portfolio, round_even((CASE WHEN r > p AND p > 0 THEN least(100.0, 60.0 + r::DOUBLE / p * 20.0) WHEN r > 0 AND p = 0 THEN 80.0 WHEN r = p AND r > 0 THEN 50.0 ELSE 20.0 END)::DOUBLE, 1) AS growth, "
    f"(CASE WHEN contact AND q > 0 THEN 80.0 WHEN contact THEN 50.0 WHEN q > 0 THEN 40.0 ELSE 10.0 END)::DOUBLE AS relationship FROM x) SELECT *, {weighted_sql(s.COMPANY_WEIGHTS, {k: k for k in s.COMPANY_WEIGHTS})} AS overall FROM y",
)
def score_company(spark, d):
    day = F.col("o_orderdate")
    during = lambda a, b: F.count_if((day >= F.lit(a).cast("timestamp")) & (day < F.lit(b).cast("timestamp")))
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n"), during("1997-01-01", "1998-01-01").alias("r"), during("1996-01-01", "1997-01-01").alias("p"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("q")
    )
    c = table(spark, d, "customer").join(counts, "c_custkey", "left").fillna(0, ["n", "r", "p", "q"])
    r, p, contact = F.col("r"), F.col("p"), F.col("c_acctbal") > 5000
    growth = F.when((r > p) & (p > 0), F.least(F.lit(100.0), 60.0 + r / F.nullif(p, F.lit(0)) * 20.0)).when((r > 0) & (p == 0), 80.0).when((r == p) & (r > 0), 50.0).otherwise(20.0)
    relation = F.when(contact & (F.col("q") > 0), 80.0).when(contact, 50.0).when(F.col("q") > 0, 40.0).otherwise(10.0)
    scored = c.select("c_custkey", s.ladder(F.col("n"), [(20, 100.0), (10, 80.0), (5, 60.0), (1, 40.0)], 10.0, True).alias("portfolio"), F.bround(growth, 1).alias("growth"), relation.alias("relationship"))
    return scored.withColumn("overall", s.composite(s.COMPANY_WEIGHTS, {k: F.col(k) for k in s.COMPANY_WEIGHTS}))


@query("signal_label", "SELECT p_partkey, CASE WHEN p_size * 2 >= 90 THEN 'critical' WHEN p_size * 2 >= 70 THEN 'high' WHEN p_size * 2 >= 50 THEN 'medium' WHEN p_size * 2 >= 35 THEN 'low' ELSE 'none' END AS label FROM part")
def signal_label(spark, d):
    v = F.col("p_size") * 2
    return table(spark, d, "part").select("p_partkey", F.when(v >= 90, "critical").when(v >= 70, "high").when(v >= 50, "medium").when(v >= 35, "low").otherwise("none").alias("label"))


@query("arrears_risk", "SELECT s_suppkey, least(greatest(30 + CASE s_suppkey % 4 WHEN 0 THEN 40 WHEN 1 THEN 10 ELSE 0 END + CASE WHEN s_acctbal < 0 THEN 25 ELSE 0 END + CASE WHEN n > 600 THEN 15 ELSE 0 END + CASE WHEN r > 200 THEN 15 ELSE 0 END, 0), 100)::INTEGER AS score FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) x ON l_suppkey = s_suppkey")
def arrears_risk(spark, d):
    charges = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    add = lambda test, points: F.when(test, points).otherwise(0)
    state = F.col("s_suppkey") % 4
    total = F.lit(30) + F.when(state == 0, 40).when(state == 1, 10).otherwise(0) + add(F.col("s_acctbal") < 0, 25) + add(F.col("n") > 600, 15) + add(F.col("r") > 200, 15)
    return table(spark, d, "supplier").join(charges, "s_suppkey", "left").select("s_suppkey", F.least(F.greatest(total, F.lit(0)), F.lit(100)).cast("int").alias("score"))


@query("confidence_fields", with_applications("SELECT id, round(((scheme_type IS NOT NULL)::INTEGER + (status IS NOT NULL)::INTEGER + (description IS NOT NULL)::INTEGER + (nullif(applicant_name, '') IS NOT NULL)::INTEGER + (submission_date IS NOT NULL)::INTEGER + (num_units IS NOT NULL)::INTEGER) / 6.0, 4)::DOUBLE AS confidence FROM apps"))
def confidence_fields(spark, d):
    columns = [F.col(c) for c in ("scheme_type", "status", "description", "submission_date", "num_units")] + [F.nullif(F.col("applicant_name"), F.lit(""))]
    points = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return applications(spark, d).select("id", F.round(points / F.lit(6.0), 4).alias("confidence"))


@query("reclassify", with_applications("SELECT id, scheme_type AS old, CASE WHEN description LIKE '%Build-to-Rent%' AND coalesce(CASE scheme_type WHEN 'BTR' THEN 3 WHEN 'PBSA' THEN 3 WHEN 'Mixed' THEN 2 WHEN 'Residential' THEN 1 ELSE 0 END, 0) < 3 THEN 'BTR' ELSE scheme_type END AS new FROM apps"))
def reclassify(spark, d):
    """A new class never replaces one at least as specific."""
    rank = s.looked_up(F.col("scheme_type"), {"BTR": 3.0, "PBSA": 3.0, "Mixed": 2.0, "Residential": 1.0}, 0.0)
    found = F.when(F.col("description").like("%Build-to-Rent%"), "BTR")
    return applications(spark, d).select("id", F.col("scheme_type").alias("old"), F.when(found.isNotNull() & (rank < 3), found).otherwise(F.col("scheme_type")).alias("new"))


@query("spv_flag", "SELECT c_custkey, list_has_any([c_nationkey, c_nationkey + 1], [4, 9, 12]) AND coalesce(n, 0) <= 10 AS spv FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) x ON o_custkey = c_custkey")
def spv_flag(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    codes = F.arrays_overlap(F.array("c_nationkey", F.col("c_nationkey") + 1), F.array(F.lit(4), F.lit(9), F.lit(12)))
    return table(spark, d, "customer").join(counts, "c_custkey", "left").select("c_custkey", (codes & (F.coalesce("n", F.lit(0)) <= 10)).alias("spv"))


@query(
    "attribution_cascade",
    "WITH t AS (SELECT l_partkey, min(l_suppkey) AS title FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), a AS (SELECT l_partkey, max(l_suppkey) AS contract FROM lineitem WHERE l_quantity > 40 GROUP BY 1) SELECT p_partkey, coalesce(CASE WHEN p_partkey % 8 = 0 THEN 1000 END, title, contract, CASE WHEN p_size > 20 THEN p_size END)::BIGINT AS operator, "
    "CASE WHEN p_partkey % 8 = 0 THEN 'stored' WHEN title IS NOT NULL THEN 'title' WHEN contract IS NOT NULL THEN 'contract' WHEN p_size > 20 THEN 'outward' END AS source FROM part LEFT JOIN t ON t.l_partkey = p_partkey LEFT JOIN a ON a.l_partkey = p_partkey",
)
def attribution_cascade(spark, d):
    """The first source that knows an operator wins; all sources join once."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("title"), F.max(F.when(F.col("l_quantity") > 40, F.col("l_suppkey"))).alias("contract"))
    steps = [("stored", F.when(F.col("p_partkey") % 8 == 0, F.lit(1000).cast("long"))), ("title", F.col("title")), ("contract", F.col("contract")), ("outward", F.when(F.col("p_size") > 20, F.col("p_size").cast("long")))]
    source = F.coalesce(*[F.when(c.isNotNull(), name) for name, c in steps])
    return table(spark, d, "part").join(li, "p_partkey", "left").select("p_partkey", F.coalesce(*[c for _, c in steps]).alias("operator"), source.alias("source"))


@query("epc_attribution", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END, x.c, o_custkey % 7) AS operator FROM orders LEFT JOIN (SELECT DISTINCT ON (l_orderkey) l_orderkey, l_suppkey AS c FROM lineitem WHERE l_linestatus = 'F' ORDER BY l_orderkey, l_quantity DESC, l_suppkey) x ON l_orderkey = o_orderkey")
def epc_attribution(spark, d):
    best = best_per_key(table(spark, d, "lineitem").where("l_linestatus = 'F'"), ["l_orderkey"], F.desc("l_quantity"), F.col("l_suppkey")).select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("c"))
    stored = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey"))
    return table(spark, d, "orders").join(best, "o_orderkey", "left").select("o_orderkey", F.coalesce(stored, "c", F.col("o_custkey") % 7).alias("operator"))


EDGES = "SELECT c_custkey AS child, (c_custkey * 7 + 3) % 1500 AS parent, CASE c_custkey % 6 WHEN 0 THEN 'individual' ELSE 'corporate' END AS kind, c_custkey % 11 = 0 AS ceased FROM customer"


def edges(spark, d):
    return spark.sql(EDGES.replace("FROM customer", "FROM {customer}"), customer=table(spark, d, "customer"))


@query(
    "owner_chain",
    f"WITH RECURSIVE e AS ({EDGES}), walk AS (SELECT child AS root, parent AS node, 1 AS level, [child, parent] AS seen FROM e WHERE kind = 'corporate' AND NOT ceased AND child <> parent UNION ALL SELECT root, parent, level + 1, list_append(seen, parent) FROM walk JOIN e ON child = node WHERE level < 3 AND kind = 'corporate' AND NOT ceased AND NOT list_contains(seen, parent)) SELECT root, node, level FROM walk",
)
def owner_chain(spark, d):
    return corporate_walk(edges(spark, d).where("kind = 'corporate' AND NOT ceased"), 3)


@query(
    "ultimate_owner",
    f"WITH RECURSIVE e AS ({EDGES}), walk AS (SELECT child AS root, parent AS node, 1 AS level, [child, parent] AS seen FROM e WHERE kind = 'corporate' AND NOT ceased AND child <> parent UNION ALL SELECT root, parent, level + 1, list_append(seen, parent) FROM walk JOIN e ON child = node WHERE level < 4 AND kind = 'corporate' AND NOT ceased AND NOT list_contains(seen, parent)) SELECT root, arg_max(node, level) AS owner FROM walk GROUP BY root",
)
def ultimate_owner(spark, d):
    walk = corporate_walk(edges(spark, d).where("kind = 'corporate' AND NOT ceased"), 4)
    return walk.groupBy("root").agg(F.max_by("node", F.struct("level", "node")).alias("owner"))


@query("chain_lookup", f"SELECT o_orderkey, parent, p.c_name FROM orders JOIN ({EDGES}) e ON child = o_custkey JOIN customer p ON p.c_custkey = parent WHERE NOT ceased")
def chain_lookup(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("parent"), "c_name")
    e = edges(spark, d).where("NOT ceased").select(F.col("child").alias("o_custkey"), "parent")
    return table(spark, d, "orders").join(e, "o_custkey").join(c, "parent").select("o_orderkey", "parent", "c_name")
