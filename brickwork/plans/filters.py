"""Filter, predicate and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickwork.operators import predicates as p
from brickwork.registry import query, table

AS_OF = "1998-01-01"
#: Fragments of developer and operator names.
DEVELOPERS = (
    "greystar", "quintain", "get living", "moda", "apo group", "apache capital", "realstar", "way of life", "fizzy living",
    "essential living", "grainger", "platform", "cortland", "native group", "lifestory", "berkeley group", "berkeley homes",
    "lendlease", "british land", "landsec", "delancey", "long harbour", "patrizia", "m&g real estate",
    "legal & general affordable", "aviva investors", "sage housing", "unite students", "unite group", "iq student",
    "fresh student", "vita group", "scape student", "watkin jones",
)
#: Fixed value: wording of rental tenure.
RENTAL_TEXT = r"build[- ]to[- ]rent|\bbtr\b|\bprs\b|private rented sector|private rented|rental homes|rental apartments"

#: Parts as planning applications: types by brand, descriptions and applicants from columns, some missing.
APPLICATIONS = """
SELECT p_partkey AS id, p_size * 7 AS num_units, p_brand AS source, p_name AS address,
  CASE p_partkey % 9 WHEN 0 THEN 'BTR' WHEN 1 THEN 'PBSA' WHEN 2 THEN 'Co-living' WHEN 3 THEN 'Senior' WHEN 4 THEN 'Affordable'
    WHEN 5 THEN 'Mixed' WHEN 6 THEN 'Residential' WHEN 7 THEN 'Unknown' END AS scheme_type,
  CASE p_partkey % 7 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Pre-Application' WHEN 2 THEN 'Submitted' WHEN 3 THEN 'Approved' WHEN 4 THEN 'Refused' WHEN 5 THEN 'Decided' END AS status,
  CASE p_partkey % 11 WHEN 0 THEN concat('A Build-to-Rent tower of ', p_size, ' flats') WHEN 1 THEN concat(p_size, ' PRS homes') WHEN 2 THEN concat('sprsx ', p_name)
    WHEN 3 THEN NULL WHEN 4 THEN 'Single storey rear extension' WHEN 5 THEN 'Advertisement consent for signs' ELSE concat(p_size, ' no. residential flats') END AS description,
  CASE p_partkey % 13 WHEN 0 THEN 'Greystar Europe' WHEN 1 THEN 'Unite Students plc' WHEN 2 THEN NULL WHEN 3 THEN '' WHEN 4 THEN 'c/o Agent' ELSE concat(p_type, ' Ltd') END AS applicant_name,
  CASE WHEN p_partkey % 4 <> 0 THEN date_add(DATE '1997-01-01', CAST(p_partkey % 400 AS INT)) END AS submission_date,
  date_add(DATE '1997-06-01', CAST(p_partkey % 300 AS INT)) AS created_at
FROM part
"""


def applications(spark, d):
    return spark.sql(APPLICATIONS.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))


def with_applications(select: str) -> str:
    joined = "" if select.startswith(",") else " "
    return "WITH apps AS (" + APPLICATIONS.replace("date_add(DATE '1997-01-01', CAST(p_partkey % 400 AS INT))", "DATE '1997-01-01' + CAST(p_partkey % 400 AS INT)").replace("date_add(DATE '1997-06-01', CAST(p_partkey % 300 AS INT))", "DATE '1997-06-01' + CAST(p_partkey % 300 AS INT)") + ")" + joined + select


@query("filter_optional", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000")
def filter_optional(spark, d):
    o = table(spark, d, "orders")
    wanted = {"status": "F", "priority": None, "least": 100000}
    return p.all_of(
        o,
        F.col("o_orderstatus") == wanted["status"] if wanted["status"] else None,
        F.col("o_orderpriority") == wanted["priority"] if wanted["priority"] else None,
        p.within(F.col("o_totalprice"), wanted["least"]),
    ).select("o_orderkey", "o_totalprice")


@query("filter_tristate", with_applications("SELECT id, 'yes' AS has FROM apps WHERE applicant_name IS NOT NULL AND applicant_name <> '' UNION ALL SELECT id, 'no' FROM apps WHERE applicant_name IS NULL OR applicant_name = ''"))
def filter_tristate(spark, d):
    a = applications(spark, d)
    part = lambda wanted, name: p.all_of(a, p.present(F.col("applicant_name"), wanted)).select("id", F.lit(name).alias("has"))
    return part(True, "yes").unionAll(part(False, "no"))


@query("filter_range", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def filter_range(spark, d):
    return p.all_of(table(spark, d, "part"), p.within(F.col("p_size"), 10, 20)).select("p_partkey", "p_size")


@query("filter_in", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_in(spark, d):
    return p.all_of(table(spark, d, "orders"), p.one_of(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]), p.one_of(F.col("o_custkey"), [])).select("o_orderkey")


@query("filter_not_in_nullsafe", with_applications("SELECT id, scheme_type FROM apps WHERE scheme_type IS NULL OR scheme_type NOT IN ('Senior', 'PBSA')"))
def filter_not_in_nullsafe(spark, d):
    return applications(spark, d).where(p.none_of(F.col("scheme_type"), ["Senior", "PBSA"], True)).select("id", "scheme_type")


@query("filter_not_in", with_applications("SELECT id, scheme_type FROM apps WHERE scheme_type NOT IN ('Senior', 'PBSA')"))
def filter_not_in(spark, d):
    return applications(spark, d).where(p.none_of(F.col("scheme_type"), ["Senior", "PBSA"], False)).select("id", "scheme_type")


@query("search_multi", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority ILIKE '%ur_en%' OR c_mktsegment ILIKE '%ur_en%' OR n_name ILIKE '%ur_en%'")
def search_multi(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == c.c_custkey, "left").join(n, F.col("c_nationkey") == n.n_nationkey, "left")
    return o.where(p.matches_any("ur_en", [F.col("o_orderpriority"), F.col("c_mktsegment"), F.col("n_name")])).select("o_orderkey", "c_name")


@query("search_numeric", "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%12%' OR c_mktsegment ILIKE '%12%' OR c_custkey = 12")
def search_numeric(spark, d):
    c = table(spark, d, "customer")
    return c.where(p.number_or_text("12", F.col("c_custkey"), [F.col("c_name"), F.col("c_mktsegment")])).select("c_custkey", "c_name")


@query("filter_prefix", "SELECT p_partkey, p_brand FROM part WHERE p_brand ILIKE 'brand#1%' AND NOT p_type LIKE 'PROMO%'")
def filter_prefix(spark, d):
    return table(spark, d, "part").where(F.col("p_brand").ilike("brand#1%") & ~F.col("p_type").like("PROMO%")).select("p_partkey", "p_brand")


@query("filter_regex", "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '(?i)eco|rd$') AND NOT regexp_matches(p_name, '(?i)^b')")
def filter_regex(spark, d):
    return table(spark, d, "part").where(F.col("p_type").rlike("(?i)eco|rd$") & ~F.col("p_name").rlike("(?i)^b")).select("p_partkey", "p_type")


@query(
    "btr_eligible",
    with_applications(
        "SELECT id, scheme_type FROM apps WHERE (scheme_type IS NULL OR scheme_type NOT IN ('Senior', 'Affordable', 'PBSA', 'Co-living')) AND "
        f"coalesce(scheme_type = 'BTR' OR regexp_matches(description, '(?i){RENTAL_TEXT}') OR regexp_matches(applicant_name, '(?i){'|'.join(DEVELOPERS)}') "
        "OR (num_units >= 100 AND (scheme_type IN ('Residential', 'Mixed', 'Unknown') OR scheme_type IS NULL)), false)"
    ),
)
def btr_eligible(spark, d):
    kind = F.col("scheme_type")
    large = (F.col("num_units") >= 100) & (kind.isin("Residential", "Mixed", "Unknown") | kind.isNull())
    signal = (kind == "BTR") | F.col("description").rlike(f"(?i){RENTAL_TEXT}") | F.col("applicant_name").rlike("(?i)" + "|".join(DEVELOPERS)) | large
    return applications(spark, d).where(p.none_of(kind, ["Senior", "Affordable", "PBSA", "Co-living"], True) & signal).select("id", "scheme_type")


@query("bd_actionable", with_applications("SELECT id, status, num_units FROM apps WHERE status IN ('Pending', 'Pre-Application', 'Submitted') AND (num_units >= 20 OR scheme_type IN ('BTR', 'PBSA', 'Co-living', 'Senior', 'Affordable', 'Mixed'))"))
def bd_actionable(spark, d):
    kinds = ["BTR", "PBSA", "Co-living", "Senior", "Affordable", "Mixed"]
    return applications(spark, d).where(F.col("status").isin("Pending", "Pre-Application", "Submitted") & ((F.col("num_units") >= 20) | F.col("scheme_type").isin(kinds))).select("id", "status", "num_units")


@query("expiring_window", f"SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ends FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 90")
def expiring_window(spark, d):
    ends = F.to_date("o_orderdate")
    return table(spark, d, "orders").where(p.expiring(ends, F.lit(AS_OF).cast("date"), 90)).select("o_orderkey", ends.alias("ends"))


@query("new_this_week", with_applications("SELECT id, submission_date, created_at FROM apps WHERE submission_date >= DATE '1997-12-25' OR (submission_date IS NULL AND created_at >= DATE '1997-12-25')"))
def new_this_week(spark, d):
    since = F.date_sub(F.lit(AS_OF).cast("date"), 7)
    return applications(spark, d).where(p.fresh(F.col("submission_date"), F.col("created_at"), since)).select("id", "submission_date", "created_at")


@query("stale_rows", with_applications("SELECT id FROM apps WHERE submission_date IS NULL OR submission_date < DATE '1998-01-01' - 90"))
def stale_rows(spark, d):
    return applications(spark, d).where(p.stale(F.col("submission_date"), F.lit(AS_OF).cast("date"), 90)).select("id")


@query("rls_filter", "SELECT event_id, user_id, 'bd_analyst' AS role FROM events WHERE user_id = 3 UNION ALL SELECT event_id, user_id, 'bd_manager' FROM events")
def rls_filter(spark, d):
    e = table(spark, d, "events")
    one = lambda role: p.visible_rows(e, role, 3, F.col("user_id")).select("event_id", "user_id", F.lit(role).alias("role"))
    return one("bd_analyst").unionAll(one("bd_manager"))


@query("mask_pii", "SELECT c_custkey, 'viewer' AS role, CAST(NULL AS VARCHAR) AS name FROM customer UNION ALL SELECT c_custkey, 'admin', c_name FROM customer")
def mask_pii(spark, d):
    c = table(spark, d, "customer")
    one = lambda role: c.select("c_custkey", F.lit(role).alias("role"), p.masked(F.col("c_name"), role).alias("name"))
    return one("viewer").unionAll(one("admin"))


@query("flatten_orders", "SELECT CAST(o_orderkey AS VARCHAR) AS id, c_name AS operator_name, strftime(o_orderdate, '%Y-%m-%d') AS contract_end, lower(o_orderstatus) AS status FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def flatten_orders(spark, d):
    c = table(spark, d, "customer")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == c.c_custkey, "left").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("c_name").alias("operator_name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("contract_end"), F.lower("o_orderstatus").alias("status")
    )


@query(
    "score_fallback",
    "SELECT p_partkey, coalesce(nullif(stored, 0), nullif(linked, 0), p_size * 2.0) AS by_truth, coalesce(stored, linked, p_size * 2.0) AS by_null FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 0.0 WHEN p_partkey % 3 = 1 THEN p_size * 1.0 END AS stored, CASE WHEN p_partkey % 5 = 0 THEN 0.0 WHEN p_partkey % 5 = 1 THEN 50.0 END AS linked FROM part) t",
)
def score_fallback(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    t = table(spark, d, "part").withColumn("stored", F.when(key % 3 == 0, 0.0).when(key % 3 == 1, size * F.lit(1.0))).withColumn("linked", F.when(key % 5 == 0, 0.0).when(key % 5 == 1, 50.0))
    zero = F.lit(0.0)
    truth = F.coalesce(F.nullif("stored", zero), F.nullif("linked", zero), size * F.lit(2.0))
    return t.select("p_partkey", truth.alias("by_truth"), F.coalesce("stored", "linked", size * F.lit(2.0)).alias("by_null"))


@query("coalesce_nullif", with_applications("SELECT id, coalesce(nullif(applicant_name, ''), source) AS owner FROM apps"))
def coalesce_nullif(spark, d):
    return applications(spark, d).select("id", F.coalesce(F.nullif(F.col("applicant_name"), F.lit("")), "source").alias("owner"))


@query("map_values", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'hot' WHEN '2-HIGH' THEN 'hot' WHEN '3-MEDIUM' THEN 'warm' ELSE 'cold' END AS priority FROM orders")
def map_values(spark, d):
    names = {"1-URGENT": "hot", "2-HIGH": "hot", "3-MEDIUM": "warm"}
    return table(spark, d, "orders").select("o_orderkey", p.mapped(F.col("o_orderpriority"), names, F.lit("cold")).alias("priority"))


@query("keyword_any", with_applications("SELECT id FROM apps WHERE contains(lower(description), 'prs') OR contains(lower(description), 'tower')"))
def keyword_any(spark, d):
    return applications(spark, d).where(p.contains_any(F.lower("description"), ["prs", "tower"])).select("id")


@query(
    "array_overlap",
    "WITH k AS (SELECT p_partkey, [concat('70', CAST(p_partkey % 10 AS VARCHAR)), concat('45', CAST(p_size AS VARCHAR))] AS codes FROM part) SELECT p_partkey, list_has_any(codes, ['703', '4512']) AS exact, len(list_filter(codes, lambda c: starts_with(c, '451'))) > 0 AS prefix FROM k",
)
def array_overlap(spark, d):
    codes = F.array(F.concat(F.lit("70"), (F.col("p_partkey") % 10).cast("string")), F.concat(F.lit("45"), F.col("p_size").cast("string")))
    wanted = F.array(F.lit("703"), F.lit("4512"))
    return table(spark, d, "part").select("p_partkey", F.arrays_overlap(codes, wanted).alias("exact"), F.exists(codes, lambda c: c.startswith("451")).alias("prefix"))


@query("semi_scan", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def semi_scan(spark, d):
    keys = table(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, d, "lineitem").join(keys, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


for _name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
    query(f"scan_{_name}", f"SELECT * FROM {_name}")(lambda spark, d, name=_name: table(spark, d, name))
