"""Enrichment queries: further extractors, ratings, estimates and the depth-first ownership walk."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickwork.functions import names as n
from brickwork.operators import scoring as s
from brickwork.operators.graph import depth_first_walk
from brickwork.plans.domain import EDGES, edges
from brickwork.plans.text import lines, sql
from brickwork.registry import query, table

#: Padded fragments of owners that do not operate, looked at first.
NOT_OPERATORS = ("bank", "capital", "invest", "fund", "reit", "pension", "developments", "construction", "contractors")
#: A sample of brand fragments and the operator they stand for; callers pass their own table.
BRANDS = {"red ": "Red Living", "blue w": "Blue Living", " ring": "Ring Homes"}


@query("norm_authority", sql(r"SELECT id, trim(regexp_replace(regexp_replace(lower(x), '^(london borough of|royal borough of|city of|borough of) ', ''), ' (metropolitan borough council|borough council|city council|county council|council)$', '')) AS name FROM (SELECT id, concat(CASE id % 4 WHEN 0 THEN 'London Borough of ' WHEN 1 THEN 'City of ' ELSE '' END, p_name, CASE id % 3 WHEN 0 THEN ' Borough Council' WHEN 1 THEN ' Council' ELSE '' END) AS x FROM lines) y"))
def norm_authority(spark, d):
    """One prefix and one suffix go, each the first that fits."""
    before = F.when(F.col("id") % 4 == 0, "London Borough of ").when(F.col("id") % 4 == 1, "City of ").otherwise("")
    after = F.when(F.col("id") % 3 == 0, " Borough Council").when(F.col("id") % 3 == 1, " Council").otherwise("")
    text = F.lower(F.concat(before, "p_name", after))
    text = F.regexp_replace(text, "^(london borough of|royal borough of|city of|borough of) ", "")
    return lines(spark, d).select("id", F.trim(F.regexp_replace(text, " (metropolitan borough council|borough council|city council|county council|council)$", "")).alias("name"))


@query("date_multi", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 5 <> 4 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 5 = 4")
def date_multi(spark, d):
    key, day = F.col("o_orderkey") % 5, F.col("o_orderdate")
    forms = ["yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "d MMM yyyy"]
    raw = F.when(key == 4, "soon")
    for i, f in enumerate(forms):
        raw = raw.when(key == i, F.date_format(day, f))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(*[F.try_to_date(raw, f) for f in forms]).alias("day"))


@query("applicant", sql(r"SELECT id, CASE WHEN company IS NOT NULL AND NOT regexp_matches(company, '^[0-9/ -]+$') AND company <> '' THEN company ELSE nullif(regexp_extract(concat('Works by ', p_name, ' Ltd at site'), 'by ([A-Za-z ]+? (?:Ltd|Limited|PLC))', 1), '') END AS applicant FROM lines"))
def applicant(spark, d):
    text = F.concat(F.lit("Works by "), "p_name", F.lit(" Ltd at site"))
    found = F.regexp_extract(text, "by ([A-Za-z ]+? (?:Ltd|Limited|PLC))", 1)
    named = F.col("company").isNotNull() & ~F.col("company").rlike("^[0-9/ -]+$") & (F.col("company") != "")
    return lines(spark, d).select("id", F.when(named, F.col("company")).otherwise(F.nullif(found, F.lit(""))).alias("applicant"))


@query("canon_country", "SELECT s_suppkey, CASE WHEN x IN ('uk', 'england', 'united kingdom') THEN 'United Kingdom' WHEN x = 'jersey' THEN 'Jersey' ELSE 'Cayman Islands' END AS country FROM (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'uk' WHEN 1 THEN 'england' WHEN 2 THEN 'jersey' WHEN 3 THEN 'united kingdom' ELSE 'cayman islands' END AS x FROM supplier) y")
def canon_country(spark, d):
    raw = F.get(F.array(*[F.lit(x) for x in ("UK", "England, Wales", "JERSEY", "united kingdom", "cayman islands (KY)")]), (F.col("s_suppkey") % 5).cast("int"))
    first = F.lower(F.trim(F.regexp_extract(raw, r"^([^,(/]+)", 1)))
    name = F.when(first.isin("uk", "england", "wales", "scotland", "united kingdom", "great britain"), "United Kingdom").otherwise(F.initcap(first))
    return table(spark, d, "supplier").select("s_suppkey", name.alias("country"))


@query("score_inline", "SELECT p_partkey, round(0.4::DOUBLE * CASE p_type WHEN 'LARGE' THEN 100 WHEN 'MEDIUM' THEN 60 ELSE 30 END + 0.3::DOUBLE * least(p_size * 20 / 500.0::DOUBLE, 1) * 100 + 0.3::DOUBLE * CASE WHEN p_partkey % 2 = 0 THEN 80 ELSE 40 END, 4) AS score FROM part")
def score_inline(spark, d):
    kind = s.looked_up(F.col("p_type"), {"LARGE": 100.0, "MEDIUM": 60.0}, 30.0)
    units = F.least(F.col("p_size") * 20 / F.lit(500.0), F.lit(1.0)) * 100
    state = F.when(F.col("p_partkey") % 2 == 0, 80).otherwise(40)
    return table(spark, d, "part").select("p_partkey", F.round(F.lit(0.4) * kind + F.lit(0.3) * units + F.lit(0.3) * state, 4).alias("score"))


@query("track_record", "SELECT c_custkey, CASE WHEN n >= 10 THEN 100.0 WHEN n >= 5 THEN 80.0 WHEN n >= 2 THEN 60.0 WHEN n >= 1 THEN 40.0 ELSE 30.0 END::DOUBLE AS developer, CASE WHEN r_name = 'EUROPE' OR c_nationkey IN (1, 2) THEN 100.0 WHEN c_nationkey < 10 THEN 80.0 ELSE 50.0 END::DOUBLE AS location FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) x ON o_custkey = c_custkey")
def track_record(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    c = table(spark, d, "customer").join(places, "c_nationkey").join(counts, "c_custkey", "left")
    nation = F.col("c_nationkey")
    where = F.when((F.col("r_name") == "EUROPE") | nation.isin(1, 2), 100.0).when(nation < 10, 80.0).otherwise(50.0)
    return c.select("c_custkey", s.ladder(F.col("n"), [(10, 100.0), (5, 80.0), (2, 60.0), (1, 40.0)], 30.0, True).alias("developer"), where.alias("location"))


@query("confidence_locks", "SELECT p_partkey, round((CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.4 END + CASE WHEN p_size > 10 THEN CASE p_partkey % 2 WHEN 0 THEN 1.0 ELSE 0.4 END ELSE 0 END) / 2, 4)::DOUBLE AS confidence FROM part")
def confidence_locks(spark, d):
    """Each filled field counts by the trust of the source that locked it."""
    trust = {"manual": 1.0, "register": 0.8}
    sources = F.create_map(F.lit("name"), F.get(F.array(F.lit("manual"), F.lit("register"), F.lit("regex")), (F.col("p_partkey") % 3).cast("int")), F.lit("units"), F.when(F.col("p_partkey") % 2 == 0, "manual").otherwise("ai"))
    point = lambda field, filled: F.when(filled, s.looked_up(F.try_element_at(sources, F.lit(field)), trust, 0.4)).otherwise(0.0)
    return table(spark, d, "part").select("p_partkey", F.round((point("name", F.col("p_name").isNotNull()) + point("units", F.col("p_size") > 10)) / 2, 4).alias("confidence"))


@query("reclass_undo", "SELECT p_partkey, p_type AS old, 'SMALL' AS new FROM part WHERE p_type <> 'SMALL' AND p_size <= 3")
def reclass_undo(spark, d):
    """What a reclassification changes, kept so that it can be undone; undoing it gives the first state again."""
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_size")
    undo = p.where("p_type <> 'SMALL' AND p_size <= 3").select("p_partkey", F.col("p_type").alias("old"), F.lit("SMALL").alias("new"))
    changed = p.join(undo, "p_partkey", "left").select("p_partkey", F.coalesce("new", "p_type").alias("kind"), "old")
    return changed.where("old IS NOT NULL").select("p_partkey", "old", F.col("kind").alias("new"))


@query("operator_flag", "SELECT s_suppkey, m > o * 1.2 AND (s_nationkey IN (1, 2, 3) OR s_nationkey % 4 = 0) AS operator FROM supplier JOIN (SELECT l_suppkey, count(*) AS m, count(*) FILTER (WHERE l_returnflag <> 'R') AS o FROM lineitem GROUP BY 1) x ON l_suppkey = s_suppkey")
def operator_flag(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("m"), F.count_if(F.col("l_returnflag") != "R").alias("o"))
    kind = F.col("s_nationkey").isin(1, 2, 3) | (F.col("s_nationkey") % 4 == 0)
    return table(spark, d, "supplier").join(x, "s_suppkey").select("s_suppkey", ((F.col("m") > F.col("o") * 1.2) & kind).alias("operator"))


_PADDED = "concat(' ', lower(concat(p_name, CASE p_partkey % 10 WHEN 0 THEN ' capital' ELSE '' END)), ' ')"


@query("operator_rules", f"SELECT p_partkey, CASE WHEN {' OR '.join(f'''contains({_PADDED}, '{x}')''' for x in NOT_OPERATORS)} THEN NULL {' '.join(f'''WHEN contains({_PADDED}, '{k}') THEN '{v}' ''' for k, v in BRANDS.items())} END AS operator FROM part")
def operator_rules(spark, d):
    """Exclusions first, then brand fragments in the padded name, in order."""
    padded = F.concat(F.lit(" "), F.lower(F.concat("p_name", F.when(F.col("p_partkey") % 10 == 0, " capital").otherwise(""))), F.lit(" "))
    out = F.when(n.any_keyword(padded, list(NOT_OPERATORS)), None)
    for fragment, name in BRANDS.items():
        out = out.when(F.contains(padded, F.lit(fragment)), name)
    return table(spark, d, "part").select("p_partkey", out.alias("operator"))


@query("estimate_end", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + to_months(CASE o_orderpriority WHEN '1-URGENT' THEN 36 WHEN '2-HIGH' THEN 60 ELSE 48 END) AS DATE) AS ends, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'code' ELSE 'default' END AS provenance FROM orders")
def estimate_end(spark, d):
    months = F.try_element_at(F.create_map(F.lit("1-URGENT"), F.lit(36), F.lit("2-HIGH"), F.lit(60)), F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", F.add_months("o_orderdate", F.coalesce(months, F.lit(48))).alias("ends"), F.when(months.isNotNull(), "code").otherwise("default").alias("provenance"))


@query("backfill_end", sql("SELECT id, CAST(coalesce(CASE WHEN id % 4 = 0 THEN DATE '2020-01-31' END, CASE WHEN m IS NOT NULL AND id % 4 < 3 THEN CAST(DATE '2015-01-31' + to_months(m) AS DATE) END) AS DATE) AS ends FROM (SELECT id, CASE WHEN term = '5+2+2 years' THEN 108 WHEN term LIKE '% months' THEN p_size WHEN term LIKE 'a %-year term' AND p_size <= 30 THEN p_size * 12 WHEN term = '20+30 years' THEN 360 END AS m FROM lines) x"))
def backfill_end(spark, d):
    """A stored end, else a known start and the duration named in the text."""
    stored = F.when(F.col("id") % 4 == 0, F.lit("2020-01-31").cast("date"))
    start = F.when(F.col("id") % 4 < 3, F.lit("2015-01-31").cast("date"))
    return lines(spark, d).select("id", F.coalesce(stored, F.add_months(start, n.duration_months(F.col("term")))).alias("ends"))


@query("rent_load", "SELECT n_name, round(r.rent, 2) AS rent, k AS councils FROM (SELECT n_regionkey, arg_max(o_totalprice, o_orderkey) AS rent FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) r JOIN nation USING (n_regionkey) JOIN (SELECT n_regionkey, count(*) AS k FROM nation GROUP BY 1) c USING (n_regionkey)")
def rent_load(spark, d):
    """The latest figure of an area goes to each of its councils."""
    o, c, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    area = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.max_by("o_totalprice", "o_orderkey").alias("rent"))
    size = nation.groupBy("n_regionkey").agg(F.count("*").alias("councils"))
    return nation.join(area, "n_regionkey").join(size, "n_regionkey").select("n_name", F.round("rent", 2).alias("rent"), "councils")


@query("owner_walk", f"WITH RECURSIVE e AS ({EDGES}), walk AS (SELECT child AS root, parent AS node, 1 AS level, [child] AS seen FROM e WHERE NOT ceased UNION ALL SELECT root, parent, level + 1, list_append(seen, node) FROM walk JOIN e ON child = node WHERE level < 4 AND NOT ceased AND NOT list_contains(seen, node)) SELECT root, node, level FROM walk")
def owner_walk(spark, d):
    """Depth-first walk with one visited set per root. Here each company has one parent, so a recursive query gives the same rows."""
    return depth_first_walk(edges(spark, d).where("NOT ceased"), 4).select("root", "node", "level")
