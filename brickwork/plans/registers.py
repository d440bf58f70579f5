"""Registers and records: new vehicles of developers, land held, changes between snapshots, three tiers of matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickwork.functions.names import title_key
from brickwork.functions.risk import regulatory_grades
from brickwork.functions.similarity import LEAST_SEQUENCE, sequence_ratio
from brickwork.operators import ingests, tenders
from brickwork.operators import registers as r
from brickwork.operators.matching import match_records
from brickwork.plans.joins import _SCORE, _SORTED
from brickwork.plans.risk import made
from brickwork.registry import query, table

#: Two snapshots of a register of companies, some gone, new or changed in the later one.
BEFORE = "SELECT c_custkey AS number, c_name AS name, c_mktsegment AS sic, c_nationkey AS office FROM {customer} WHERE c_custkey % 7 <> 0"
AFTER = "SELECT c_custkey AS number, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 'MOVED' ELSE c_mktsegment END AS sic, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS office FROM {customer} WHERE c_custkey % 9 <> 0"


@query(
    "register_changes",
    f"WITH b AS ({BEFORE.format(customer='customer')}), a AS ({AFTER.format(customer='customer')}) SELECT number, 'new' AS change, name, sic, office, '' AS fields FROM a WHERE number NOT IN (SELECT number FROM b) UNION ALL SELECT number, 'gone', name, sic, office, '' FROM b WHERE number NOT IN (SELECT number FROM a) "
    "UNION ALL SELECT number, 'changed', a.name, a.sic, a.office, concat_ws(',', CASE WHEN a.sic <> b.sic THEN 'sic' END, CASE WHEN a.office IS DISTINCT FROM b.office THEN 'office' END) FROM a JOIN b USING (number) WHERE a.sic <> b.sic OR a.office IS DISTINCT FROM b.office",
)
def register_changes(spark, d):
    out = r.register_changes(made(spark, d, BEFORE, "customer"), made(spark, d, AFTER, "customer"), "number", ["name", "sic", "office"])
    return out.withColumn("fields", F.array_join("fields", ","))


FOUND = "SELECT lpad(CAST(c_custkey % 900 AS STRING), 8, '0') AS number, CASE WHEN c_custkey % 13 <> 0 THEN c_name END AS name, concat('customer ', c_custkey % 40) AS developer, c_mktsegment AS sic FROM {customer} WHERE c_custkey % 3 <> 0"
KNOWN = "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN '' WHEN s_suppkey % 4 = 1 THEN lpad(CAST(s_suppkey * 5 AS STRING), 8, '0') ELSE concat('X', s_suppkey) END AS number, concat('customer ', CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 3 ELSE s_suppkey % 30 END) AS norm_name, CASE WHEN s_suppkey % 3 = 0 THEN 'BUILDING' END AS sic FROM {supplier}"
_NAME = "concat('customer ', CAST(substr(name, 10) AS INTEGER))"


@query(
    "spv_tracking",
    f"WITH f AS (SELECT DISTINCT ON (number) number, name, developer, sic, {_NAME} AS norm FROM ({FOUND.format(customer='customer')}) x WHERE name IS NOT NULL ORDER BY number, name, developer), k AS ({KNOWN.format(supplier='supplier')}), "
    "j AS (SELECT f.*, (SELECT arg_min({'id': id, 'sic': sic}, id) FROM k WHERE k.number = f.number) AS a, (SELECT arg_min({'id': id, 'number': k.number}, id) FROM k WHERE k.norm_name = f.norm) AS b, (SELECT min(id) FROM k WHERE k.norm_name = f.developer) AS p FROM f), "
    "w AS (SELECT *, CASE WHEN a IS NOT NULL THEN CASE WHEN sic IS DISTINCT FROM a.sic THEN 'update' ELSE 'known' END WHEN b IS NOT NULL THEN CASE WHEN b.number = '' THEN 'number' ELSE 'known' END ELSE 'new' END AS action FROM j) "
    "SELECT number, name, developer, action, coalesce(a.id, b.id) AS company, CASE WHEN action = 'new' THEN p END AS parent, CASE WHEN action = 'new' THEN concat('New SPV: ', name) END AS opportunity FROM w",
)
def spv_tracking(spark, d):
    found = made(spark, d, FOUND, "customer").withColumn("norm_name", F.expr(_NAME))
    return r.tracked_vehicles(found, made(spark, d, KNOWN, "supplier"))


TITLES = "SELECT concat('T', l_orderkey % 5000) AS title, CASE WHEN l_suppkey % 3 = 0 THEN CAST(l_suppkey AS STRING) WHEN l_suppkey % 3 = 1 THEN concat(' sc', lpad(CAST(l_suppkey AS STRING), 6, '0')) ELSE '' END AS number, concat('LS', l_partkey % 60, ' 1AA') AS postcode, CASE WHEN l_orderkey % 5000 % 3 = 0 THEN 'Leasehold' ELSE 'Freehold' END AS tenure FROM {lineitem} WHERE l_quantity > 45"
HOLDERS = "SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN lpad(CAST(s_suppkey AS STRING), 8, '0') WHEN s_suppkey % 3 = 1 THEN concat('SC', lpad(CAST(s_suppkey AS STRING), 6, '0')) END AS number FROM {supplier}"


@query(
    "land_opportunities",
    f"WITH t AS (SELECT DISTINCT title, CASE WHEN regexp_matches(trim(number), '^[0-9]+$') THEN lpad(trim(number), 8, '0') ELSE upper(trim(number)) END AS number, postcode, tenure FROM ({TITLES.format(lineitem='lineitem')}) x WHERE number <> ''), g AS (SELECT number, count(DISTINCT title) AS n, count(DISTINCT title) FILTER (WHERE tenure = 'Freehold') AS f, count(DISTINCT title) FILTER (WHERE tenure = 'Leasehold') AS l, "
    f"array_to_string(list_slice(list_sort(list_distinct(list(postcode))), 1, 20), ', ') AS p FROM t GROUP BY 1) SELECT id AS company, CASE WHEN id % 2 = 0 THEN 'update' ELSE 'create' END AS action, concat('Land ownership: ', name, ' (', n, ' titles)') AS title, concat('Land Registry CCOD shows ', name, ' (CH: ', number, ') owns ', n, ' title(s) (', f, ' freehold, ', l, ' leasehold). Postcodes: ', p) AS description, CASE WHEN n < 5 THEN 'Low' ELSE 'Medium' END AS priority FROM ({HOLDERS.format(supplier='supplier')}) h JOIN g USING (number)",
)
def land_opportunities(spark, d):
    known = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("company"))
    return r.land_opportunities(made(spark, d, TITLES, "lineitem"), made(spark, d, HOLDERS, "supplier"), known)


INCOMING = "SELECT c_custkey AS row, CASE WHEN c_custkey % 4 = 0 THEN concat('R', c_custkey) WHEN c_custkey % 4 = 1 THEN '' END AS reference, CASE WHEN c_custkey % 3 = 0 THEN concat(reverse(c_mktsegment), ' court ', c_custkey % 90) ELSE concat('Court ', c_custkey % 300, CASE WHEN c_custkey % 2 = 0 THEN ', ' ELSE ' ' END, c_mktsegment) END AS title, concat('LS', c_custkey % 50) AS postcode, concat('op ', c_nationkey) AS operator FROM {customer}"
RECORDS = "SELECT p_partkey AS id, concat('R', p_partkey * 3) AS reference, concat(CASE p_partkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'HOUSEHOLD' END, ' Court ', p_partkey % 300, CASE WHEN p_partkey % 5 = 0 THEN ' Leeds' ELSE '' END) AS name, concat('LS', p_partkey % 70) AS postcode, concat('op ', p_size % 25) AS operator FROM {part}"


@query(
    "record_match",
    f"WITH i AS ({INCOMING.format(customer='customer')}), k AS ({RECORDS.format(part='part')}), n AS (SELECT id, {_SORTED.format('name')} AS b FROM (SELECT * FROM k ORDER BY id DESC LIMIT 300) x), t AS (SELECT DISTINCT {_SORTED.format('title')} AS a FROM i), s AS (SELECT a, id, {_SCORE} AS score FROM t CROSS JOIN n), "
    f"best AS (SELECT a, id FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id DESC) AS rn FROM s WHERE score >= 80) y WHERE rn = 1), one AS (SELECT i.*, (SELECT min(id) FROM k WHERE k.reference = i.reference AND i.reference <> '') AS m1, best.id AS m2, (SELECT min(id) FROM k WHERE k.postcode = i.postcode AND k.operator = i.operator) AS m3 FROM i LEFT JOIN best ON best.a = {_SORTED.format('title')}) "
    "SELECT row, coalesce(m1, m2, m3) AS match, CASE WHEN m1 IS NOT NULL THEN 1 WHEN m2 IS NOT NULL THEN 2 ELSE 3 END AS tier FROM one WHERE coalesce(m1, m2, m3) IS NOT NULL",
)
def record_match(spark, d):
    """Tenders' titles against the 300 newest schemes' names, many of them near-equal, between references and places."""
    return match_records(made(spark, d, INCOMING, "customer"), made(spark, d, RECORDS, "part"), newest=300)


COMPANIES = "SELECT s_suppkey AS id, s_name AS name, lower(s_name) AS norm_name, CASE s_suppkey % 6 WHEN 0 THEN 'RP' WHEN 1 THEN 'LRP' WHEN 2 THEN 'Developer' WHEN 3 THEN 'Operator' END AS kind, CASE WHEN s_suppkey % 4 = 0 THEN 'Old Hall' WHEN s_suppkey % 4 = 1 THEN '' END AS address, CASE WHEN s_suppkey % 5 = 0 THEN concat('L', s_suppkey) WHEN s_suppkey % 5 = 1 THEN '' END AS registration, CAST(s_suppkey % 50 AS BIGINT) AS owned, CAST(NULL AS BIGINT) AS managed, CAST(3 AS BIGINT) AS for_others FROM {supplier}"
PROVIDERS = "SELECT c_custkey AS row, CASE WHEN c_custkey % 11 = 0 THEN '12345' WHEN c_custkey % 13 = 0 THEN ' ' WHEN c_custkey % 3 = 0 THEN concat('Supplier#', lpad(CAST(c_custkey % 120 AS STRING), 9, '0')) ELSE concat('Customer#', lpad(CAST(c_custkey % 700 AS STRING), 9, '0')) END AS name, CASE c_custkey % 4 WHEN 0 THEN concat('L', c_custkey % 90) WHEN 1 THEN '' ELSE concat('N', c_custkey) END AS registration, CASE WHEN c_custkey % 5 <> 0 THEN concat('Hall ', c_custkey) ELSE '' END AS address, CASE c_custkey % 7 WHEN 0 THEN 'Deregistered 2020' WHEN 1 THEN 'Removed' WHEN 2 THEN 'Registered' END AS status, CASE c_custkey % 3 WHEN 0 THEN 'PRP' WHEN 1 THEN 'LA' END AS provider_type FROM {customer}"
_MATCHED = "coalesce((SELECT min(id) FROM c WHERE c.registration = g.registration AND g.registration <> ''), (SELECT min(id) FROM c WHERE c.norm_name = g.norm_name)) AS company"


def _companies(spark, d):
    return made(spark, d, COMPANIES, "supplier")


@query(
    "rsh_providers",
    f"WITH c AS ({COMPANIES.format(supplier='supplier')}), g AS (SELECT *, lower(trim(name)) AS norm_name, CASE WHEN coalesce(provider_type, 'PRP') = 'PRP' THEN 'RP' ELSE 'LRP' END AS nk FROM ({PROVIDERS.format(customer='customer')}) x WHERE trim(name) NOT IN ('12345', '') AND (status IS NULL OR status = 'Registered')), m AS (SELECT g.*, {_MATCHED} FROM g), "
    "k AS (SELECT company, nk, address AS na, registration AS nr FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY row) AS rn FROM m WHERE company IS NOT NULL) y WHERE rn = 1), "
    "w AS (SELECT c.*, CASE WHEN nk IS NOT NULL AND (kind IS NULL OR kind NOT IN ('RP', 'LRP')) THEN nk ELSE kind END AS kind2, CASE WHEN coalesce(address, '') = '' AND na <> '' THEN na ELSE address END AS address2, CASE WHEN coalesce(registration, '') = '' AND nr <> '' THEN nr ELSE registration END AS registration2 FROM c LEFT JOIN k ON company = id) "
    "SELECT id, name, norm_name, kind2 AS kind, address2 AS address, registration2 AS registration, CASE WHEN kind IS DISTINCT FROM kind2 OR address IS DISTINCT FROM address2 OR registration IS DISTINCT FROM registration2 THEN 'updated' END AS change FROM w "
    "UNION ALL SELECT NULL, trim(name), norm_name, nk, nullif(address, ''), nullif(registration, ''), 'created' FROM (SELECT *, row_number() OVER (PARTITION BY norm_name ORDER BY row) AS rn FROM m WHERE company IS NULL) z WHERE rn = 1",
)
def rsh_providers(spark, d):
    """The list of providers merged into the companies: landlords, addresses, registrations, new ones."""
    providers = made(spark, d, PROVIDERS, "customer").withColumn("norm_name", F.lower(F.trim("name")))
    return ingests.merged_providers(_companies(spark, d), providers)


STOCK = "SELECT o_orderkey AS row, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('L', o_custkey % 95) END AS registration, concat('supplier#', lpad(CAST(o_orderkey % 130 AS STRING), 9, '0')) AS norm_name, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey % 60 END AS owned, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 70 END AS managed, CASE WHEN o_orderkey % 6 <> 0 THEN o_custkey % 20 END AS for_others FROM {orders}"


@query(
    "rsh_stock",
    f"WITH c AS ({COMPANIES.format(supplier='supplier')}), g AS ({STOCK.format(orders='orders')}), m AS (SELECT g.*, {_MATCHED} FROM g), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY row DESC) AS rn FROM m WHERE company IS NOT NULL) y WHERE rn = 1) "
    "SELECT id, CASE WHEN l.owned > 0 AND 5 * l.managed > 6 * l.owned AND (kind IS NULL OR kind IN ('RP', 'LRP')) THEN 'Operator' ELSE kind END AS kind, coalesce(l.owned, c.owned) AS owned, coalesce(l.managed, c.managed) AS managed, coalesce(l.for_others, c.for_others) AS for_others FROM c LEFT JOIN l ON company = id",
)
def rsh_stock(spark, d):
    """Homes owned and managed; who manages over a fifth more than it owns is an operator."""
    return ingests.with_stock(_companies(spark, d), made(spark, d, STOCK, "orders")).select("id", "kind", "owned", "managed", "for_others")


JUDGEMENTS = "SELECT o_orderkey AS row, CASE WHEN o_orderkey % 9 = 0 THEN 'A to Z list of landlords' WHEN o_orderkey % 10 = 0 THEN '99' ELSE concat('Provider ', o_custkey % 300) END AS provider, CASE WHEN o_orderkey % 9 <> 0 AND o_orderkey % 10 <> 0 THEN CAST(o_custkey % 300 AS BIGINT) ELSE 1 END AS company, CASE WHEN o_orderkey % 4 <> 0 THEN concat('G', o_orderkey % 4) END AS governance, CASE WHEN o_orderkey % 3 <> 0 THEN concat('V', o_orderkey % 6) END AS viability FROM {orders} WHERE o_orderkey % 2 = 1"
HOUSING = "SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey % 200 AS BIGINT) END AS operator, p_type AS kind, CASE WHEN p_partkey % 2 = 0 THEN 'G4' END AS rating, CASE WHEN p_partkey % 5 = 0 THEN CAST(50 AS DOUBLE) END AS health FROM {part}"


@query(
    "rsh_judgements",
    f"WITH s AS ({HOUSING.format(part='part')}), j AS (SELECT *, CASE viability WHEN 'V1' THEN 95.0 WHEN 'V2' THEN 75.0 WHEN 'V3' THEN 45.0 WHEN 'V4' THEN 20.0 END::DOUBLE AS h FROM ({JUDGEMENTS.format(orders='orders')}) x WHERE provider LIKE 'Provider%'), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY row DESC) AS rn FROM j) y WHERE rn = 1), "
    "m AS (SELECT l.*, (SELECT min(id) FROM s WHERE operator = company) AS scheme FROM l) SELECT id, name, operator, kind, coalesce(governance, rating) AS rating, coalesce(h, health) AS health, CASE WHEN m.scheme IS NOT NULL THEN 'enriched' END AS change FROM s LEFT JOIN m ON m.scheme = s.id "
    "UNION ALL SELECT NULL, concat(provider, ' - Social Housing'), company, 'Social Housing', governance, h, 'created' FROM m WHERE scheme IS NULL",
)
def rsh_judgements(spark, d):
    health = regulatory_grades(F.lit(None).cast("string"), F.col("viability"), F.lit(None).cast("string"))["health"]
    return ingests.judged_schemes(made(spark, d, HOUSING, "part"), made(spark, d, JUDGEMENTS, "orders"), health)


SITES = "SELECT o_orderkey AS row, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE concat('BF', o_custkey % 400) END AS reference, CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE concat('org', o_custkey % 30) END AS organisation, CASE WHEN o_orderkey % 2 = 0 THEN concat('Yard ', o_orderkey) ELSE '' END AS address, CASE WHEN o_orderkey % 3 = 0 THEN concat('LS', o_orderkey % 40) ELSE '' END AS postcode, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 90 AS DOUBLE) END AS latitude, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 70 AS DOUBLE) END AS longitude, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 55 END AS units, o_orderpriority AS status FROM {orders}"
KNOWN_SITES = "SELECT concat('BF', p_partkey % 300) AS reference, CAST(min(p_partkey % 25) AS INTEGER) AS council, min(p_name) AS address, CASE WHEN p_partkey % 300 % 2 = 0 THEN 'LS1' ELSE '' END AS postcode, CAST(NULL AS DOUBLE) AS latitude, CAST(min(p_size) AS DOUBLE) AS longitude, CASE WHEN p_partkey % 300 % 3 = 0 THEN CAST(9 AS BIGINT) END AS units, 'old' AS status FROM {part} GROUP BY p_partkey % 300"
ORGANISATIONS = "SELECT n_nationkey AS id, concat('org', n_nationkey % 20) AS organisation, concat(n_name, CASE WHEN n_nationkey % 2 = 0 THEN ' Borough Council' ELSE ' Council' END) AS name FROM {nation}"


@query(
    "brownfield_ingest",
    f"WITH o AS (SELECT organisation, min(id) AS council FROM ({ORGANISATIONS.format(nation='nation')}) x GROUP BY 1), g AS (SELECT s.*, council FROM ({SITES.format(orders='orders')}) s JOIN o USING (organisation) WHERE reference <> '' AND (address <> '' OR postcode <> '')), "
    "f AS (SELECT reference, council, arg_min(address, row) AS address, arg_min(status, row) AS status, coalesce(arg_min(postcode, row) FILTER (WHERE postcode <> ''), '') AS postcode, arg_min(latitude, row) FILTER (WHERE latitude IS NOT NULL) AS latitude, arg_min(longitude, row) FILTER (WHERE longitude IS NOT NULL) AS longitude, arg_min(units, row) FILTER (WHERE units IS NOT NULL) AS units FROM g GROUP BY 1, 2), "
    f"k AS ({KNOWN_SITES.format(part='part')}) SELECT coalesce(k.reference, f.reference) AS reference, coalesce(k.council, f.council) AS council, CASE WHEN k.reference IS NULL THEN f.address ELSE k.address END AS address, CASE WHEN k.reference IS NULL THEN f.postcode ELSE coalesce(nullif(k.postcode, ''), f.postcode) END AS postcode, "
    "coalesce(k.latitude, f.latitude) AS latitude, coalesce(k.longitude, f.longitude) AS longitude, coalesce(k.units, f.units) AS units, CASE WHEN k.reference IS NULL THEN f.status ELSE k.status END AS status FROM k FULL JOIN f ON k.reference = f.reference AND k.council = f.council",
)
def brownfield_ingest(spark, d):
    return ingests.merged_sites(made(spark, d, KNOWN_SITES, "part"), made(spark, d, SITES, "orders"), made(spark, d, ORGANISATIONS, "nation"))


FIGURES = "SELECT c_custkey AS row, CASE c_custkey % 4 WHEN 0 THEN concat('nation_', c_custkey % 30, ' borough') WHEN 1 THEN concat('Nation_', c_custkey % 30, ' UA') WHEN 2 THEN concat(' NATION_', c_custkey % 30) ELSE '' END AS area, c_custkey % 1000 AS stock, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS waiting FROM {customer}"


@query(
    "lahs_ingest",
    f"WITH n AS (SELECT id, lower(name) AS name FROM ({ORGANISATIONS.format(nation='nation')}) x), f AS (SELECT *, lower(trim(area)) AS a FROM ({FIGURES.format(customer='customer')}) y WHERE trim(area) <> ''), m AS (SELECT f.*, coalesce((SELECT min(id) FROM n WHERE contains(n.name, left(a, 30))), (SELECT min(id) FROM n WHERE contains(n.name, string_split(a, ' ')[1]))) AS id FROM f) "
    "SELECT id, area, stock, waiting FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row DESC) AS rn FROM m WHERE id IS NOT NULL) z WHERE rn = 1",
)
def lahs_ingest(spark, d):
    """Figures of areas at the council whose name holds the area's, or its first word."""
    return ingests.council_figures(made(spark, d, ORGANISATIONS, "nation"), made(spark, d, FIGURES, "customer"))


TITLED = "SELECT o_orderkey AS id, concat('Customer ', o_custkey, ' Homes Ltd') AS ours, concat(CASE WHEN o_orderkey % 3 = 0 THEN 'The ' ELSE '' END, 'Customer ', o_custkey + o_orderkey % 4, CASE WHEN o_orderkey % 2 = 0 THEN ' HOMES LIMITED' ELSE ' Home plc' END) AS title FROM {orders}"


@query("sequence_match")
def sequence_match(spark, d):
    """Search hits whose title is a company's name, or nearly: equal keys, or a likeness of 0.92 by matching blocks."""
    hits = made(spark, d, TITLED, "orders").withColumns({"a": title_key(F.col("ours")), "b": title_key(F.col("title"))}).where("a <> '' AND b <> ''")
    equal = hits.where("a = b").withColumn("ratio", F.lit(1.0))
    near = hits.where("a <> b").withColumn("ratio", sequence_ratio("a", "b")).where(F.col("ratio") >= LEAST_SEQUENCE)
    return equal.unionByName(near).select("id", "ours", "title", F.round("ratio", 6).alias("ratio"))


TENDERS = f"SELECT i.*, CASE WHEN row % 3 = 0 THEN concat('Yard ', row) ELSE '' END AS address, CASE row % 5 WHEN 0 THEN 'Managed Scheme' WHEN 1 THEN 'BTR' WHEN 2 THEN 'Senior' ELSE 'Care' END AS kind, CASE WHEN row % 4 <> 0 THEN row % 60 END AS owner, CASE WHEN row % 9 = 0 THEN row % 8 END AS manager, CASE WHEN row % 6 <> 0 THEN date_add(DATE '2020-01-01', CAST(row % 500 AS INTEGER)) END AS starts, CASE WHEN row % 8 <> 0 THEN date_add(DATE '2020-06-01', CAST(row % 900 AS INTEGER)) END AS ends, CASE row % 10 WHEN 0 THEN CAST(-1 AS DOUBLE) WHEN 1 THEN CAST(10000000000 AS DOUBLE) WHEN 2 THEN NULL ELSE CAST(row * 10 AS DOUBLE) END AS value FROM ({INCOMING}) i"
KNOWN_SCHEMES = f"SELECT r.*, CASE WHEN id % 4 = 0 THEN name WHEN id % 4 = 1 THEN 'Old Yard' END AS address, CASE id % 5 WHEN 0 THEN 'PBSA' WHEN 1 THEN 'Managed Scheme' END AS kind, CASE WHEN id % 3 = 0 THEN id % 40 END AS owner, CASE WHEN id % 7 = 0 THEN id % 9 END AS manager, CASE WHEN id % 2 = 0 THEN DATE '2019-01-01' END AS starts, CASE WHEN id % 3 <> 0 THEN DATE '2021-06-01' END AS ends FROM ({RECORDS}) r"
HELD = "SELECT p_partkey AS scheme, concat('R', p_partkey * 3) AS reference, DATE '2018-01-01' AS starts, DATE '2019-01-01' AS ends, CAST(5 AS DOUBLE) AS value, true AS is_current FROM {part} WHERE p_partkey % 2 = 0"
_DATES = lambda sql: sql.replace("date_add(DATE '2020-01-01', CAST(row % 500 AS INTEGER))", "DATE '2020-01-01' + CAST(row % 500 AS INTEGER)").replace("date_add(DATE '2020-06-01', CAST(row % 900 AS INTEGER))", "DATE '2020-06-01' + CAST(row % 900 AS INTEGER)")
_MERGED = (
    f"i AS (SELECT * FROM ({_DATES(TENDERS).format(customer='customer')}) x WHERE (value IS NULL OR (value > 0 AND value < 1e10)) AND (starts IS NULL OR ends IS NULL OR ends >= starts)), k AS ({KNOWN_SCHEMES.format(part='part')}), h AS ({HELD.format(part='part')}), "
    f"n AS (SELECT id, {_SORTED.format('name')} AS b FROM (SELECT * FROM k ORDER BY id DESC LIMIT 300) x), t AS (SELECT DISTINCT {_SORTED.format('title')} AS a FROM i), s AS (SELECT a, id, {_SCORE} AS score FROM t CROSS JOIN n), best AS (SELECT a, id FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id DESC) AS rn FROM s WHERE score >= 80) y WHERE rn = 1), "
    f"m AS (SELECT i.*, coalesce((SELECT min(id) FROM k WHERE k.reference = i.reference AND i.reference <> ''), best.id, (SELECT min(id) FROM k WHERE k.postcode = i.postcode AND k.operator = i.operator)) AS match FROM i LEFT JOIN best ON best.a = {_SORTED.format('title')}), "
    "p AS (SELECT m.*, coalesce(match::VARCHAR, concat('new:', min(CASE WHEN match IS NULL THEN row END) OVER (PARTITION BY title))) AS scheme FROM m), "
    "f AS (SELECT scheme, min(row) AS r0, arg_min(title, row) AS title, arg_min(kind, row) AS kind1, arg_min(kind, row) FILTER (WHERE kind <> 'Managed Scheme') AS kind2, max(ends) AS ends, arg_min(operator, row) FILTER (WHERE operator <> '') AS operator, arg_min(owner, row) FILTER (WHERE owner IS NOT NULL) AS owner, arg_min(manager, row) FILTER (WHERE manager IS NOT NULL) AS manager, arg_min(postcode, row) FILTER (WHERE postcode <> '') AS postcode, "
    "arg_min(starts, row) FILTER (WHERE starts IS NOT NULL) AS starts, arg_min(reference, row) FILTER (WHERE reference <> '') AS reference, arg_min(address, row) FILTER (WHERE address <> '') AS address FROM p GROUP BY 1)"
)


def _merged(spark, d):
    return tenders.merge_tenders(made(spark, d, KNOWN_SCHEMES, "part"), made(spark, d, HELD, "part"), made(spark, d, TENDERS, "customer"), newest=300)


@query(
    "tender_schemes",
    f"WITH {_MERGED} SELECT coalesce(k.id::VARCHAR, f.scheme) AS id, coalesce(k.reference, f.reference) AS reference, CASE WHEN k.id IS NULL THEN f.title ELSE k.name END AS name, coalesce(k.postcode, f.postcode) AS postcode, coalesce(k.operator, f.operator) AS operator, CASE WHEN k.address IS NULL OR k.address = k.name THEN coalesce(f.address, k.address) ELSE k.address END AS address, "
    "CASE WHEN k.id IS NULL THEN coalesce(kind2, kind1) WHEN k.kind IS NULL OR k.kind = 'Managed Scheme' THEN coalesce(kind2, k.kind) ELSE k.kind END AS kind, coalesce(k.owner, f.owner) AS owner, coalesce(k.manager, f.manager) AS manager, coalesce(k.starts, f.starts)::DATE AS starts, greatest(k.ends, f.ends)::DATE AS ends, CASE WHEN k.id IS NULL THEN 'created' WHEN f.scheme IS NOT NULL THEN 'updated' END AS change FROM k FULL JOIN f ON f.scheme = k.id::VARCHAR",
)
def tender_schemes(spark, d):
    """A batch of tenders merged into the schemes: valid ones only, found by reference, name or place, fields filled, ends moved on."""
    return _merged(spark, d)[0]


@query(
    "tender_contracts",
    f"WITH {_MERGED}, g AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.scheme::VARCHAR = p.scheme AND h.reference = p.reference)), q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scheme, reference ORDER BY row) AS rn FROM g WHERE reference <> '') y WHERE rn = 1 UNION ALL SELECT *, 1 FROM g WHERE reference IS NULL OR reference = ''), l AS (SELECT scheme, max(row) AS last FROM q GROUP BY 1) "
    "SELECT h.scheme::VARCHAR AS scheme, reference, starts::DATE AS starts, ends::DATE AS ends, value, is_current AND last IS NULL AS is_current FROM h LEFT JOIN l ON l.scheme = h.scheme::VARCHAR UNION ALL SELECT q.scheme, reference, starts::DATE, ends::DATE, value, row = last FROM q JOIN l USING (scheme)",
)
def tender_contracts(spark, d):
    return _merged(spark, d)[1]
