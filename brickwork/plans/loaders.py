"""Loads and merges: authorities, states, applicants, names on pages, contacts, title and rent files, councils (F08, F11, F32, F35, F40, D11, S05, E04, E09), on rows made from the tables by SQL that both sides share."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickwork.functions import names as n
from brickwork.functions import prose
from brickwork.operators import contacts as c
from brickwork.operators import loaders as l
from brickwork.plans.gaps import _code, _pick
from brickwork.plans.risk import _q, made
from brickwork.registry import query, table

_BEFORE = ["", "London Borough of ", "Royal Borough of ", "City Of ", "Borough of ", "Metropolitan Borough of ", "District of ", "County of ", "Council of the ", "THE ", "The City of "]
_AFTER = ["", " Borough Council", " District Council", " City Council", " County Council", " Metropolitan District Council", " Metropolitan Borough Council", " COUNCIL", " DC", " BC", " cc", " MBC", " mdc", " Council Offices"]
AUTHORITIES = f"SELECT p_partkey AS id, CASE WHEN p_partkey % 50 <> 0 THEN concat(' ', {_pick(_BEFORE, 'p_partkey')}, p_name, ' ', p_size, {_pick(_AFTER, 'p_partkey // 11')}, ' ') END AS name FROM {{part}}"


@query(
    "norm_authority",
    f"SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 0 THEN '' ELSE concat(CASE WHEN p_partkey % 11 = 10 THEN 'city of ' ELSE '' END, lower(p_name), ' ', p_size, CASE (p_partkey // 11) % 14 WHEN 13 THEN ' council offices' WHEN 5 THEN ' metropolitan' WHEN 6 THEN ' metropolitan' ELSE '' END) END AS name FROM part",
)
def norm_authority(spark, d):
    """One prefix and one suffix go, each the first that fits; so of a metropolitan borough council only its last two words."""
    return made(spark, d, AUTHORITIES.replace("//", "DIV"), "part").select("id", n.authority_name(F.col("name")).alias("name"))


STATES = "SELECT o_orderkey AS id, CASE o_orderkey % 14 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate([*n.PORTAL_STATES, "granted with conditions", "Under Consideration", "mystery"])) + " END AS raw FROM {orders}"


@query("portal_states", "SELECT id, CASE raw " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in n.PORTAL_STATES.items()) + f" WHEN 'granted with conditions' THEN 'Approved' WHEN 'Under Consideration' THEN 'Pending' ELSE 'Unknown' END AS state FROM ({STATES.format(orders='orders')}) x")
def portal_states(spark, d):
    return made(spark, d, STATES, "orders").select("id", n.portal_state(F.col("raw")).alias("state"))


APPLIED = f"""SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN concat('Firm ', o_custkey) WHEN 1 THEN concat('2024/', o_custkey, '/PA') WHEN 2 THEN concat('PA/', o_custkey) WHEN 3 THEN '' END AS name,
  CASE o_orderkey % 5 WHEN 0 THEN concat('Flats. The applicant: Moda ', {_pick(['Living', 'Homes', 'and Sons'], 'o_custkey')}, ', Leeds') WHEN 1 THEN concat('Works on behalf of Urban ', {_pick(['Land', 'Parks'], 'o_custkey')}, ' for ', o_custkey, ' homes') WHEN 2 THEN 'developer: Abc.' WHEN 3 THEN concat('submitted by nobody in ', o_orderpriority) END AS description FROM {{orders}}"""


@query(
    "applicant",
    f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN concat('Firm ', o_custkey) WHEN o_orderkey % 5 = 0 THEN concat('Moda ', {_pick(['Living', 'Homes', 'and Sons'], 'o_custkey')}) WHEN o_orderkey % 5 = 1 THEN concat('Urban ', {_pick(['Land', 'Parks'], 'o_custkey')}) END AS applicant FROM orders",
)
def applicant(spark, d):
    """The stated name unless it looks like a reference, else the one in the description."""
    return made(spark, d, APPLIED, "orders").select("id", n.applicant_of(F.col("name"), F.col("description")).alias("applicant"))


NAMED = "replace(replace(html, '<h1>', concat('<h1 class=big>Block ', page_id, ' <i>&amp;</i> Court - Yugo | ')), '<title>', concat('<meta name=\"description\" content=\"Rooms at &quot;', page_id, '&quot;\"><TITLE lang=x> Block ', page_id, ' &amp; Court | Student Accommodation in Leeds <!-- '))"


@query("page_names", "SELECT page_id, concat('Block ', page_id, ' & Court') AS title, concat('Rooms at \"', page_id, '\"') AS description, length(regexp_extract(html, '<h1>(.*?)</h1>', 1)) > 0 AS headed FROM pages")
def page_names(spark, d):
    """The name in a page's title without the site's own, its description, and whether it has a heading."""
    page = table(spark, d, "pages").selectExpr("page_id", f"{NAMED} AS html")
    title = F.regexp_replace(prose.page_title(F.col("html")), " <!--.*", "")
    return page.select("page_id", prose.site_free(title).alias("title"), prose.page_meta(F.col("html"), "description").alias("description"), (prose.page_heading(F.col("html")) != "").alias("headed"))


FOUND = """SELECT event_id AS row, user_id % 20 AS company, CASE WHEN event_id % 7 <> 0 THEN concat('Person ', user_id % 60) ELSE '' END AS name, CASE event_id % 3 WHEN 0 THEN concat('P', user_id % 60, '@X.org ') WHEN 1 THEN '' END AS email, CASE WHEN event_id % 4 = 0 THEN concat('0', event_id % 97) ELSE '' END AS phone,
  CASE WHEN event_id % 5 = 0 THEN concat('l/', event_id % 89) END AS link, CASE WHEN event_id % 2 = 0 THEN event_type END AS title, CASE WHEN event_id % 11 <> 0 THEN CAST(event_id % 10 AS DOUBLE) / 10 END AS confidence, concat('s', event_id % 3) AS source FROM {events}"""
_KEY = "lower(trim(coalesce(nullif(email, ''), name)))"
_FIRST = ", ".join(f"coalesce(arg_min({f}, row) FILTER (WHERE {f} <> ''), arg_min_null({f}, row)) AS {f}" for f in c.FIELDS)


@query("contact_keys", f"SELECT row, {_KEY} AS contact_key FROM ({FOUND.format(events='events')}) x")
def contact_keys(spark, d):
    return made(spark, d, FOUND, "events").select("row", prose.contact_key(F.col("email"), F.col("name")).alias("contact_key"))


@query(
    "contact_best",
    f"WITH f AS (SELECT *, {_KEY} AS contact_key FROM ({FOUND.format(events='events')}) x), b AS (SELECT company, contact_key, arg_max(row, {{'c': coalesce(confidence, -1), 'b': -row}}) AS best FROM f GROUP BY 1, 2) SELECT f.company, contact_key, {_FIRST}, arg_min(name, row) AS name, arg_min_null(confidence, row) AS confidence, arg_min(source, row) AS source, min(row) AS row FROM f JOIN b USING (company, contact_key) WHERE row >= best GROUP BY f.company, contact_key",
)
def contact_best(spark, d):
    """One contact a company and key: the most confident, its gaps filled by those after it."""
    found = made(spark, d, FOUND, "events").withColumn("contact_key", prose.contact_key(F.col("email"), F.col("name")))
    return c.one_of_each(found, ["company", "contact_key"])


KNOWN_CONTACTS = "SELECT c_custkey AS id, c_custkey % 20 AS company, concat('Person ', c_custkey % 70) AS name, CASE WHEN c_custkey % 2 = 0 THEN concat('P', c_custkey % 60, '@X.org ') ELSE '' END AS email, 'old' AS phone, CAST(NULL AS STRING) AS link, c_mktsegment AS title, 'known' AS source, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 9 AS DOUBLE) / 10 END AS confidence FROM {customer} WHERE c_custkey < 400"


@query(
    "contact_merge",
    f"WITH f AS (SELECT *, coalesce(confidence, 0.5) AS conf FROM ({FOUND.format(events='events')}) x), k AS ({KNOWN_CONTACTS.format(customer='customer')}), m AS (SELECT f.*, coalesce((SELECT min(id) FROM k WHERE k.company = f.company AND k.email = f.email AND f.email <> ''), (SELECT min(id) FROM k WHERE k.company = f.company AND k.name = f.name AND f.name <> '')) AS id FROM f), "
    "w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY conf DESC, row DESC) AS rn FROM m WHERE id IS NOT NULL) y WHERE rn = 1), v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company, name ORDER BY conf DESC, row DESC) AS rn FROM m WHERE id IS NULL) y WHERE rn = 1) "
    + "SELECT k.id, k.company, k.name, " + ", ".join(f"CASE WHEN w.conf >= coalesce(k.confidence, 0) AND w.{f} <> '' THEN w.{f} ELSE k.{f} END AS {f}" for f in [*c.FIELDS, "source"]) + ", CASE WHEN w.conf >= coalesce(k.confidence, 0) THEN w.conf ELSE k.confidence END AS confidence FROM k LEFT JOIN w USING (id) UNION ALL SELECT NULL, company, name, email, phone, link, title, source, conf FROM v",
)
def contact_merge(spark, d):
    """Found contacts merged into the known ones of their company, by address, then name."""
    found = made(spark, d, FOUND, "events").withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))
    return c.merged_contacts(made(spark, d, KNOWN_CONTACTS, "customer"), found).select("id", "company", "name", *c.FIELDS, "source", "confidence")


TITLE_FILE = f"""SELECT concat(CASE WHEN p_partkey % 40 = 0 THEN 'Row Count: ' WHEN p_partkey % 41 = 0 THEN ' ' ELSE ' T' END, CASE WHEN p_partkey % 41 <> 0 THEN CAST(p_partkey AS STRING) ELSE '' END) AS `Title Number`, CASE WHEN p_partkey % 2 = 0 THEN 'Freehold' ELSE '' END AS `Tenure`, CASE WHEN p_partkey % 3 <> 0 THEN lower({_code('p_partkey', 'p_size')}) END AS `Postcode`,
  CASE p_partkey % 5 WHEN 0 THEN CAST(p_partkey * 100 AS STRING) WHEN 1 THEN '1,000' WHEN 2 THEN ' 77 ' END AS `Price Paid`, CASE p_partkey % 4 WHEN 0 THEN '03-11-2020' WHEN 1 THEN '2021-02-01' WHEN 2 THEN '5/6/2020' END AS `Date Proprietor Added` FROM {{part}}"""


@query(
    "title_load",
    f"SELECT CASE WHEN p_partkey % 2 = 0 THEN 'ccod' ELSE 'ocod' END AS source, concat('T', p_partkey) AS title_number, CASE WHEN p_partkey % 2 = 0 THEN 'Freehold' END AS tenure, CASE WHEN p_partkey % 3 <> 0 THEN lower({_code('p_partkey', 'p_size')}) END AS postcode, CASE WHEN p_partkey % 3 <> 0 THEN replace({_code('p_partkey', 'p_size')}, ' ', '') END AS pc_key, "
    "CASE p_partkey % 5 WHEN 0 THEN (p_partkey * 100)::VARCHAR WHEN 2 THEN '77' END AS price_paid, CASE p_partkey % 4 WHEN 0 THEN '2020-11-03' WHEN 1 THEN '2021-02-01' WHEN 2 THEN '5/6/2020' END AS date_added FROM part WHERE p_partkey % 40 <> 0 AND p_partkey % 41 <> 0",
)
def title_load(spark, d):
    """A first load of both registers with older rows in one, then that one replaced."""
    p = made(spark, d, TITLE_FILE, "part")
    even = F.regexp_extract("Title Number", "([0-9]+)", 1).try_cast("int") % 2 == 0
    state = l.title_rows(p, "ccod").unionByName(l.title_rows(p.where(~even), "ocod"))  # the first load took odd titles for the home register's
    return l.replaced_by_source(state, l.title_rows(p.where(even), "ccod"), ["ccod"])


RENTS = f"SELECT o_orderkey AS row, CASE WHEN o_orderkey % 4 = 0 THEN concat('u', o_custkey) END AS url, CASE WHEN o_orderkey % 6 <> 5 THEN lower(concat('LS', o_custkey % 80, ' 1aa')) END AS postcode, CASE o_orderkey % 5 WHEN 0 THEN 'The Court' WHEN 1 THEN '' ELSE concat({_pick(['red', 'Blue', 'small Ring', 'old plate hall', 'cold'], 'o_custkey')}, ' House') END AS name, o_custkey % 300 AS ppw FROM {{orders}}"
LET = "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN concat('u', p_partkey % 900) END AS url, CASE WHEN p_partkey % 10 <> 0 THEN concat('LS', p_partkey * 7 % 130, ' 1AA') END AS postcode, p_name AS name FROM {part} WHERE p_partkey < 200"
_WORDS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z]{{3,}}')), lambda w: NOT list_contains([" + ", ".join(map(_q, l.COMMON_WORDS)) + "], w))"


@query(
    "rents_matched",
    f"WITH r AS (SELECT *, upper(replace(postcode, ' ', '')) AS k, {_WORDS.format('name')} AS w FROM ({RENTS.format(orders='orders')}) x), s AS (SELECT *, upper(replace(postcode, ' ', '')) AS k, {_WORDS.format('name')} AS w FROM ({LET.format(part='part')}) y), "
    "u AS (SELECT url, max(id) AS u FROM s WHERE url IS NOT NULL GROUP BY 1), b AS (SELECT row, id FROM (SELECT row, id, row_number() OVER (PARTITION BY row ORDER BY len(list_intersect(r.w, s.w)) DESC, id) AS rn FROM r JOIN s USING (k) WHERE len(list_intersect(r.w, s.w)) > 0) z WHERE rn = 1), o AS (SELECT k, min(id) AS single FROM s WHERE k IS NOT NULL GROUP BY 1 HAVING count(*) = 1) "
    "SELECT row, coalesce(u, b.id, CASE WHEN len(w) = 0 THEN single END) AS scheme, ppw FROM r LEFT JOIN u USING (url) LEFT JOIN b USING (row) LEFT JOIN o USING (k) WHERE coalesce(u, b.id, CASE WHEN len(w) = 0 THEN single END) IS NOT NULL",
)
def rents_matched(spark, d):
    """Rents at schemes: by address, by postcode and words in common, or by a postcode's only scheme."""
    return l.matched_rents(made(spark, d, RENTS, "orders"), made(spark, d, LET, "part")).select("row", "scheme", "ppw")


ORPHANS = "SELECT p_partkey AS id, CASE WHEN p_partkey % 12 <> 0 THEN concat(CASE WHEN p_partkey % 2 = 0 THEN 'LS' ELSE 'ls' END, p_partkey % 70, ' 1AA') END AS postcode, CASE WHEN p_partkey % 70 < 40 AND p_partkey % 3 = 0 THEN p_size % 5 END AS council FROM {part}"
DISTRICTS = "SELECT concat('LS', c_custkey, '1AA') AS postcode, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN concat(' nation_', c_custkey % 30, ' ') ELSE concat('Nowhere ', c_custkey) END AS district FROM {customer} WHERE c_custkey < 60"


@query(
    "council_backfill",
    f"WITH s AS (SELECT *, upper(split_part(postcode, ' ', 1)) AS o FROM ({ORPHANS.format(part='part')}) x), g AS (SELECT o, council, count(*) AS n FROM s WHERE council IS NOT NULL AND o IS NOT NULL GROUP BY 1, 2), c AS (SELECT o, council AS common FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY n DESC, council) AS rn FROM g) y WHERE rn = 1), "
    f"d AS (SELECT upper(postcode) AS pc, trim(district) AS district, (SELECT min(n_nationkey) FROM nation WHERE lower(n_name) = lower(trim(district))) AS named FROM ({DISTRICTS.format(customer='customer')}) z WHERE trim(district) <> '') "
    "SELECT id, postcode, coalesce(council, common, named)::INTEGER AS council, CASE WHEN coalesce(council, common, named) IS NULL THEN district END AS council_name FROM s LEFT JOIN c USING (o) LEFT JOIN d ON pc = upper(replace(postcode, ' ', ''))",
)
def council_backfill(spark, d):
    councils = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return l.councils_filled(made(spark, d, ORPHANS, "part"), made(spark, d, DISTRICTS, "customer"), councils)
