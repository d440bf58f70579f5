"""Whole enrichments and ingests: operators composed, each step filling nulls only. Rows are made from the tables by SQL that both sides share."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickwork.functions import names as n
from brickwork.functions import periods, prose
from brickwork.functions import schemes as rules
from brickwork.operators import attribution, changes
from brickwork.operators.joining import best_per_key
from brickwork.plans.schemes import pick_sql
from brickwork.registry import query, table
from brickwork.sources import files
from brickwork.sources.workspace import new_path


def _code(key: str, size: str) -> str:
    return f"concat('LS', {size} % 50 + 1, ' ', {key} % 10, chr(CAST(65 + ({key} * 13) % 20 AS INTEGER)), 'B')"


SCHEMES = f"""SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 4 = 0 THEN concat('Court ', p_size, ', Leeds ', {_code('p_partkey', 'p_size')}) WHEN p_partkey % 4 = 1 THEN '' END AS address,
  CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN '' ELSE {_code('p_partkey', 'p_size')} END AS postcode, CASE WHEN p_partkey % 10 = 1 THEN 'directory' ELSE 'epc' END AS source,
  CASE WHEN p_partkey % 6 = 1 THEN p_partkey % 4 END AS owner, CASE WHEN p_partkey % 5 = 1 THEN p_partkey % 30 END AS operator, CASE WHEN p_partkey % 3 = 0 THEN p_size % 4 END AS council FROM {{part}}"""
TITLES = f"SELECT s_suppkey AS number, {_code('s_suppkey', 's_suppkey')} AS postcode, CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey END AS company FROM {{supplier}}"
APPLICATIONS = f"SELECT o_orderkey AS id, {_code('o_custkey', 'o_orderkey')} AS postcode, CASE WHEN o_orderkey % 97 = 0 THEN o_custkey END AS company, CAST(o_orderdate AS DATE) AS submitted FROM {{orders}}"
COMPANIES = f"SELECT c_custkey AS id, {_code('c_custkey', 'c_custkey')} AS postcode FROM {{customer}} WHERE c_custkey % 11 = 0"
CONTRACTS = "SELECT l_orderkey AS id, l_partkey AS scheme, max(CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey END) AS client, max(CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey END) AS operator FROM {lineitem} WHERE l_quantity > 49 GROUP BY l_orderkey, l_partkey"


def _sources(spark, d):
    made = lambda sql, name: spark.sql(sql, **{name: table(spark, d, name)})
    return made(SCHEMES, "part"), made(TITLES, "supplier"), made(APPLICATIONS, "orders"), made(COMPANIES, "customer"), made(CONTRACTS, "lineitem")


def _attribution_sql(steps) -> str:
    """The steps one by one, as they follow each other."""
    shared = {"part": "part", "supplier": "supplier", "orders": "orders", "customer": "customer", "lineitem": "lineitem"}
    found = {
        "title": ("postcode", "SELECT postcode, arg_min(company, number) AS c FROM titles WHERE company IS NOT NULL GROUP BY 1"),
        "directory": ("postcode", "SELECT postcode, arg_min(owner, id) AS c FROM s WHERE source = 'directory' AND owner IS NOT NULL GROUP BY 1"),
        "application": ("postcode", "SELECT DISTINCT ON (postcode) postcode, company AS c FROM applications WHERE company IS NOT NULL ORDER BY postcode, submitted DESC, id DESC"),
        "address": ("postcode", "SELECT postcode, min(id) AS c FROM companies GROUP BY 1"),
        "contract": ("id", "SELECT scheme AS id, arg_min(client, id) AS c FROM contracts WHERE client IS NOT NULL GROUP BY 1"),
        "outward": ("outward", "SELECT DISTINCT ON (outward) outward, owner AS c FROM (SELECT outward, owner, count(*) AS k FROM {before} WHERE owner IS NOT NULL AND outward IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3) g ORDER BY outward, k DESC, owner"),
    }
    post = f"upper(replace(regexp_extract(concat_ws(' ', address, name), '{n.POSTCODE}', 1), ' ', ''))"
    ctes = [f"{name} AS ({sql.format(**shared)})" for name, sql in (("schemes", SCHEMES), ("titles", TITLES), ("applications", APPLICATIONS), ("companies", COMPANIES), ("contracts", CONTRACTS))]
    ctes.append(f"s AS (SELECT *, split_part(postcode, ' ', 1) AS outward, NULL::VARCHAR AS owner_step FROM (SELECT * REPLACE (coalesce(nullif(postcode, ''), CASE WHEN address <> '' AND {post} <> '' THEN concat(left({post}, length({post}) - 3), ' ', right({post}, 3)) END) AS postcode) FROM schemes) x)")
    before = "s"
    for k, step in enumerate(steps):
        key, sql = found[step]
        ctes.append(f"o{k} AS (SELECT b.* REPLACE (coalesce(b.owner, f.c) AS owner, CASE WHEN b.owner IS NULL AND f.c IS NOT NULL THEN '{step}' ELSE b.owner_step END AS owner_step) FROM {before} b LEFT JOIN ({sql.replace('{before}', before)}) f ON f.{key} = b.{key})")
        before = f"o{k}"
    return (
        f"WITH {', '.join(ctes)} SELECT b.id, b.name, b.address, b.postcode, b.source, b.owner, coalesce(b.operator, a.c, k.c) AS operator, coalesce(b.council, p.c) AS council, owner_step, "
        f"CASE WHEN b.operator IS NOT NULL THEN NULL WHEN a.c IS NOT NULL THEN 'directory' WHEN k.c IS NOT NULL THEN 'contract' END AS operator_step, CASE WHEN b.council IS NULL AND p.c IS NOT NULL THEN 'outward' END AS council_step FROM {before} b "
        "LEFT JOIN (SELECT postcode, arg_min(operator, id) AS c FROM s WHERE source = 'directory' AND operator IS NOT NULL GROUP BY 1) a ON a.postcode = b.postcode "
        "LEFT JOIN (SELECT scheme, arg_min(operator, id) AS c FROM contracts WHERE operator IS NOT NULL GROUP BY 1) k ON k.scheme = b.id "
        "LEFT JOIN (SELECT DISTINCT ON (outward) outward, council AS c FROM (SELECT outward, council, count(*) AS k FROM s WHERE council IS NOT NULL AND outward IS NOT NULL GROUP BY 1, 2) g ORDER BY outward, k DESC, council) p ON p.outward = b.outward"
    )


@query("enrich_full", _attribution_sql(attribution.FULL))
def enrich_full(spark, d):
    """Every scheme with owner, operator and council from all sources, and the step that filled each."""
    return attribution.attribute(*_sources(spark, d))


@query("enrich_new", _attribution_sql(attribution.SHORT))
def enrich_new(spark, d):
    """The same without titles and registered addresses."""
    return attribution.attribute(*_sources(spark, d), steps=attribution.SHORT)


#: Notices, with operator and type; {a} is the day they start, {b} 400 days later.
NOTICES = [
    ("Housing repairs awarded to Northmoor Homes Ltd from {a} to {b}.", "Northmoor Homes Ltd", "Housing Maintenance"),
    ("Student accommodation managed by Redbrick Living Limited, commencing {a} for 24 months", "Redbrick Living Limited", "PBSA"),
    ("Office cleaning from {a} to {b}", None, None),
    ("Sheltered homes. Start date: {a}; end date: {b}.", None, "Senior"),
    ("Tenancy management", None, "Housing Management"),
    ("Temporary accommodation; the provider is Harbour Trust. Signed {a}, ends {b}", "Harbour Trust", "Supported Housing"),
]
_ENDS = "CASE o_orderkey % 6 WHEN 0 THEN a + 400 WHEN 1 THEN CAST(a + to_months(24) AS DATE) WHEN 3 THEN a + 400 WHEN 5 THEN a + 400 END"
_KNOWN_TENDERS = "SELECT o_custkey FROM orders GROUP BY 1 HAVING o_custkey % 5 = 0"


@query(
    "tender_ingest",
    f"SELECT o_custkey AS notice, {pick_sql([o for _, o, _ in NOTICES], 'o_orderkey')} AS operator, {pick_sql([k for _, _, k in NOTICES], 'o_orderkey')} AS kind, CASE WHEN o_orderkey % 6 <> 4 THEN a END AS starts, CASE WHEN o_orderkey % 6 <> 4 THEN {_ENDS} END AS ends FROM "
    "(SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS a FROM orders WHERE o_orderkey % 6 <> 2 ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC) x "
    f"WHERE o_custkey NOT IN ({_KNOWN_TENDERS})",
)
def tender_ingest(spark, d):
    """New housing notices as contracts: the latest of each notice, with days, operator and type from its text; known notices stay as they are."""
    day = F.to_date("o_orderdate")
    text = F.element_at(F.array(*[F.lit(t) for t, _, _ in NOTICES]), (F.col("o_orderkey") % len(NOTICES) + 1).cast("int"))
    text = F.replace(F.replace(text, F.lit("{a}"), F.date_format(day, "yyyy-MM-dd")), F.lit("{b}"), F.date_format(F.date_add(day, 400), "yyyy-MM-dd"))
    orders = table(spark, d, "orders")
    notices = orders.select(F.col("o_custkey").alias("notice"), "o_orderkey", "o_orderdate", text.alias("text"))
    none = F.array().cast("array<string>")
    housing = notices.where(rules.about_housing(none, F.col("text")))
    latest = best_per_key(housing, ["notice"], F.desc("o_orderdate"), F.desc("o_orderkey"))
    known = orders.where("o_custkey % 5 = 0").select(F.col("o_custkey").alias("notice")).distinct()
    new = latest.join(known, "notice", "left_anti")
    return new.select("notice", prose.named_operator(F.col("text")).alias("operator"), rules.contract_type(none, F.col("text")).alias("kind"), periods.contract_period(F.col("text")).alias("p")).select("notice", "operator", "kind", "p.*")


@query(
    "ccod_ingest",
    f"WITH titles AS ({TITLES.format(supplier='supplier')}), schemes AS ({SCHEMES.format(part='part')}), t AS (SELECT postcode, arg_min(company, number) AS company, min(number) AS number FROM titles WHERE company IS NOT NULL AND number % 5 <> 0 GROUP BY 1) "
    "SELECT id, coalesce(company, owner) AS owner, CASE WHEN company IS NOT NULL THEN 'hmlr_ccod' WHEN owner IS NOT NULL THEN source END AS owner_source, number AS title FROM schemes LEFT JOIN t USING (postcode)",
)
def ccod_ingest(spark, d):
    """Owners by title: home proprietors only, the least title number of a postcode; a title ranks above what a scheme's own source says."""
    schemes, titles = _sources(spark, d)[:2]
    home = titles.where("company IS NOT NULL AND number % 5 <> 0").groupBy("postcode").agg(F.min_by("company", "number").alias("company"), F.min("number").alias("title"))
    found = schemes.join(home, "postcode", "left")
    field = F.lit("owner").alias("field")
    write = lambda value, source: found.select("id", field, F.col(value).alias("value"), source.alias("source"), F.lit(0).alias("at"))
    stands = changes.by_precedence(write("owner", F.col("source")).unionByName(write("company", F.lit("hmlr_ccod"))), "id", "field", "source", {"hmlr_ccod": 80, "directory": 60, "epc": 50}, "at")
    return found.select("id", "title").join(stands.select("id", F.col("value").alias("owner"), F.col("source").alias("owner_source")), "id", "left").select("id", "owner", "owner_source", "title")


@query(
    "upsert_scheme",
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_partkey % 9 = 0 THEN p_size + 1 ELSE p_size END AS p_size, CASE WHEN p_partkey % 2 = 1 AND p_partkey % 3 = 0 THEN 'new' WHEN p_partkey % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0",
)
def upsert_scheme(spark, d):
    """A keyed upsert that tells new, changed and unchanged rows; nulls of the delta say nothing."""
    key, p = F.col("p_partkey"), table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    size = F.when(key % 9 == 0, F.col("p_size") + 1).when(key % 2 == 1, F.col("p_size"))
    delta = p.where(key % 3 == 0).select("p_partkey", F.upper("p_name").alias("p_name"), size.alias("p_size"))
    return changes.upsert_marked(p.where(key % 2 == 0), delta, ["p_partkey"], changes.non_null)


@query("json_lines_scan", "SELECT n_nationkey, n_name, [n_regionkey, n_nationkey % 3] AS codes FROM nation")
def json_lines_scan(spark, d):
    """A file of JSON lines, written and read with its schema stated."""
    path = new_path(spark, "json-lines")
    rows = table(spark, d, "nation").select("n_nationkey", "n_name", F.array("n_regionkey", F.col("n_nationkey") % 3).alias("codes"))
    rows.write.json(path)
    return spark.read.schema(rows.schema).json(path)


@query("json_document_scan", "SELECT r_name AS company, k AS place, n_name AS owner FROM (SELECT r_name, n_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name) - 1 AS k FROM region JOIN nation ON n_regionkey = r_regionkey) x")
def json_document_scan(spark, d):
    """Documents with chains of owners, one row an owner with its place in the chain."""
    path = new_path(spark, "json-documents")
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    chains = nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("name")))).alias("chain"))
    docs = region.join(chains, "r_regionkey").select("r_regionkey", F.struct(F.col("r_name").alias("company"), "chain").alias("result"))
    docs.write.partitionBy("r_regionkey").json(path)  # one document a file
    return files.owner_chains(spark, path)
