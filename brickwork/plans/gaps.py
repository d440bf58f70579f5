"""The gap filler (E05): steps over schemes, companies, applications and contracts. Rows are made from the tables by SQL that both sides share, the SQL's answers by statements of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickwork.functions import gaps as g
from brickwork.functions import schemes as rules
from brickwork.operators.filling import Side, Step, fill_gaps
from brickwork.operators.joining import best_per_key, containing
from brickwork.plans.pipelines import _code
from brickwork.plans.schemes import has_sql
from brickwork.registry import query, table

WORDS = [w for words in rules.CONTRACT_KEYWORDS.values() for w in words]


def _pick(words, key: str) -> str:
    """The word in turn, in the SQL of both sides."""
    return f"split_part('{'|'.join(words)}', '|', CAST(({key}) % {len(words)} + 1 AS INTEGER))"


SCHEMES = f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN concat(p_name, ' of ', p_size, ' flats') ELSE p_name END AS name,
  CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN '' ELSE {_code('p_partkey', 'p_size')} END AS postcode, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS address,
  CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 25 END AS council, CASE WHEN p_partkey % 6 = 0 THEN 'cleaning' WHEN p_partkey % 6 = 1 THEN '' END AS contract_type,
  CASE WHEN p_partkey % 8 = 0 THEN p_size END AS units, CASE WHEN p_partkey % 9 = 0 THEN p_partkey * 100 END AS revenue, CASE WHEN p_partkey % 10 = 0 THEN CAST(50.5 AS DOUBLE) END AS rating,
  CASE WHEN p_partkey % 11 = 0 THEN CAST(1.5 AS DOUBLE) END AS latitude, CAST(NULL AS DOUBLE) AS longitude,
  p_size % 5 AS a, p_size % 3 AS c, p_partkey % 4 <> 0 AS certified, CAST(p_size % 4 AS DOUBLE) / 4 AS confidence, p_partkey % 5 <> 0 AS dated FROM {{part}}"""
CONTRACTS = f"""SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS scheme, CASE WHEN l_linenumber = 2 THEN concat(' ', lower({_code('l_suppkey', 'l_linenumber')}), ' ') WHEN l_linenumber = 3 THEN '' END AS postcode,
  CASE WHEN l_suppkey % 2 = 0 THEN concat('Dock ', l_suppkey, ' ') END AS address,
  CASE WHEN l_linenumber % 4 <> 0 THEN concat({_pick(WORDS, 'l_suppkey * 7 + l_linenumber')}, ' for the ', l_returnflag, ' estate at ', CASE WHEN l_suppkey % 3 = 0 THEN concat('Mill ', {_code('l_suppkey', 'l_linenumber')}, '.') ELSE 'many sites' END,
    CASE WHEN l_suppkey % 4 = 0 THEN concat(', ', CAST(l_quantity * 400 AS INTEGER), ' dwellings') WHEN l_suppkey % 4 = 1 THEN concat(', comprising ', CAST(l_quantity AS INTEGER), ' new homes') ELSE '' END) END AS description,
  CASE l_suppkey % 4 WHEN 0 THEN concat('Nation_', l_suppkey % 25, ' COUNCIL ') WHEN 1 THEN concat('nation_', l_suppkey % 25) WHEN 2 THEN concat('The NATION_', l_suppkey % 25, ' Housing Trust') END AS authority,
  CASE l_suppkey % 5 WHEN 0 THEN concat('SUPPLIER#', lpad(CAST(l_suppkey AS STRING), 9, '0'), ' Ltd') WHEN 1 THEN concat('Supplier#', lpad(CAST(l_suppkey AS STRING), 9, '0'), '-North Holdings') WHEN 2 THEN concat('0000', l_suppkey % 7) WHEN 3 THEN '' END AS supplier,
  CASE WHEN l_suppkey % 9 = 0 THEN l_suppkey END AS operator, CASE WHEN l_tax > 0.01 THEN CAST(round(l_extendedprice * 100) AS BIGINT) END AS pence, CASE WHEN l_linenumber <> 5 THEN CAST(l_shipdate AS DATE) END AS starts,
  CASE WHEN l_returnflag <> 'N' THEN CAST(l_shipdate AS DATE) + CAST(l_quantity * 30 AS INTEGER) END AS ends FROM {{lineitem}} WHERE l_orderkey % 5 = 0"""
COUNCILS = "SELECT n_nationkey AS id, concat(n_name, CASE n_nationkey % 3 WHEN 0 THEN ' Council' WHEN 1 THEN ' Borough Council' ELSE '' END) AS name FROM {nation}"
COMPANIES = """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN substr(lower(replace(s_name, '#', '')), 9) ELSE concat(lower(replace(s_name, '#', '')), CASE WHEN s_suppkey % 2 = 0 THEN ' homes' ELSE '' END) END AS name,
  CASE WHEN s_suppkey % 4 = 0 THEN CASE WHEN s_suppkey % 8 = 0 THEN 'Retail' ELSE '' END END AS sector, s_suppkey % 100 AS first_code, s_nationkey + 60 AS second_code FROM {supplier}"""
APPLICATIONS = f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'LS1 1AA' WHEN o_orderkey % 5 = 1 THEN '' END AS postcode, CASE WHEN o_orderkey % 3 = 0 THEN concat('Plot ', o_custkey, ', ', {_code('o_custkey', 'o_orderkey')}) WHEN o_orderkey % 3 = 1 THEN concat('Plot ', o_custkey) END AS address,
  CASE WHEN o_orderkey % 7 <> 0 THEN concat({_pick(g.BTR_WORDS + g.PBSA_WORDS + ['Rear extension', 'Shop front', 'Two flats'], 'o_orderkey')}, ' by ', o_orderpriority, CASE WHEN o_orderkey % 4 = 0 THEN concat(' near ', lower({_code('o_orderkey', 'o_custkey')})) ELSE '' END) END AS description,
  CASE WHEN o_orderkey % 11 = 0 THEN 'PRS scheme' END AS kind, CASE WHEN o_orderkey % 13 = 0 THEN true END AS is_btr, CASE WHEN o_orderkey % 13 = 0 THEN false END AS is_pbsa FROM {{orders}}"""
PLACES = f"SELECT {_code('c_custkey', 'c_custkey')} AS postcode, CAST(max(c_custkey) AS DOUBLE) / 100 AS north, CAST(min(c_custkey) AS DOUBLE) / 100 AS east FROM {{customer}} GROUP BY 1"


def _made(spark, d, sql: str, name: str):
    return spark.sql(sql, **{name: table(spark, d, name)})


def _link_councils(names, councils):
    """authority -> council: the same name, else the council of the least id whose name, of LEAST_NAME letters at least, is in it."""
    known = councils.select("id", F.explode(g.council_names(F.col("name"))).alias("known"))
    text = names.select("authority", F.trim(F.lower("authority")).alias("t")).distinct()
    exact = text.join(known.groupBy(F.col("known").alias("t")).agg(F.min("id").alias("exact")), "t", "left")
    part = containing(text, "t", known, "known", g.LEAST_NAME).join(known, "known").groupBy("t").agg(F.min("id").alias("part"))
    return exact.join(part, "t", "left").select(F.col("authority").alias("authority_key"), F.coalesce("exact", "part").alias("found_council"))


def filled_schemes(schemes, contracts, councils, places):
    """Schemes with the gaps filled from their contracts, their own names, the register of councils and the places of postcodes."""
    order = [F.col("id"), F.col("line")]
    first = lambda df, *columns: best_per_key(df, ["scheme"], *order).select(F.col("scheme").alias("key"), *columns)
    coded = first(contracts.where("postcode <> ''"), F.upper(F.trim("postcode")).alias("raw_postcode"), F.trim("address").alias("raw_address"))
    told = first(contracts.withColumn("told_postcode", g.text_postcode(F.col("description"))).where("told_postcode IS NOT NULL"), "told_postcode")
    council = contracts.join(F.broadcast(_link_councils(contracts.where("authority IS NOT NULL").select("authority").distinct(), councils)), F.col("authority") == F.col("authority_key"))  # one row an authority of a fixed register's size
    linked = first(council.where("found_council IS NOT NULL"), "found_council")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("id", "line", F.coalesce("description", F.lit("")).alias("d")))), lambda x: x["d"])
    prose = contracts.groupBy(F.col("scheme").alias("key")).agg(F.concat_ws(" ", texts).alias("contract_text"))
    money = contracts.where("pence > 0").groupBy(F.col("scheme").alias("key")).agg((F.sum("pence") / 100).alias("total"), F.min("starts").alias("first_day"), F.max("ends").alias("last_day"))
    sides = {"coded": Side(coded, "key", "id"), "told": Side(told, "key", "id"), "council": Side(linked, "key", "id"), "prose": Side(prose, "key", "id"), "money": Side(money, "key", "id"), "places": Side(places.withColumnRenamed("postcode", "key"), "key", F.upper(F.trim("postcode")), ("postcode",))}
    text = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("contract_text", F.lit("")))
    epc = F.when(F.col("certified"), F.create_map(F.lit("A"), F.col("a"), F.lit("C"), F.col("c")))
    day = F.when(F.col("dated"), F.lit("2026-01-01").cast("date"))
    rating = rules.performance_rating(epc, F.col("revenue"), day, day, F.col("units"), F.col("postcode"), F.col("confidence"))
    steps = [
        Step("rating", {"rating": rating}, reads=("revenue", "units", "postcode")),
        Step("contract postcode", {"postcode": F.col("raw_postcode"), "address": F.col("raw_address")}, uses=("coded",)),
        Step("described postcode", {"postcode": F.col("told_postcode")}, uses=("told",)),
        Step("authority", {"council": F.col("found_council")}, uses=("council",)),
        Step("keywords", {"contract_type": rules.most_keywords(text)}, uses=("prose",)),
        Step("text units", {"units": g.text_units(text)}, uses=("prose",)),
        Step("contract values", {"revenue": g.annual_value(F.col("total"), F.col("first_day"), F.col("last_day"))}, uses=("money",)),
        Step("place", {"latitude": F.col("north"), "longitude": F.col("east")}, uses=("places",)),
    ]
    return fill_gaps(schemes, steps, sides)


_FILLED = f"""schemes AS ({SCHEMES.format(part='part')}), contracts AS ({CONTRACTS.format(lineitem='lineitem')}), councils AS ({COUNCILS.format(nation='nation')}), places AS ({PLACES.format(customer='customer')}),
names AS (SELECT id, lower(trim(name)) AS n FROM councils), known AS (SELECT id, n FROM names UNION ALL {' UNION ALL '.join(f"SELECT id, trim(left(n, length(n) - {len(x)})) FROM names WHERE ends_with(n, '{x}')" for x in g.COUNCIL_SUFFIXES)}),
linked AS (SELECT a, coalesce((SELECT min(id) FROM known WHERE n = lower(trim(a))), (SELECT min(id) FROM known WHERE length(n) > 5 AND contains(lower(trim(a)), n))) AS council FROM (SELECT DISTINCT authority AS a FROM contracts WHERE authority IS NOT NULL) x),
told AS (SELECT *, CASE WHEN line % 4 <> 0 AND contains(description, 'Mill ') THEN regexp_extract(description, 'Mill ([A-Z0-9]+ [A-Z0-9]+)\\.', 1) END AS mill FROM contracts),
coded AS (SELECT DISTINCT ON (scheme) scheme, upper(trim(postcode)) AS pc, trim(address) AS ad FROM contracts WHERE postcode <> '' ORDER BY scheme, id, line),
mills AS (SELECT DISTINCT ON (scheme) scheme, mill FROM told WHERE mill IS NOT NULL ORDER BY scheme, id, line),
authority AS (SELECT DISTINCT ON (scheme) scheme, l.council FROM contracts JOIN linked l ON a = authority WHERE l.council IS NOT NULL ORDER BY scheme, id, line),
prose AS (SELECT scheme, string_agg(coalesce(description, ''), ' ' ORDER BY id, line) AS t FROM contracts GROUP BY 1),
money AS (SELECT scheme, sum(pence) / 100.0 AS total, min(starts) AS s, max(ends) AS e FROM contracts WHERE pence > 0 GROUP BY 1),
wide AS (SELECT b.*, pc, ad, mill, k.council AS k, concat(b.name, ' ', coalesce(t, '')) AS text, total, s, e FROM schemes b LEFT JOIN coded c ON c.scheme = b.id LEFT JOIN mills m ON m.scheme = b.id LEFT JOIN authority k ON k.scheme = b.id LEFT JOIN prose p ON p.scheme = b.id LEFT JOIN money y ON y.scheme = b.id),
counted AS (SELECT *, [{', '.join('(' + ' + '.join(f"contains(lower(text), '{w.lower()}')::INTEGER" for w in words) + ')' for words in rules.CONTRACT_KEYWORDS.values())}] AS hits FROM wide),
found AS (SELECT * REPLACE (coalesce(nullif(postcode, ''), pc, mill, postcode) AS postcode, CASE WHEN coalesce(postcode, '') = '' AND pc IS NOT NULL THEN coalesce(nullif(address, ''), ad) ELSE address END AS address, coalesce(council, k) AS council,
  CASE WHEN coalesce(contract_type, '') = '' AND list_max(hits) > 0 THEN list_extract([{', '.join(f"'{k}'" for k in rules.CONTRACT_KEYWORDS)}], list_position(hits, list_max(hits))) ELSE contract_type END AS contract_type,
  coalesce(units, {', '.join(f"CASE WHEN try_cast(regexp_extract(text, '{p}', 1) AS INTEGER) BETWEEN 1 AND 10000 THEN try_cast(regexp_extract(text, '{p}', 1) AS INTEGER) END" for p in g.UNIT_PATTERNS)}) AS units,
  coalesce(revenue, CASE WHEN e > s THEN trunc(total::DOUBLE / ((e - s) / 365.25::DOUBLE))::BIGINT WHEN total > 0 THEN trunc(total::DOUBLE / 3)::BIGINT END) AS revenue),
  CASE WHEN coalesce(postcode, '') = '' THEN CASE WHEN pc IS NOT NULL THEN 'contract postcode' WHEN mill IS NOT NULL THEN 'described postcode' END END AS postcode_by FROM counted),
rated AS (SELECT f.*, round_even(list_avg(list_filter([CASE WHEN certified AND a + c > 0 THEN (100 * a + 70 * c) / (a + c)::DOUBLE END, (CASE WHEN revenue <> 0 THEN 20 ELSE 0 END + CASE WHEN dated THEN 30 ELSE 0 END + CASE WHEN units <> 0 THEN 15 ELSE 0 END + CASE WHEN postcode <> '' THEN 15 ELSE 0 END + CASE WHEN certified THEN 20 ELSE 0 END)::DOUBLE,
  CASE WHEN confidence > 0 THEN confidence * 100 END], lambda v: v IS NOT NULL)), 1) AS new_rating FROM found f),
placed AS (SELECT r.* REPLACE (coalesce(r.rating, new_rating) AS rating, coalesce(r.latitude, north) AS latitude, CASE WHEN r.latitude IS NULL THEN east END AS longitude) FROM rated r LEFT JOIN places q ON q.postcode = upper(trim(r.postcode)))"""


def _schemes(spark, d):
    made = lambda sql, name: _made(spark, d, sql, name)
    return filled_schemes(made(SCHEMES, "part"), made(CONTRACTS, "lineitem"), made(COUNCILS, "nation"), made(PLACES, "customer"))


def _field(name: str, *columns: str):
    query(f"gap_{name}", f"WITH {_FILLED} SELECT id, {', '.join(columns)} FROM placed")(lambda spark, d: _schemes(spark, d).withColumn("postcode_by", F.try_element_at("filled_by", F.lit("postcode"))).select("id", *columns))


_field("postcode", "postcode", "postcode_by", "address")
_field("council", "council")
_field("contract_type", "contract_type")
_field("units", "units")
_field("revenue", "revenue")
_field("rating", "rating")
_field("place", "latitude", "longitude")


@query("gap_sector", f"SELECT id, CASE WHEN coalesce(sector, '') = '' THEN coalesce({{codes}}[lpad(first_code::VARCHAR, 2, '0')], {{codes}}[lpad(second_code::VARCHAR, 2, '0')], sector) ELSE sector END AS sector FROM ({COMPANIES.format(supplier='supplier')}) x".replace("{codes}", "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in rules.SIC_SECTORS.items()) + "}"))
def gap_sector(spark, d):
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    codes = F.array(F.concat(F.lit(" "), two("first_code"), F.lit("110")), F.concat(two("second_code"), F.lit("990 ")))
    return fill_gaps(_made(spark, d, COMPANIES, "supplier"), [Step("codes", {"sector": rules.sic_sector(codes)})]).select("id", "sector")


_APPLIED = APPLICATIONS.format(orders="orders")
_ABOUT = "concat(lower(description), ' ', coalesce(lower(kind), ''))"


@query("gap_flags", f"SELECT id, CASE WHEN description IS NOT NULL AND (is_btr IS NULL OR is_pbsa IS NULL) THEN {has_sql(_ABOUT, g.BTR_WORDS)} ELSE is_btr END AS is_btr, CASE WHEN description IS NOT NULL AND (is_btr IS NULL OR is_pbsa IS NULL) THEN {has_sql(_ABOUT, g.PBSA_WORDS)} ELSE is_pbsa END AS is_pbsa FROM ({_APPLIED}) x")
def gap_flags(spark, d):
    """Whether an application is for rent or for students, by words of its description and type; one without a description stays open."""
    about = F.concat(F.lower("description"), F.lit(" "), F.coalesce(F.lower("kind"), F.lit("")))
    steps = [Step(f, {f: rules.has_any(about, words)}, where=F.col("description").isNotNull()) for f, words in (("is_btr", g.BTR_WORDS), ("is_pbsa", g.PBSA_WORDS))]
    return fill_gaps(_made(spark, d, APPLICATIONS, "orders"), steps).select("id", "is_btr", "is_pbsa")


@query(
    "gap_application_postcode",
    f"SELECT id, CASE WHEN coalesce(postcode, '') <> '' THEN postcode WHEN id % 3 = 0 THEN {_code('o_custkey', 'id')} WHEN id % 7 <> 0 AND id % 4 = 0 THEN {_code('id', 'o_custkey')} ELSE postcode END AS postcode FROM ({_APPLIED}) x JOIN orders ON o_orderkey = id",
)
def gap_application_postcode(spark, d):
    text = F.concat_ws(" ", "address", "description")
    return fill_gaps(_made(spark, d, APPLICATIONS, "orders"), [Step("text", {"postcode": g.text_postcode(text)})]).select("id", "postcode")


_NORM = "trim(regexp_replace(" + "replace(" * len(g.SUPPLIER_SUFFIXES) + "trim(lower(supplier))" + "".join(f", '{x}', '')" for x in g.SUPPLIER_SUFFIXES) + ", '[^a-z0-9 ]', '', 'g'))"


@query(
    "gap_operator",
    f"WITH k AS (SELECT id, line, operator, {_NORM} AS n FROM ({CONTRACTS.format(lineitem='lineitem')}) x), c AS (SELECT id, trim(name) AS name FROM ({COMPANIES.format(supplier='supplier')}) y), "
    "f AS (SELECT n, coalesce((SELECT min(id) FROM c WHERE name = n), (SELECT min(id) FROM c WHERE length(n) > 5 AND (contains(name, n) OR contains(n, name)))) AS v FROM (SELECT DISTINCT n FROM k WHERE n <> '') z) SELECT k.id, line, coalesce(operator, v) AS operator FROM k LEFT JOIN f USING (n)",
)
def gap_operator(spark, d):
    """A contract's operator by its supplier: the company of that name, else the least id of those whose name holds it or is in it."""
    contracts, companies = _made(spark, d, CONTRACTS, "lineitem").withColumn("n", g.supplier_key(F.col("supplier"))), _made(spark, d, COMPANIES, "supplier").select("id", F.trim("name").alias("known"))
    names = contracts.where("n <> ''").select("n").distinct()
    exact = companies.groupBy(F.col("known").alias("n")).agg(F.min("id").alias("exact"))
    long = names.where(F.length("n") >= g.LEAST_NAME)
    inner = containing(long, "n", companies, "known").join(companies, "known")
    outer = containing(companies, "known", long, "n", g.LEAST_NAME).join(companies, "known")
    part = inner.select("n", "id").unionByName(outer.select("n", "id")).groupBy("n").agg(F.min("id").alias("part"))
    found = names.join(exact, "n", "left").join(part, "n", "left").select(F.col("n").alias("key"), F.coalesce("exact", "part").alias("company"))
    return fill_gaps(contracts, [Step("supplier", {"operator": F.col("company")}, uses=("supplier",))], {"supplier": Side(found, "key", "n")}).select("id", "line", "operator")



ATTRIBUTED = f"""SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'arl_btr_open_operating' WHEN 1 THEN 'find_a_tender' WHEN 2 THEN 'bpf_btr_pipeline' WHEN 3 THEN 'contracts_finder' ELSE 'epc_new_dwelling' END AS source, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE concat('LS', p_partkey * 31 % 90) END AS postcode,
  CASE WHEN p_partkey % 7 < 4 AND p_partkey % 3 <> 0 THEN p_partkey % 500 WHEN p_partkey % 17 = 0 THEN 7 END AS owner, CASE WHEN p_partkey % 7 < 4 AND p_partkey % 4 <> 0 THEN p_partkey % 300 WHEN p_partkey % 19 = 0 THEN 8 END AS operator, CAST(p_partkey % 100 AS DOUBLE) / 100 AS confidence FROM {{part}}"""
PLANS = "SELECT o_orderkey AS id, concat('LS', o_custkey % 100) AS postcode, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS company, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 40 END AS units FROM {orders} WHERE o_orderkey % 41 = 0"
VEHICLES = "SELECT s_suppkey AS id, concat('1 Mill Lane, Leeds, LS', s_suppkey * 7 % 100, ' 1AA') AS address, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey + 1000 END AS parent FROM {supplier}"


def epc_steps(schemes, plans, vehicles, trusted: float = 0.85):
    """Owners and operators of schemes known from certificates only, by seven strategies in turn; each fills nulls only.

    By postcode: of the directory's schemes, the applicant of the largest
    application, schemes from tenders, the parent of a vehicle registered there, the
    pipeline's schemes (the least id of each); then an owner counts as operator, and
    the confidence of a scheme with an owner is ``trusted`` at least.
    """
    at = schemes.where("postcode <> ''")

    def of(*sources: str):
        return at.where(F.col("source").isin(*sources)).groupBy("postcode").agg(F.min_by("owner", F.when(F.col("owner").isNotNull(), F.col("id"))).alias("o"), F.min_by("operator", F.when(F.col("operator").isNotNull(), F.col("id"))).alias("p"))

    named = {"directory": of("arl_btr_open_operating"), "tenders": of("find_a_tender", "contracts_finder"), "pipeline": of("bpf_btr_pipeline")}
    largest = plans.where("company IS NOT NULL AND postcode <> ''").groupBy("postcode").agg(F.max_by("company", F.struct(F.coalesce("units", F.lit(0)), "id")).alias("o"))
    registered = vehicles.where("parent IS NOT NULL").select(F.upper(F.regexp_extract("address", r"([A-Za-z]+[0-9]+) [0-9][A-Za-z]{2}", 1)).alias("postcode"), "id", "parent").groupBy("postcode").agg(F.min_by("parent", "id").alias("o"))
    tables = named | {"applications": largest, "vehicles": registered}
    sides = {n: Side(t.select(F.col("postcode").alias("key"), *[F.col(c).alias(f"{n}_{c}") for c in t.columns if c != "postcode"]), "key", "postcode") for n, t in tables.items()}
    epc = F.col("source") == "epc_new_dwelling"
    owner = lambda n: Step(f"{n} owner", {"owner": F.col(f"{n}_o")}, uses=(n,), where=epc)
    operator = lambda n: Step(f"{n} operator", {"operator": F.col(f"{n}_p")}, uses=(n,), where=epc)
    steps = [owner("directory"), operator("directory"), owner("applications"), owner("tenders"), operator("tenders"), owner("vehicles"), owner("pipeline"), operator("pipeline")]
    steps.append(Step("owner as operator", {"operator": F.col("owner")}, reads=("owner",), where=epc))
    out = fill_gaps(schemes, steps, sides)
    return out.withColumn("confidence", F.when(epc & F.col("owner").isNotNull() & (F.col("confidence") < trusted), F.lit(trusted)).otherwise(F.col("confidence")))


_AT = "(SELECT arg_min({0}, id) FROM s k WHERE k.postcode = s.postcode AND s.postcode <> '' AND k.source IN ({1}) AND {0} IS NOT NULL)"
_STRATEGIES = [("directory", "'arl_btr_open_operating'"), ("tenders", "'find_a_tender', 'contracts_finder'"), ("pipeline", "'bpf_btr_pipeline'")]


@query(
    "epc_strategies",
    f"WITH s AS ({ATTRIBUTED.format(part='part')}), a AS ({PLANS.format(orders='orders')}), v AS ({VEHICLES.format(supplier='supplier')}), w AS (SELECT *, {', '.join(f'{_AT.format(c, q)} AS {n}_{c}' for n, q in _STRATEGIES for c in ('owner', 'operator'))}, "
    "(SELECT arg_max(company, {'u': coalesce(units, 0), 'i': a.id}) FROM a WHERE a.postcode = s.postcode AND company IS NOT NULL) AS applicant, (SELECT arg_min(parent, v.id) FROM v WHERE parent IS NOT NULL AND concat('LS', v.id * 7 % 100) = s.postcode) AS vehicle FROM s), "
    "f AS (SELECT *, CASE WHEN source = 'epc_new_dwelling' THEN coalesce(owner, directory_owner, applicant, tenders_owner, vehicle, pipeline_owner) ELSE owner END AS o FROM w) "
    "SELECT id, o AS owner, CASE WHEN source = 'epc_new_dwelling' THEN coalesce(operator, directory_operator, tenders_operator, pipeline_operator, o) ELSE operator END AS operator, CASE WHEN source = 'epc_new_dwelling' AND o IS NOT NULL AND confidence < 0.85 THEN 0.85::DOUBLE ELSE confidence END AS confidence, "
    "CASE WHEN source = 'epc_new_dwelling' AND owner IS NULL THEN CASE WHEN directory_owner IS NOT NULL THEN 'directory owner' WHEN applicant IS NOT NULL THEN 'applications owner' WHEN tenders_owner IS NOT NULL THEN 'tenders owner' WHEN vehicle IS NOT NULL THEN 'vehicles owner' WHEN pipeline_owner IS NOT NULL THEN 'pipeline owner' END END AS owner_by FROM f",
)
def epc_strategies(spark, d):
    made = lambda sql, name: _made(spark, d, sql, name)
    out = epc_steps(made(ATTRIBUTED, "part"), made(PLANS, "orders"), made(VEHICLES, "supplier"))
    return out.select("id", "owner", "operator", "confidence", F.try_element_at("filled_by", F.lit("owner")).alias("owner_by"))
