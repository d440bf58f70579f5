"""Queries of the scalar text, number and date functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickwork.functions import names as n
from brickwork.registry import query, table

#: Parts give texts on both sides: synthesised, as the tables hold none of this domain.
LINES = """
SELECT p_partkey AS id, p_size, p_name, p_type,
  CASE p_partkey % 6 WHEN 0 THEN concat(p_name, ' Development Ltd') WHEN 1 THEN concat(p_name, ' Real Estate Partners LLC') WHEN 2 THEN 'L&Q Housing' WHEN 3 THEN concat('The ', p_name, ' Group (UK) PLC') WHEN 4 THEN NULL ELSE concat(p_name, ' Holdings Limited') END AS company,
  CASE p_partkey % 4 WHEN 0 THEN concat(p_size, ' High Street, London SW1A ', p_partkey % 10, 'AA') WHEN 1 THEN concat(p_size, ' Park Road, Leeds LS', p_size % 9 + 1, '  4bd') WHEN 2 THEN concat('Flat ', p_size, ', North Court') ELSE NULL END AS address,
  CASE p_partkey % 9 WHEN 0 THEN 'Pending Consideration' WHEN 1 THEN 'Invalid' WHEN 2 THEN 'Undecided' WHEN 3 THEN 'Not permitted' WHEN 4 THEN 'Appeal refused' WHEN 5 THEN 'APPLICATION GRANTED' WHEN 6 THEN '' WHEN 7 THEN NULL ELSE 'Other' END AS status,
  CASE p_partkey % 5 WHEN 0 THEN concat('Erection of ', p_size * 13, ' no. residential flats') WHEN 1 THEN concat('up to 60,000 homes comprising ', p_size) WHEN 2 THEN concat(p_size, ' bed student block') WHEN 3 THEN concat('1,', 100 + p_size, ' dwellings') ELSE 'shop front' END AS description,
  CASE p_partkey % 7 WHEN 0 THEN concat('ends 20', 10 + p_size % 20, '-0', p_size % 9 + 1, '-15') WHEN 1 THEN concat('on ', p_size % 28 + 1, ' March 2025') WHEN 2 THEN concat('by 31/0', p_size % 9 + 1, '/2026') WHEN 3 THEN 'from May 2027' WHEN 4 THEN '2024-13-45 then 02/03/2024' WHEN 5 THEN 'no date' END AS dates,
  CASE p_partkey % 6 WHEN 0 THEN '5+2+2 years' WHEN 1 THEN concat(p_size, ' months') WHEN 2 THEN concat('a ', p_size, '-year term') WHEN 3 THEN '20+30 years' WHEN 4 THEN NULL ELSE 'open ended' END AS term
FROM part
"""


def lines(spark, d):
    return spark.sql(LINES.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))


def sql(select: str) -> str:
    return f"WITH lines AS ({LINES}) {select}"


SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_WORDS = r"\b(?:" + "|".join(n.COMPANY_WORDS) + r")\b"
_STRIPPED = "lower(trim(company))"
for _ in range(3):
    _STRIPPED = f"regexp_replace({_STRIPPED}, '{_WORDS}', '', 'g')"


@query("norm_company", sql(f"SELECT id, {SQUEEZE.format(f'''regexp_replace({_STRIPPED}, '[^[:alnum:]_[:space:]]', ' ', 'g')''')} AS name FROM lines"))
def norm_company(spark, d):
    return lines(spark, d).select("id", n.company_name(F.col("company")).alias("name"))


@query("norm_company_v", sql(r"SELECT id, trim(regexp_replace(upper(trim(company)), '\s+(LIMITED|LTD\.?|PLC|LLP)$', '')) AS tail, regexp_replace(lower(company), '[^a-z0-9]', '', 'g') AS key FROM lines"))
def norm_company_v(spark, d):
    return lines(spark, d).select("id", n.company_tail(F.col("company")).alias("tail"), n.name_key(F.col("company")).alias("key"))


_SHORT = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in n.STREET_WORDS.items()) + " ELSE w END"
_PLAIN = SQUEEZE.format(f"regexp_replace(regexp_replace(lower(trim(address)), '{n.POSTCODE}', '', 'g'), '[^a-z0-9_\\s]', ' ', 'g')")


@query("norm_address", sql(f"SELECT id, array_to_string(list_transform(string_split({_PLAIN}, ' '), lambda w: {_SHORT}), ' ') AS address FROM lines"))
def norm_address(spark, d):
    return lines(spark, d).select("id", n.address(F.col("address")).alias("address"))


_PC = f"upper(replace(regexp_extract(address, '{n.POSTCODE}', 1), ' ', ''))"
PC_SQL = f"CASE WHEN {_PC} <> '' THEN concat_ws(' ', left({_PC}, length({_PC}) - 3), right({_PC}, 3)) END"


@query("postcode_extract", sql(f"SELECT id, {PC_SQL} AS postcode FROM lines"))
def postcode_extract(spark, d):
    return lines(spark, d).select("id", n.postcode(F.col("address")).alias("postcode"))


@query("outcode", sql(f"SELECT id, split_part({PC_SQL}, ' ', 1) AS outcode FROM lines WHERE {PC_SQL} IS NOT NULL"))
def outcode(spark, d):
    return lines(spark, d).select("id", n.outward(n.postcode(F.col("address"))).alias("outcode")).where("outcode IS NOT NULL")


@query("ch_number", "SELECT p_partkey, CASE WHEN regexp_matches(x, '^[0-9]{1,7}$') THEN lpad(x, 8, '0') ELSE x END AS number FROM (SELECT p_partkey, upper(trim(CASE p_partkey % 3 WHEN 0 THEN concat(' ', p_partkey) WHEN 1 THEN concat('sc', p_partkey) ELSE concat('1234567', p_partkey) END)) AS x FROM part) t")
def ch_number(spark, d):
    key = F.col("p_partkey")
    raw = F.when(key % 3 == 0, F.concat(F.lit(" "), key)).when(key % 3 == 1, F.concat(F.lit("sc"), key)).otherwise(F.concat(F.lit("1234567"), key))
    return table(spark, d, "part").select("p_partkey", n.company_number(raw).alias("number"))


@query("norm_status", sql("SELECT id, CASE WHEN status IS NULL OR status = '' THEN 'Unknown' " + " ".join(f"WHEN contains(lower(trim(status)), '{a}') THEN '{b}'" for a, b in n.STATUS_WORDS) + " ELSE 'Unknown' END AS status FROM lines"))
def norm_status(spark, d):
    return lines(spark, d).select("id", n.status(F.col("status")).alias("status"))


@query("number_extract", sql("SELECT id, list_max(list_filter(list_transform(regexp_extract_all(description, '[0-9]+'), lambda x: CAST(x AS INTEGER)), lambda v: v BETWEEN 2 AND 10000)) AS largest FROM lines"))
def number_extract(spark, d):
    found = F.transform(F.regexp_extract_all("description", F.lit("([0-9]+)"), 1), lambda x: x.cast("int"))
    return lines(spark, d).select("id", F.array_max(F.filter(found, lambda v: v.between(2, 10000))).alias("largest"))


@query("rent_convert", "SELECT p_partkey, round(round_even(p_retailprice * 52 / 12, 2), 2) AS pcm, round(round_even(p_retailprice * 12 / 52, 2), 2) AS ppw FROM part")
def rent_convert(spark, d):
    price = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", F.bround(price * 52 / 12, 2).alias("pcm"), F.bround(price * 12 / 52, 2).alias("ppw"))


_MONTHS = "(January|February|March|April|May|June|July|August|September|October|November|December)"


@query(
    "date_parse",
    sql(
        "SELECT id, CAST(coalesce(try_strptime(nullif(regexp_extract(dates, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), ''), '%Y-%m-%d'), "
        f"try_strptime(nullif(regexp_extract(dates, '[0-9]{{1,2}} {_MONTHS} [0-9]{{4}}'), ''), '%d %B %Y'), try_strptime(nullif(regexp_extract(dates, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}'), ''), '%d/%m/%Y'), "
        f"try_strptime(concat('1 ', nullif(regexp_extract(dates, '{_MONTHS} [0-9]{{4}}'), '')), '%d %B %Y')) AS DATE) AS day FROM lines"
    ),
)
def date_parse(spark, d):
    return lines(spark, d).select("id", n.any_date(F.col("dates")).alias("day"))


@query(
    "duration_months",
    sql(
        "SELECT id, coalesce(CASE WHEN c <> '' AND s <= 40 THEN s * 12 END, TRY_CAST(nullif(regexp_extract(term, '([0-9]+)\\s*(?:months|month)', 1), '') AS INTEGER), CASE WHEN y BETWEEN 1 AND 30 THEN y * 12 END)::INTEGER AS months FROM "
        "(SELECT *, list_sum(list_transform(regexp_extract_all(c, '[0-9]+'), lambda x: CAST(x AS INTEGER))) AS s, TRY_CAST(nullif(regexp_extract(term, '([0-9]+)\\s*-?\\s*(?:years|year|yrs)', 1), '') AS INTEGER) AS y FROM "
        "(SELECT *, regexp_extract(term, '([0-9]+(?:\\s*\\+\\s*[0-9]+)+)\\s*(?:years|year|yrs)', 1) AS c FROM lines) a) b"
    ),
)
def duration_months(spark, d):
    return lines(spark, d).select("id", n.duration_months(F.col("term")).alias("months"))


@query("add_duration", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + to_months(CAST(o_orderkey % 40 AS INTEGER)) AS DATE) AS ends FROM orders")
def add_duration(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.add_months("o_orderdate", (F.col("o_orderkey") % 40).cast("int")).alias("ends"))


@query("month_diff", "SELECT o_orderkey, CAST((year(o_orderdate) - 1998) * 12 + month(o_orderdate) - 1 AS INTEGER) AS months FROM orders")
def month_diff(spark, d):
    return table(spark, d, "orders").select("o_orderkey", n.months_between_days(F.lit("1998-01-01").cast("date"), F.col("o_orderdate")).alias("months"))


@query("days_left", "SELECT o_orderkey, date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)) AS days, round(date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)) / 30.44, 4) AS months FROM orders")
def days_left(spark, d):
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1998-01-01").cast("date")).cast("long")
    return table(spark, d, "orders").select("o_orderkey", days.alias("days"), F.round(days / F.lit(30.44), 4).alias("months"))


@query("date_trunc", "SELECT event_id, strftime(ts, '%Y-%m') AS month, CAST(date_trunc('week', ts) AS DATE) AS week FROM events")
def date_trunc(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM").alias("month"), F.to_date(F.date_trunc("week", "ts")).alias("week"))


@query("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("json_build", "SELECT p_partkey, concat('{', concat_ws(',', CASE WHEN p_size > 20 THEN concat('\"size\":\"', p_size, '\"') END, concat('\"type\":\"', p_type, '\"')), '}') AS json FROM part")
def json_build(spark, d):
    size = F.when(F.col("p_size") > 20, F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", F.to_json(F.struct(size.alias("size"), F.col("p_type").alias("type"))).alias("json"))


@query("html_title", "SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS body FROM pages")
def html_title(spark, d):
    title = n.squeeze(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return table(spark, d, "pages").select("page_id", title.alias("title"), n.visible_text(F.col("html")).alias("body"))


@query("url_domain", "SELECT page_id, regexp_replace(regexp_extract(lower(url), '^(?:[a-z]+://)?([^/:?#]+)', 1), '^www\\.', '') AS domain FROM pages")
def url_domain(spark, d):
    return table(spark, d, "pages").select("page_id", n.domain(F.col("url")).alias("domain"))


@query("name_tokens", sql("SELECT id, array_to_string(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]{4,}'), lambda w: w NOT IN ('blue', 'ring')), ' ') AS tokens FROM lines"))
def name_tokens(spark, d):
    return lines(spark, d).select("id", F.array_join(n.tokens(F.col("p_name"), 4, ["blue", "ring"]), " ").alias("tokens"))


@query("valid_name", sql("SELECT id, coalesce(length(company) BETWEEN 3 AND 60 AND NOT regexp_matches(lower(company), '^(the|a) ') AND length(regexp_replace(company, '[^A-Za-z]', '', 'g')) >= 0.4 * length(company), false) AS valid FROM lines"))
def valid_name(spark, d):
    c = F.col("company")
    ok = F.length(c).between(3, 60) & ~F.lower(c).rlike("^(the|a) ") & (F.length(F.regexp_replace(c, "[^A-Za-z]", "")) >= 0.4 * F.length(c))
    return lines(spark, d).select("id", F.coalesce(ok, F.lit(False)).alias("valid"))


@query("rounding", "SELECT p_partkey, round_even(p_size / 2.0, 0) AS half_even, round(p_size / 2.0, 0) AS half_up FROM part")
def rounding(spark, d):
    half = F.col("p_size") / F.lit(2.0)
    return table(spark, d, "part").select("p_partkey", F.bround(half, 0).alias("half_even"), F.round(half, 0).alias("half_up"))


@query("clamp", "SELECT c_custkey, least(greatest(c_acctbal / 50, 0), 100) AS score FROM customer")
def clamp(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.least(F.greatest(F.col("c_acctbal") / 50, F.lit(0.0)), F.lit(100.0)).alias("score"))


@query("truncate", sql("SELECT id, substr(concat(coalesce(company, ''), ' ', description), 1, 20) AS note FROM lines"))
def truncate(spark, d):
    return lines(spark, d).select("id", F.substring(F.concat(F.coalesce("company", F.lit("")), F.lit(" "), "description"), 1, 20).alias("note"))
