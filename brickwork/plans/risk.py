"""Risk, trend, grades, owner types, noise, extractors and undoable changes (P17, R07, R08, R12, R18, R19, R24, F04, F16), on texts and figures made from columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickwork.functions import dates, extract, periods
from brickwork.functions import risk as r
from brickwork.operators import snapshots
from brickwork.plans.gaps import _code, _pick
from brickwork.registry import query, table


def made(spark, d, sql: str, name: str):
    return spark.sql(sql, **{name: table(spark, d, name)})


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


RATED = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS ends, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 101 AS DOUBLE) END AS performance,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 193 AS DOUBLE) / 2 END AS satisfaction, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 89 AS DOUBLE) END AS health, CASE WHEN o_orderkey % 6 <> 0 THEN o_custkey % 400 END AS units,
  CASE WHEN o_orderkey % 8 = 0 THEN 'E' WHEN o_orderkey % 8 = 1 THEN 'G' END AS letter FROM {orders}"""
_CURRENT = "SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS current FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber = 1 GROUP BY 1"
_TELLS = " ".join(f"WHEN days / 30.44::DOUBLE <= {m} THEN {{{k}}}" for k, (m, *_) in enumerate(r.RISK_STEPS))


def _told(place: int) -> str:
    values = [_q(s[place + 1]) if s[place + 1] else "NULL" for s in r.RISK_STEPS]
    last = _q(r.MINIMAL[place]) if r.MINIMAL[place] else "NULL"
    return f"CASE WHEN ends IS NULL THEN {_q(r.UNKNOWN[place])} WHEN days <= 0 THEN {_q(r.EXPIRED[place])} {_TELLS.format(*values)} ELSE {last} END"


@query(
    "contract_risk",
    f"WITH b AS ({RATED.format(orders='orders')}), c AS ({_CURRENT}), x AS (SELECT * REPLACE (coalesce(current, ends) AS ends) FROM b LEFT JOIN c ON l_orderkey = id), y AS (SELECT *, date_diff('day', DATE '1999-01-01', ends) AS days FROM x) "
    f"SELECT id, {_told(0)} AS level, round_even(days / 30.44::DOUBLE, 1) AS months, days::INTEGER AS days, {_told(1)} AS action, CASE WHEN ends IS NOT NULL THEN greatest(ends - 365, DATE '1999-01-01') END::DATE AS window_opens, array_to_string(list_filter([{_told(2)}, "
    "CASE WHEN ends IS NOT NULL AND performance < 50 THEN concat('Low performance rating (', performance, '/100) increases likelihood of operator change.') END, CASE WHEN ends IS NOT NULL AND satisfaction < 50 THEN concat('Low satisfaction score (', satisfaction, '/100) suggests client may seek alternatives.') END, "
    "CASE WHEN ends IS NOT NULL AND health < 40 THEN concat('Poor financial health (', health, '/100) may indicate operational difficulties.') END, CASE WHEN ends IS NOT NULL AND units >= 200 THEN concat('Large scheme (', units, ' units) represents significant revenue opportunity.') END], lambda v: v IS NOT NULL), '|') AS factors FROM y",
)
def contract_risk(spark, d):
    """By the latest end of a current contract, else the scheme's own."""
    current = table(spark, d, "lineitem").where("l_linestatus = 'O' AND l_linenumber = 1").groupBy(F.col("l_orderkey").alias("id")).agg(F.max(F.to_date("l_shipdate")).alias("current"))
    b = made(spark, d, RATED, "orders").join(current, "id", "left")
    risk = r.contract_risk(F.coalesce("current", "ends"), F.lit("1999-01-01").cast("date"), F.col("performance"), F.col("satisfaction"), F.col("health"), F.col("units"))
    return b.select("id", risk.alias("r")).select("id", "r.level", "r.months", "r.days", "r.action", F.col("r.window").alias("window_opens"), F.array_join("r.factors", "|").alias("factors"))


def _state(value: str, place: int) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {s[0]} THEN {_q(s[place])}" for s in r.STATES[:-1]) + f" ELSE {_q(r.STATES[-1][place])} END"


_METRIC = "CASE WHEN {0} IS NOT NULL THEN concat('{0}=', {0}, ':', {1}) END"


@query(
    "perf_trend",
    f"WITH b AS (SELECT *, coalesce(list_avg(list_filter([performance, satisfaction, health], lambda v: v IS NOT NULL)), 50.0) AS m FROM ({RATED.format(orders='orders')}) x) SELECT id, {_state('m', 1)} AS state, {_state('m', 2)} AS trend, round(m, 4) AS mean, {_state('m', 3)} AS recommendation, "
    f"array_to_string(list_filter([{', '.join(_METRIC.format(c, _state(c, 1)) for c in ('performance', 'satisfaction', 'health'))}, CASE WHEN letter IS NOT NULL THEN concat('epc_rating=', letter, ':needs_improvement') END], lambda v: v IS NOT NULL), '|') AS factors FROM b",
)
def perf_trend(spark, d):
    b = made(spark, d, RATED, "orders")
    ratings = {c: F.col(c) for c in ("performance", "satisfaction", "health")}
    out = b.select("id", r.performance_trend(ratings, F.col("letter")).alias("t"), *ratings)
    there = [F.col(c).isNotNull().cast("int") for c in ratings]
    mean = sum((F.coalesce(c, F.lit(0.0)) for c in ratings.values()), F.lit(0.0)) / F.nullif(sum(there, F.lit(0)), F.lit(0))
    told = F.transform("t.factors", lambda f: F.concat(f["metric"], F.lit("="), f["value"], F.lit(":"), f["assessment"]))
    return out.select("id", "t.state", "t.trend", F.round(F.coalesce(mean, F.lit(r.UNRATED)), 4).alias("mean"), "t.recommendation", F.array_join(told, "|").alias("factors"))


GRADED = "SELECT p_partkey AS id, CASE WHEN p_partkey % 9 <> 0 THEN concat('G', p_partkey % 6) END AS g, CASE WHEN p_size % 7 <> 0 THEN concat(CASE WHEN p_partkey % 11 = 0 THEN 'X' ELSE 'V' END, p_size % 5) END AS v, CASE WHEN p_partkey % 4 = 0 THEN concat('C', p_size % 4 + 1) ELSE '' END AS c FROM {part}"
_VALID = "list_filter([CASE WHEN substr(g, 2) BETWEEN '1' AND '4' THEN g END, CASE WHEN v LIKE 'V%' AND substr(v, 2) BETWEEN '1' AND '4' THEN v END, nullif(c, '')], lambda x: x IS NOT NULL)"


@query(
    "rsh_health",
    f"SELECT id, array_to_string(k, '/') AS label, CASE list_max(list_transform(k, lambda x: substr(x, 2)::INTEGER)) WHEN 1 THEN 15.0 WHEN 2 THEN 30.0 WHEN 3 THEN 65.0 WHEN 4 THEN 85.0 END::DOUBLE AS risk, CASE v WHEN 'V1' THEN 95.0 WHEN 'V2' THEN 75.0 WHEN 'V3' THEN 45.0 WHEN 'V4' THEN 20.0 END::DOUBLE AS health FROM (SELECT *, {_VALID} AS k FROM ({GRADED.format(part='part')}) x) y",
)
def rsh_health(spark, d):
    """Grades of governance, viability and consumer standards, some of them no grades."""
    return made(spark, d, GRADED, "part").select("id", r.regulatory_grades(F.col("g"), F.col("v"), F.col("c")).alias("r")).select("id", "r.*")


OWNED = f"""SELECT s_suppkey AS id, concat(s_name, {_pick([' Capital', ' Homes', ' Partners LLP', ' Holdings', ' Fundraising', ' L.P', ' Reality', ' Real Estate', ' Housing', ' Ltd', ' Asset Management'], 's_suppkey')}) AS name,
  CASE s_nationkey % 7 WHEN 0 THEN 'JERSEY' WHEN 1 THEN 'England And Wales' WHEN 2 THEN '' WHEN 3 THEN 'United Kingdom' WHEN 4 THEN 'Luxembourg' WHEN 5 THEN 'UK' END AS country, s_suppkey % 4 = 0 AS person, s_suppkey % 5 <> 0 AS chain FROM {{supplier}}"""


@query(
    "owner_label",
    f"SELECT id, CASE WHEN s IN (0, 4) THEN concat(CASE WHEN f THEN 'OFFSHORE FUND (' ELSE 'OFFSHORE ENTITY (' END, country, ')') WHEN f THEN 'PE / FUND / INSTITUTIONAL' WHEN person THEN 'PRIVATE INDIVIDUAL(S)' WHEN NOT chain THEN 'NO PSC DATA (listed/exempt?)' ELSE 'CORPORATE GROUP' END AS label "
    f"FROM (SELECT o.*, s_nationkey % 7 AS s, id % 11 IN (0, 2, 3, 5, 7, 10) AS f FROM ({OWNED.format(supplier='supplier')}) o JOIN supplier ON s_suppkey = id) x",
)
def owner_label(spark, d):
    o = made(spark, d, OWNED, "supplier")
    return o.select("id", r.owner_type(F.col("name"), F.col("country"), F.col("person"), F.col("chain")).alias("label"))


_SAID = ["Rear extension to No 4", "Felling of one oak tree", "Prune the lime", "TPO works", "Illuminated signage", "Listed Building consent", "Discharge of condition 3", "Approval of details", "Change of use to flats", "Replacement windows", "Reroofing", "Twelve flats", "A tower of homes", "Hoarding in a conservation area", "Loft conversion and change of use"]
NOISY = f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 17 <> 0 THEN concat({_pick(_SAID, 'p_partkey')}, ' at ', p_name) END AS description, CASE WHEN p_partkey % 6 <> 0 THEN p_size % 15 END AS units,
  CASE p_partkey % 8 WHEN 0 THEN 'BTR' WHEN 1 THEN 'Mixed' WHEN 2 THEN 'Residential' WHEN 3 THEN 'Unknown' END AS scheme_type, {_pick(['Full', 'Trees', 'Non-Material Amendment', 'Prior Approval', 'Outline'], 'p_size')} AS kind FROM {{part}}"""
_GOES = "coalesce(units, 0) < 10 AND (scheme_type IS NULL OR scheme_type NOT IN ('BTR', 'PBSA', 'Co-living', 'Senior', 'Affordable', 'Mixed')) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = id AND o_orderstatus = 'O')"


def _noisy(spark, d):
    kept = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"))
    return made(spark, d, NOISY, "part").where(r.may_go(F.col("units"), F.col("scheme_type"))).join(kept, "id", "left_anti")


@query(
    "noise_filter",
    f"SELECT id, array_to_string(k, ',') AS classes FROM (SELECT *, list_filter([{', '.join(f'CASE WHEN regexp_matches(lower(description), {_q(p)}) THEN {_q(k)} END' for k, p in r.NOISE.items())}], lambda x: x IS NOT NULL) AS k FROM ({NOISY.format(part='part')}) x) y WHERE len(k) > 0 AND {_GOES}",
)
def noise_filter(spark, d):
    """Small applications of no protected type and not in the pipeline, with all classes of noise that they fall in."""
    return _noisy(spark, d).select("id", F.array_join(r.noise_classes(F.col("description")), ",").alias("classes")).where("classes <> ''")


@query("noise_by_type", f"SELECT id, kind FROM ({NOISY.format(part='part')}) x WHERE kind IN ('Trees', 'Non-Material Amendment', 'Prior Approval') AND {_GOES}")
def noise_by_type(spark, d):
    return _noisy(spark, d).where(F.lower("kind").rlike(r.NOISE_TYPES)).select("id", "kind")


PLACED = f"SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN concat('Flat ', p_size, ', ', {_code('p_partkey', 'p_size')}) WHEN 1 THEN concat(lower(replace({_code('p_partkey', 'p_size')}, ' ', '')), ' Leeds') WHEN 2 THEN concat('x', {_code('p_partkey', 'p_size')}, 'y') WHEN 3 THEN 'Box 7, GIR 0AA' WHEN 4 THEN concat(p_name, ' no code') END AS text FROM {{part}}"
_AS_IS = _code("id", "p_size")


@query(
    "postcode_families",
    f"SELECT id, CASE id % 6 WHEN 0 THEN {_AS_IS} WHEN 1 THEN {_AS_IS} WHEN 3 THEN 'GIR 0AA' END AS strict, CASE WHEN id % 6 < 3 THEN {_AS_IS} END AS \"any\", CASE WHEN id % 6 < 2 THEN {_AS_IS} END AS word, CASE WHEN id % 6 = 0 THEN {_AS_IS} END AS tail FROM (SELECT p_partkey AS id, p_size FROM part) x",
)
def postcode_families(spark, d):
    text = F.col("text")
    return made(spark, d, PLACED, "part").select("id", *[extract.postcode_of(text, f).alias(f) for f in extract.POSTCODES])


COUNTED = f"""SELECT p_partkey AS id, concat('Home to ', p_size * 9, {_pick([' students', ' student rooms', ' en-suite rooms', ' bed spaces', ' guests'], 'p_partkey')}, ' in ', p_partkey % 3, ' blocks') AS hall,
  concat('Comprising ', p_size, ' flats of which ', p_size // 2, ' homes; number of units: ', p_partkey * 7 % 20000) AS document, CASE p_partkey % 5 WHEN 0 THEN '12.7' WHEN 1 THEN 'abc' WHEN 2 THEN '0' WHEN 3 THEN CAST(p_partkey * 40 AS STRING) END AS first_field, CASE WHEN p_partkey % 2 = 0 THEN p_size * 2 END AS second_field,
  CASE p_partkey % 4 WHEN 0 THEN 'Large' WHEN 1 THEN 'MAJOR' WHEN 2 THEN 'Small' END AS size, CASE WHEN p_partkey % 3 = 0 THEN concat('Erection of ', p_size, ' dwellings') END AS description FROM {{part}}"""


@query(
    "number_extractors",
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 < 4 AND p_size * 9 BETWEEN 20 AND 999 AND p_size * 9 > 9 THEN p_size * 9 END AS beds, greatest(CASE WHEN p_size >= 2 THEN p_size END, CASE WHEN p_size // 2 >= 2 THEN p_size // 2 END, CASE WHEN p_partkey * 7 % 20000 BETWEEN 2 AND 10000 THEN p_partkey * 7 % 20000 END)::INTEGER AS most, "
    "coalesce(CASE WHEN p_partkey % 5 = 0 THEN 12 WHEN p_partkey % 5 = 3 AND p_partkey * 40 <= 50000 THEN p_partkey * 40 END, CASE WHEN p_partkey % 2 = 0 THEN p_size * 2 END, CASE WHEN p_partkey % 3 = 0 THEN p_size END)::INTEGER AS fields, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_size END, CASE p_partkey % 4 WHEN 0 THEN 50 WHEN 1 THEN 15 END)::INTEGER AS by_size FROM part",
)
def number_extractors(spark, d):
    """Beds of halls, the most homes that a document names, the first field that is a number of homes, homes by size class."""
    c = made(spark, d, COUNTED.replace("p_size // 2", "p_size DIV 2"), "part")
    fields = extract.field_units([F.col("first_field"), F.col("second_field")], F.col("description"))
    return c.select("id", extract.bed_count(F.col("hall")).alias("beds"), extract.most_units(F.col("document")).alias("most"), fields.alias("fields"), extract.size_units(F.col("size"), F.col("description")).alias("by_size"))


TYPED = """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN 'epc_new_dwelling' ELSE 'directory' END AS source, CASE p_partkey % 5 WHEN 0 THEN 'BTR' WHEN 1 THEN 'PBSA' WHEN 2 THEN 'Senior' WHEN 3 THEN 'Residential' END AS kind,
  CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS num_units, p_size * 2 AS total_units, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS notes FROM {part}"""
_LONG_TAIL = "source = 'epc_new_dwelling' AND kind IN ('BTR', 'PBSA', 'Co-living', 'Senior') AND coalesce(num_units, total_units) < 20"
_NOTE = " Reclassified from BD cohort (EPC long-tail <20 units)."


def _reclassified(spark, d):
    """State, backup and changed state of the long-tail reclassification."""
    state = made(spark, d, TYPED, "part")
    where = F.expr(_LONG_TAIL)
    backup = snapshots.backed_up(state, None, "id", ["kind", "notes"], where)
    after = snapshots.changed(state, where, {"kind": F.lit("Residential"), "notes": F.left(F.concat(F.coalesce("notes", F.lit("")), F.lit(_NOTE)), F.lit(1000))})
    return state, backup, after


@query("reclass_applied", f"SELECT id, source, CASE WHEN {_LONG_TAIL} THEN 'Residential' ELSE kind END AS kind, num_units, total_units, CASE WHEN {_LONG_TAIL} THEN left(concat(coalesce(notes, ''), '{_NOTE}'), 1000) ELSE notes END AS notes FROM ({TYPED.format(part='part')}) x")
def reclass_applied(spark, d):
    return _reclassified(spark, d)[2]


@query("reclass_restored", TYPED.format(part="part"))
def reclass_restored(spark, d):
    """The change made twice and taken back: the state is as it was, whole rows and all, as the first copy of a row stays."""
    _, backup, after = _reclassified(spark, d)
    again = F.col("kind") == "Residential"
    backup = snapshots.backed_up(after, backup, "id", ["kind", "notes"], again)
    after = snapshots.changed(after, again, {"kind": F.lit("Unknown")})
    return snapshots.taken_back(after, backup, "id")


DATED = f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS starts, CASE WHEN o_orderkey % 7 = 0 THEN DATE '2009-09-09' END AS ends, CASE WHEN o_orderkey % 2 = 0 THEN date_add(DATE '2001-01-31', CAST(o_custkey % 300 AS INTEGER)) END AS published,
  CASE WHEN o_orderkey % 5 = 0 THEN DATE '2003-03-31' END AS awarded, CASE WHEN o_orderkey % 11 <> 0 THEN DATE '2005-05-31' END AS created,
  CASE o_orderkey % 6 WHEN 0 THEN concat('Repairs for a period of ', o_custkey % 60 + 1, ' months') WHEN 1 THEN concat(o_custkey % 9 + 1, '+2+1 years of care') WHEN 2 THEN concat('A contract for ', o_custkey % 8 + 1, ' years at ', o_orderpriority) WHEN 3 THEN 'No term is told' WHEN 4 THEN concat('Works, ', o_custkey % 30 + 1, ' year framework') END AS description FROM {{orders}}"""
_MONTHS = "CASE id % 6 WHEN 0 THEN o_custkey % 60 + 1 WHEN 1 THEN (o_custkey % 9 + 4) * 12 WHEN 2 THEN (o_custkey % 8 + 1) * 12 WHEN 4 THEN (o_custkey % 30 + 1) * 12 END"


@query(
    "backfill_tiers",
    f"WITH x AS (SELECT b.*, {_MONTHS}::INTEGER AS m, coalesce(published, awarded, created) AS proxy FROM ({DATED.replace('date_add(DATE ' + chr(39) + '2001-01-31' + chr(39) + ', CAST(o_custkey % 300 AS INTEGER))', 'DATE ' + chr(39) + '2001-01-31' + chr(39) + ' + CAST(o_custkey % 300 AS INTEGER)').format(orders='orders')}) b JOIN orders ON o_orderkey = id) "
    "SELECT id, CASE WHEN starts IS NULL AND ends IS NULL AND m IS NOT NULL THEN proxy ELSE starts END::DATE AS starts, CASE WHEN ends IS NOT NULL THEN ends WHEN starts IS NOT NULL AND m IS NOT NULL THEN starts + to_months(m) WHEN starts IS NULL AND m IS NOT NULL THEN proxy + to_months(m) END::DATE AS ends, "
    "CASE WHEN ends IS NULL AND m IS NOT NULL THEN CASE WHEN starts IS NOT NULL THEN 'duration' WHEN published IS NOT NULL THEN 'published' WHEN awarded IS NOT NULL THEN 'award' WHEN created IS NOT NULL THEN 'created' END END AS source FROM x",
)
def backfill_tiers(spark, d):
    """Ends from a known start and the term in the text; without both, start from the day of publication, award or entry, and the end from it."""
    return made(spark, d, DATED, "orders").select("id", periods.backfilled(F.col("starts"), F.col("ends"), F.col("description"), {"published": F.col("published"), "award": F.col("awarded"), "created": F.col("created")}).alias("b")).select("id", "b.*")


WRITTEN = """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, o_orderkey % 11 AS form FROM {orders}"""
_FORMS = ["yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T23:59:59Z'", "yyyy-MM-dd'T23:30:00-05:00'", "yyyy-MM-dd' or so'"]
_FITS = {"portal": (0, 1, 5, 6), "certificate": (0, 1, 3, 5, 6), "written": (0, 1, 2, 3, 4), "notice": (0, 5, 6, 7, 8, 9)}


@query("date_families", "SELECT id, " + ", ".join(f"CASE WHEN form IN {fits}{' OR (form = 4 AND month(day) = 5)' if family == 'certificate' else ''} THEN day END AS {family}" for family, fits in _FITS.items()) + f" FROM ({WRITTEN.format(orders='orders')}) x")
def date_families(spark, d):
    """Order dates written in ten ways, or not at all, read by the list of formats of each family; a long and a short May are the same."""
    w = made(spark, d, WRITTEN, "orders")
    text = F.when(F.col("form") == 10, "soon")
    for n, form in enumerate(_FORMS):
        text = text.when(F.col("form") == n, F.concat(F.lit(" "), F.date_format(F.col("day").cast("timestamp"), form)))
    return w.select("id", *[dates.parsed_date(text, f).alias(f) for f in dates.FAMILIES])
