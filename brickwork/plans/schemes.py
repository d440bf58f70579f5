"""Queries of the rule tables: scheme and contract types, unit counts, sectors, ratings. Texts name every entry of the tables in turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickwork.functions import schemes as s
from brickwork.functions.rounding import weighted_sql
from brickwork.registry import query, table


def quoted(words) -> str:
    return "[" + ", ".join("NULL" if w is None else "'" + w.replace("'", "''") + "'" for w in words) + "]"


def pick(words, key):
    """The word in turn for each row, in Spark; ``pick_sql`` gives the same."""
    return F.element_at(F.array(*[F.lit(w).cast("string") for w in words]), (key % len(words) + 1).cast("int"))


def pick_sql(words, key: str) -> str:
    return f"list_extract({quoted(words)}, ({key}) % {len(words)} + 1)"


def has_sql(text: str, words) -> str:
    return f"coalesce(len(list_filter({quoted(words)}, lambda k: contains({text}, k))) > 0, false)"


WORDS = [w for words in s.SCHEME_KEYWORDS.values() for w in words] + s.RESIDENTIAL_KEYWORDS + ["shop front", None, ""]
WHO = [w for words in s.APPLICANT_KEYWORDS.values() for w in words]


def key():
    return F.col("p_partkey")



def _type_sql(text: str, who: str) -> str:
    tests = {k: has_sql(text, w) for k, w in s.SCHEME_KEYWORDS.items()}
    tests |= {k: f"({tests.get(k, 'false')} OR {has_sql(who, w)})" for k, w in s.APPLICANT_KEYWORDS.items()}
    kinds = "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{k}' END" for k, t in tests.items()) + "], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({kinds}) > 1 THEN 'Mixed' WHEN len({kinds}) = 1 THEN {kinds}[1] WHEN {has_sql(text, s.RESIDENTIAL_KEYWORDS)} THEN 'Residential' ELSE 'Unknown' END"


_APPLICANT = f"CASE WHEN p_partkey % 3 = 0 THEN concat('New ', upper({pick_sql(WHO, 'p_partkey // 3')}), ' Ltd') WHEN p_partkey % 3 = 1 THEN 'J Smith' END"
_AGENT = f"CASE WHEN p_partkey % 13 = 5 THEN {pick_sql(WHO, 'p_partkey * 7')} ELSE '' END"


@query("classify_text", f"SELECT id, {_type_sql('t', 'who')} AS kind FROM (SELECT p_partkey AS id, lower(concat('Plans: ', {pick_sql(WORDS, 'p_partkey')}, ' and more')) AS t, lower(concat_ws(' ', {_APPLICANT}, {_AGENT})) AS who FROM part) x")
def classify_text(spark, d):
    applicant = F.when(key() % 3 == 0, F.concat(F.lit("New "), F.upper(pick(WHO, F.floor(key() / 3))), F.lit(" Ltd"))).when(key() % 3 == 1, "J Smith")
    agent = F.when(key() % 13 == 5, pick(WHO, key() * 7)).otherwise("")
    text = F.concat(F.lit("Plans: "), F.coalesce(pick(WORDS, key()), F.lit("")), F.lit(" and more"))
    return table(spark, d, "part").select(key().alias("id"), s.scheme_type(text, applicant, agent).alias("kind"))


COUNTED = [
    "Circa {n} residential units", "a maximum of {n} dwellings", "{n} no. two-bedroom residential apartments", "50no. 2-storey dwellinghouses", "Erection of {n} buildings",
    "{n} x 2 bed", "comprising {n} studios", "for up to {n} homes", "{n}-unit scheme", "permission for {n} residential", "{n}two bed", "60,000 homes comprising {n} blocks",
    "1,{n} flats", "0 dwellings, approx. {n} homes", "99999999999 units for {n} houses", "shop front", None,
]


def _number_sql(pattern: str) -> str:
    value = f"TRY_CAST(replace(nullif(regexp_extract(t, '{pattern}', 1), ''), ',', '') AS INTEGER)"
    return f"CASE WHEN {value} BETWEEN 1 AND 50000 THEN {value} END"


@query("unit_count", f"SELECT id, coalesce({', '.join(map(_number_sql, s.UNIT_COUNT_PATTERNS))}) AS units FROM (SELECT p_partkey AS id, replace({pick_sql(COUNTED, 'p_partkey')}, '{{n}}', CAST(p_size AS VARCHAR)) AS t FROM part) x")
def unit_count(spark, d):
    text = F.replace(pick(COUNTED, key()), F.lit("{n}"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select(key().alias("id"), s.unit_count(text).alias("units"))


CODES = [*s.CPV_TYPES, *([None] * 60)]
TENDERS = [w for words, _ in s.TENDER_KEYWORDS for w in words] + [w for words in s.SCHEME_KEYWORDS.values() for w in words] + ["new homes", "stationery"]
_WORD_TYPE = "CASE " + " ".join(f"WHEN {has_sql('t', w)} THEN '{k}'" for w, k in s.TENDER_KEYWORDS) + " ELSE 'Managed Scheme' END"
_CPV = f"map({quoted(s.CPV_TYPES)}, {quoted(s.CPV_TYPES.values())})"


@query("classify_contract", f"SELECT id, coalesce(CASE WHEN code IS NOT NULL THEN {_CPV}[code] END, CASE WHEN kind NOT IN ('Unknown', 'Residential') THEN kind END, {_WORD_TYPE}) AS kind FROM (SELECT *, {_type_sql('t', 'NULL')} AS kind FROM (SELECT p_partkey AS id, {pick_sql(CODES, 'p_partkey')} AS code, lower(concat('Tender for ', {pick_sql(TENDERS, 'p_partkey')}, '.')) AS t FROM part) x) y")
def classify_contract(spark, d):
    text = F.concat(F.lit("Tender for "), pick(TENDERS, key()), F.lit("."))
    codes = F.array(F.lit("99999999"), pick(CODES, key()), F.lit("00000000"))
    return table(spark, d, "part").select(key().alias("id"), s.contract_type(codes, text).alias("kind"))


PHRASES = [w for words in s.CONTRACT_KEYWORDS.values() for w in words] + [None, "nothing"]
_HITS = [f"len(list_filter({quoted([w.lower() for w in words])}, lambda k: contains(t, k)))" for words in s.CONTRACT_KEYWORDS.values()]
_BEST = f"greatest({', '.join(_HITS)})"


@query("argmax_keywords", f"SELECT id, CASE WHEN {_BEST} = 0 THEN NULL {' '.join(f'''WHEN {h} = {_BEST} THEN '{k}' ''' for k, h in zip(s.CONTRACT_KEYWORDS, _HITS))} END AS kind FROM (SELECT p_partkey AS id, lower(concat({pick_sql(PHRASES, 'p_partkey')}, ' & ', {pick_sql(PHRASES, 'p_partkey * 7 + p_size')})) AS t FROM part) x")
def argmax_keywords(spark, d):
    text = F.concat(F.coalesce(pick(PHRASES, key()), F.lit("")), F.lit(" & "), F.coalesce(pick(PHRASES, key() * 7 + F.col("p_size")), F.lit("")))
    return table(spark, d, "part").select(key().alias("id"), s.most_keywords(text).alias("kind"))


_SIC = f"map({quoted(s.SIC_SECTORS)}, {quoted(s.SIC_SECTORS.values())})"


@query("sic_sector", f"SELECT p_partkey, coalesce({_SIC}[lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0')], {_SIC}[lpad(CAST(p_size AS VARCHAR), 2, '0')]) AS sector FROM part")
def sic_sector(spark, d):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    codes = F.array(F.concat(F.lit(" "), two(key() % 100), F.lit("110")), F.concat(two(F.col("p_size")), F.lit("990")))
    return table(spark, d, "part").select("p_partkey", s.sic_sector(codes).alias("sector"))


@query(
    "perf_rating",
    "SELECT p_partkey, round_even(list_avg(list_filter([CASE WHEN e AND a + c + x > 0 THEN (100 * a + 70 * c + 50 * x) / (a + c + x) END, (CASE WHEN r > 0 THEN 20 ELSE 0 END + CASE WHEN e THEN 20 ELSE 0 END + 15 + CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 15 END + CASE WHEN a <> 0 THEN 15 ELSE 0 END + CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE 15 END)::DOUBLE, "
    "CASE WHEN f > 0 THEN f * 100 END], lambda v: v IS NOT NULL)), 1) AS rating FROM (SELECT p_partkey, p_partkey % 4 <> 0 AS e, p_size % 5 AS a, p_size % 3 AS c, p_size % 2 AS x, p_partkey % 3 AS r, (p_size % 4) / 4.0::DOUBLE AS f FROM part) y",
)
def perf_rating(spark, d):
    size = F.col("p_size")
    epc = F.when(key() % 4 != 0, F.create_map(F.lit("A"), size % 5, F.lit("C"), size % 3, F.lit("?"), size % 2))
    day, missing = F.lit("2026-01-01").cast("date"), F.lit(None).cast("date")
    code = F.when(key() % 6 == 0, "").otherwise("LS1 4BD")
    rating = s.performance_rating(epc, key() % 3, day, F.when(key() % 5 == 0, missing).otherwise(day), size % 5, code, (size % 4) / F.lit(4.0))
    return table(spark, d, "part").select("p_partkey", rating.alias("rating"))


_LEGACY_PARTS = {
    "contract_proximity": "CASE WHEN p_partkey % 7 = 0 THEN 30 WHEN m <= 6 THEN 100 WHEN m <= 12 THEN 80 WHEN m <= 24 THEN 50 ELSE 20 END",
    "performance_gap": "CASE WHEN p_partkey % 5 = 0 THEN 50 ELSE 100 - p_size END",
    "market_opportunity": "CASE WHEN p_partkey % 4 = 0 THEN 50 ELSE 100 - p_size END",
    "relationship_strength": "CASE WHEN p_partkey % 3 = 0 THEN 50 ELSE p_size * 2 END",
    "scheme_size": "CASE WHEN p_size * 13 > 500 THEN 100 WHEN p_size * 13 > 200 THEN 70 WHEN p_size * 13 > 100 THEN 50 ELSE 30 END",
}


@query(
    "score_legacy",
    f"SELECT p_partkey, score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'low' END AS priority FROM (SELECT p_partkey, {weighted_sql(s.LEGACY_WEIGHTS, _LEGACY_PARTS)} AS score FROM (SELECT *, (p_partkey % 800) / 30.0 AS m FROM part) y) x",
)
def score_legacy(spark, d):
    size, as_of = F.col("p_size"), F.lit("2026-01-01").cast("date")
    ends = F.when(key() % 7 != 0, F.date_add(as_of, (key() % 800).cast("int")))
    parts = s.legacy_breakdown(as_of, ends, F.when(key() % 5 != 0, size), F.when(key() % 4 != 0, size), F.when(key() % 3 != 0, size * 2), size * 13)
    x = table(spark, d, "part").select("p_partkey", s.legacy_score(parts).alias("score"))
    return x.select("p_partkey", "score", s.legacy_priority(F.col("score")).alias("priority"))
