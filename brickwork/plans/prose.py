"""Queries of periods, prose, names and ratings. Texts come in turn from lists of cases with what they must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickwork.functions import names as n
from brickwork.functions import periods, prose, ratings
from brickwork.functions.similarity import token_sort_ratio
from brickwork.plans.pipelines import _code
from brickwork.plans.schemes import has_sql, key, pick, pick_sql, quoted
from brickwork.plans.text import SQUEEZE
from brickwork.registry import query, table

#: How the texts of contracts name their days: {a} ISO, {b} 400 days later, {A} and {B} in words, {N} the later one in numbers, {M} its month.
CONTRACTS = [
    ("contract period: {a} to {b}", "a", "a + 400"),
    ("for a period of 2 years commencing {a}", "a", "a + to_months(24)"),
    ("starts {a}", "a", "NULL"),
    ("from {A} to {N} with an option to extend for 2 years", "a", "a + 400"),
    ("Start date: {A}; expiry date: {M}.", "a", "date_trunc('month', a + 400)"),
    ("Signed {N}, renewed {a}", "a", "a + 400"),
    ("beginning {a} for 18 months", "a", "a + to_months(18)"),
    ("Start date: {a}. A 5+2 year term", "a", "a + to_months(84)"),
    ("{A} until {B}, plus 1 year", "a", "a + 400"),
    ("ending {B}. Initial term of 3 years", "a + 400", "(a + 400) + to_months(36)"),
    ("no day", "NULL", "NULL"),
    ("", "NULL", "NULL"),
]


def _contract_text(number, day):
    later = F.date_add(day, 400)
    text = F.element_at(F.array(*[F.lit(t) for t, _, _ in CONTRACTS]), (number % len(CONTRACTS) + 1).cast("int"))
    for mark, form, value in (("{a}", "yyyy-MM-dd", day), ("{b}", "yyyy-MM-dd", later), ("{A}", "d MMMM yyyy", day), ("{B}", "d MMM yyyy", later), ("{N}", "dd/MM/yyyy", later), ("{M}", "MMMM yyyy", later)):
        text = F.replace(text, F.lit(mark), F.date_format(value, form))
    return text


_CASES = lambda part: "CASE o_orderkey % " + str(len(CONTRACTS)) + " " + " ".join(f"WHEN {k} THEN CAST({c[part]} AS DATE)" for k, c in enumerate(CONTRACTS)) + " END"


@query("contract_dates", f"SELECT o_orderkey, {_CASES(1)} AS starts, {_CASES(2)} AS ends FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a FROM orders) x")
def contract_dates(spark, d):
    """Start and end by labels, labelled periods, ranges, starts with terms, or the first two days."""
    found = periods.contract_period(_contract_text(F.col("o_orderkey"), F.to_date("o_orderdate")))
    return table(spark, d, "orders").select("o_orderkey", found.alias("found")).select("o_orderkey", "found.*")


@query(
    "date_scan",
    "WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a FROM orders), t AS (SELECT *, concat('See ', strftime(a, '%Y-%m-%d'), ', then ', strftime(a, '%-d %B %Y'), ' and ') AS start FROM x) "
    "SELECT o_orderkey, 4 AS position, a AS day FROM t UNION ALL SELECT o_orderkey, 21, a FROM t UNION ALL SELECT o_orderkey, length(start), a FROM t UNION ALL SELECT o_orderkey, length(start) + 10 + 20, CAST(date_trunc('month', a) AS DATE) FROM t",
)
def date_scan(spark, d):
    """All days of a text with their places; what is no day of the calendar gives none."""
    day = F.to_date("o_orderdate")
    text = F.concat(F.lit("See "), F.date_format(day, "yyyy-MM-dd"), F.lit(", then "), F.date_format(day, "d MMMM yyyy"), F.lit(" and "), F.date_format(day, "dd/MM/yyyy"), F.lit("; 31 February 2024, "), F.date_format(day, "MMMM yyyy"))
    return table(spark, d, "orders").select("o_orderkey", F.inline(periods.days_in(text)))


#: Marks in the cases' texts and answers, and what columns put there: a name as such, capitalised, a year, a number, a code with and without its space.
MARKS = {"{n}": "p_name", "{N}": "concat(upper(substr(p_name, 1, 1)), substr(p_name, 2))", "{y}": "CAST(2000 + p_partkey % 25 AS VARCHAR(9))", "{k}": "CAST(p_partkey AS VARCHAR(19))", "{c}": _code("p_partkey", "p_size"), "{s}": f"replace({_code('p_partkey', 'p_size')}, ' ', '')"}


def _marked(text: str) -> str:
    for mark, value in MARKS.items():
        text = f"replace({text}, '{mark}', {value})"
    return text


def golden(name: str, cases: list[tuple], expression, kind: str = "VARCHAR", before: str = "") -> None:
    """Register an expression over the cases' texts, given to the parts in turn and filled from their columns, with what they must give as SQL."""
    texts, wanted = [None if c[0] is None else before + c[0] for c in cases], [None if c[1] is None else str(c[1]) for c in cases]

    @query(name, f"SELECT p_partkey AS id, CAST({_marked(pick_sql(wanted, 'p_partkey'))} AS {kind}) AS found FROM part")
    def run(spark, d):
        made = table(spark, d, "part").withColumn("text", pick(texts, key())).withColumn("text", F.expr(_marked("text")))
        return made.select(key().alias("id"), expression(F.col("text")).alias("found"))


LOT = "Lot {k} of {y}, {n}: "
golden("named_operator", [
    ("The work was awarded to {N} Homes Ltd, which starts in May {y}", "{N} Homes Ltd"),
    ("a contract with Vale & {N} Housing Association for {k} repairs", "Vale & {N} Housing Association"),
    ("The block is managed by the council of {N}", None),
    ("Homes managed by {N} Living Limited.", "{N} Living Limited"),
    ("the provider will be {N} Services", "{N} Services"),
    ("Incumbent: {N} Trust", "{N} Trust"),
    ("delivered by suitably qualified Services", None),
    ("no company in {n}", None), ("", None), (None, None),
], prose.named_operator, before=LOT)
golden("named_manager", [
    ("The asset manager is {N} Capital.", "{N} Capital"), ("Fund manager: {N} Lane Partners", "{N} Lane Partners"),
    ("asset management by {N} REIT", "{N} REIT"), ("a manager is sought for {N}", None), ("", None), (None, None),
], prose.named_manager, before=LOT)
golden("company_valid", [
    ("{N} Homes Ltd", True), ("{y}/0{k}/PA", False), ("www.{n}.uk", False), ("the provider of {N}", False), ("Required {N} Homes", False), ("{n}", False),
    ("12", False), ("1234 5678 A", False), ("A1 {N}", True), ("Watch this notice", False), ("x" * 121, False), ("", False), (None, False), (" Åse {N} ", True),
], prose.valid_company, "BOOLEAN")
golden("title_relevant", [("Fund Manager", True), ("Fund manager, {n}", False), ("Head of Living, {N}", True), ("COO", True), ("Site Engineer {k}", False), ("{N} Sales Director", True), ("", False), (None, False)], prose.relevant_title, "BOOLEAN")
golden("area_key", [("Bristol, City of", "bristol"), ("St. Helens", "st helens"), ("The {N}", "{n}"), (" City of  {N} ", "{n}"), ("{N}-on-Trent {k}", "{n} on trent"), ("", ""), (None, "")], prose.area_name)
golden("postcode_norm", [("{s}", "{c}"), (" {c} ", "{c}"), ("LS14", "LS14"), ("n1", "N1"), ("", ""), (None, None)], lambda c: n.spaced_postcode(c, 5))


NAMES = ["Red Homes Limited", "The Blue Housing Group (UK) Ltd", "London Borough of Ash Council", "Ash LLP INC", "Holdings of the City & Co. Limited", "Vale  Ltd LLC", "", None]


def _variant_sql(how: str, words: list[str]) -> str:
    squeezed, text = SQUEEZE, "lower(x)"
    if how == "end":
        text = "upper(trim(x))"
        for w in words:
            text = f"regexp_replace({text}, '{w}$', '')"
        return squeezed.format(f"regexp_replace({text}, '[^A-Z0-9 ]', '', 'g')")
    if how == "lower":
        return text
    if how == "signs":
        return "regexp_replace(lower(coalesce(x, '')), '[^a-z0-9]+', '', 'g')"
    if how == "words":
        spaced = "regexp_replace(lower(coalesce(x, '')), '[^a-z0-9 ]', ' ', 'g')"
        return squeezed.format(f"regexp_replace({spaced}, '\\b({'|'.join(words)})\\b', ' ', 'g')")
    text = "lower(trim(x))"
    for w in words:
        text = f"replace({text}, '{w}', '')"
    if how == "anywhere, signs stay":
        return squeezed.format(text)
    return squeezed.format(f"regexp_replace({text}, '[^a-z0-9\\s]', '', 'g')") if how == "anywhere" else f"trim(regexp_replace({text}, '[^a-z0-9 ]', '', 'g'))"


@query("name_variants", f"SELECT id, {', '.join(f'{_variant_sql(*v)} AS {k}' for k, v in n.NAME_VARIANTS.items())} FROM (SELECT p_partkey AS id, {pick_sql(NAMES, 'p_partkey')} AS x FROM part) y")
def name_variants(spark, d):
    x = table(spark, d, "part").select(key().alias("id"), pick(NAMES, key()).alias("x"))
    return x.select("id", *[n.name_variant(F.col("x"), v).alias(v) for v in n.NAME_VARIANTS])


@query("html_text", f"SELECT page_id, {SQUEEZE.format('''regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]*>', ' ', 'g')''')} AS text FROM pages")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", n.visible_text(F.col("html")).alias("text"))


#: Arrays of certificates, with how many count, the most frequent, the mean, and whether it is poor.
CERTIFICATES = [(["A", "b ", "B"], 3, "B", 6.3, False), (["G", "F", None, "?"], 2, "G", 1.5, True), (["d", "C"], 2, "D", 4.5, False), (["E", "D", "E", "D"], 4, "E", 3.5, True), (["x"], None, None, None, False), ([], None, None, None, False), (None, None, None, None, False)]


def _listed(column: int, kind: str) -> str:
    return f"CAST({pick_sql([None if c[column] is None else str(c[column]) for c in CERTIFICATES], 'p_partkey')} AS {kind})"


@query("epc_analysis", f"SELECT p_partkey, {_listed(1, 'INTEGER')} IS NOT NULL AS available, {_listed(1, 'INTEGER')} AS assessed, {_listed(2, 'VARCHAR')} AS predominant, {_listed(3, 'DOUBLE')} AS average, {_listed(4, 'BOOLEAN')} AS needs_improvement FROM part")
def epc_analysis(spark, d):
    lists = F.array(*[F.lit(None).cast("array<string>") if c[0] is None else F.array(*[F.lit(x).cast("string") for x in c[0]]).cast("array<string>") for c in CERTIFICATES])
    found = ratings.certificates(F.element_at(lists, (key() % len(CERTIFICATES) + 1).cast("int")))
    return table(spark, d, "part").select("p_partkey", found.alias("found")).select("p_partkey", "found.*")


_LOCK = "CASE p_partkey % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'epc' WHEN 2 THEN 'ai' END"
_SHARE = f"CASE {_LOCK} WHEN 'manual' THEN 1.0::DOUBLE / 7 WHEN 'epc' THEN 1.0::DOUBLE / 7 * 0.8::DOUBLE ELSE 1.0::DOUBLE / 7 * 0.4::DOUBLE END"


@query("lock_confidence", f"SELECT p_partkey, round_even(CASE WHEN p_size % 2 = 0 THEN {_SHARE} ELSE 0 END + {_SHARE} + CASE WHEN p_size % 3 = 0 THEN {_SHARE} ELSE 0 END + 1.0::DOUBLE / 7 * 0.4::DOUBLE, 3) AS confidence FROM part")
def lock_confidence(spark, d):
    """Seven protected fields, of which three are locked by a source in turn, one is filled without a lock and three are empty."""
    size, lock = F.col("p_size"), F.get(F.array(F.lit("manual"), F.lit("epc"), F.lit("ai"), F.lit(None)), (key() % 4).cast("int"))
    fields = {"owner": F.when(size % 2 == 0, size), "operator": size, "units": F.when(size % 3 == 0, size), "postcode": size, "type": F.lit(None), "starts": F.lit(None), "ends": F.lit(None)}
    locks = F.create_map(F.lit("owner"), lock, F.lit("operator"), lock, F.lit("units"), lock)
    return table(spark, d, "part").select("p_partkey", ratings.lock_confidence(fields, locks).alias("confidence"))


#: A field, a value, and the normal value, null where the value is an error.
FIELDS = [
    ("num_units", " 120 ", "120"), ("num_units", "0", None), ("num_units", "many", None), ("postcode", "ls14bd", "LS1 4BD"), ("postcode", "LS1", None),
    ("status", "planned", "planned"), ("status", "gone", None), ("contract_end_date", "2026-02-28T00:00", "2026-02-28"), ("contract_end_date", "2026-02-30", None),
    ("owner_company_id", "17", "17"), ("owner_company_id", "x", None), ("performance_rating", "99.5", "99.5"), ("performance_rating", "101", None), ("name", "Any", "Any"),
    ("scheme_type", "BTR", "BTR"), ("scheme_type", "Castle", None),
]
_FIELD, _VALUE = pick_sql([f for f, _, _ in FIELDS], "p_partkey"), pick_sql([v for _, _, v in FIELDS], "p_partkey")


@query("field_checks", f"SELECT p_partkey, {_FIELD} AS field, {_VALUE} AS value, {_VALUE} IS NULL AS refused FROM part")
def field_checks(spark, d):
    x = table(spark, d, "part").select("p_partkey", pick([f for f, _, _ in FIELDS], key()).alias("field"), pick([v for _, v, _ in FIELDS], key()).alias("raw"))
    checked = F.coalesce(*[F.when(F.col("field") == f, ratings.checked_field(f, F.col("raw"))) for f in dict.fromkeys(f for f, _, _ in FIELDS)])
    return x.select("p_partkey", "field", checked.alias("c")).select("p_partkey", "field", "c.value", F.col("c.error").isNotNull().alias("refused"))


OWNERS = [*ratings.SELF_MANAGED, *ratings.NEVER_OPERATORS, *ratings.BRAND_OPERATORS, "nobody", None]
_OWNER = f"concat(' ', lower(coalesce({pick_sql(OWNERS, 'p_partkey')}, '')), '  ')"
_MANAGED = f"({has_sql('o', ratings.SELF_MANAGED)} OR p_partkey % 9 = 0)"
_BRAND = "CASE " + " ".join(f"WHEN contains(o, {quoted([k])[1:-1]}) THEN {quoted([v])[1:-1]}" for k, v in ratings.BRAND_OPERATORS.items()) + " END"


@query("self_operated", f"SELECT p_partkey, CASE WHEN {has_sql('o', ratings.NEVER_OPERATORS)} THEN NULL WHEN {_MANAGED} THEN 'self-managed' WHEN {has_sql('o', ratings.BRAND_OPERATORS)} THEN 'brand owner' END AS rule, {_BRAND} AS brand FROM (SELECT p_partkey, {_OWNER} AS o FROM part) x")
def self_operated(spark, d):
    owner = F.concat(F.coalesce(pick(OWNERS, key()), F.lit("")), F.lit(" "))
    return table(spark, d, "part").select("p_partkey", ratings.self_operated(owner, F.when(key() % 9 == 0, "MUTUAL SOCIETY")).alias("rule"), ratings.brand_operator(owner).alias("brand"))


CODES = [*[c + "000" for c in ratings.CODE_DURATIONS], *([None] * 30)]
WORDINGS = [*[w for w, _, _ in ratings.WORD_DURATIONS], "stationery", None]
_MONTHS = [f"map({quoted(ratings.CODE_DURATIONS)}, {[v[k] if k == 0 else v[k] for v in ratings.CODE_DURATIONS.values()]})[left(code, 5)]" for k in (0, 1)]
_WORD = lambda k: "CASE " + " ".join(f"WHEN contains(t, '{e[0]}') THEN {e[k] if k == 1 else repr(e[k])}" for e in ratings.WORD_DURATIONS) + " END"


@query("typical_duration", f"SELECT o_orderkey, coalesce(CASE WHEN code IS NOT NULL THEN {_MONTHS[0]} END, {_WORD(1)}) AS months, coalesce(CASE WHEN code IS NOT NULL THEN {_MONTHS[1]} END, {_WORD(2)}) AS category, CAST(a + to_months(coalesce(CASE WHEN code IS NOT NULL THEN {_MONTHS[0]} END, {_WORD(1)})) AS DATE) AS ends FROM (SELECT o_orderkey, {pick_sql(CODES, 'o_orderkey')} AS code, coalesce({pick_sql(WORDINGS, 'o_orderkey * 7 + 3')}, '') AS t, CAST(o_orderdate AS DATE) AS a FROM orders) x")
def typical_duration(spark, d):
    """The end that a contract of this code or wording would have, counted from the first start that is known."""
    o = F.col("o_orderkey")
    found = ratings.typical_duration(F.array(F.lit("00000000"), pick(CODES, o)), F.initcap(F.coalesce(pick(WORDINGS, o * 7 + 3), F.lit(""))))
    x = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("starts"), found.alias("f"))
    return x.select("o_orderkey", "f.months", "f.category", F.add_months("starts", F.col("f.months")).alias("ends"))


_COMPARED = "(SELECT l_orderkey, l_partkey AS id, concat('Scheme ', l_partkey) AS name, CAST(max(l_quantity) AS INTEGER) AS score, CASE l_partkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'low' ELSE 'minimal' END AS risk FROM {lineitem} GROUP BY l_orderkey, l_partkey)"


@query(
    "scheme_comparison",
    "SELECT l_orderkey, concat('Compared ', n, ' schemes. Highest BD score: ', best, ' (', score, ').', CASE WHEN k > 0 THEN concat(' ', k, ' scheme(s) with critical/high contract risk: ', risky, '.') ELSE '' END) AS summary FROM (SELECT l_orderkey, count(*) AS n, first(name ORDER BY score DESC, id) AS best, max(score) AS score, count(*) FILTER (WHERE risk IN ('critical', 'high')) AS k, "
    f"string_agg(name, ', ' ORDER BY score DESC, id) FILTER (WHERE risk IN ('critical', 'high')) AS risky FROM {_COMPARED.replace('{lineitem}', 'lineitem')} x GROUP BY 1) y",
)
def scheme_comparison(spark, d):
    """The schemes of an order stand for those that someone compares: at most seven."""
    return ratings.comparisons(spark.sql(f"SELECT * FROM {_COMPARED} x", lineitem=table(spark, d, "lineitem")), "l_orderkey")


@query("address_match")
def address_match(spark, d):
    """Two addresses of a customer: similarity, weighed with the postcode where both have one, and a band of confidence."""
    c = F.col("c_custkey")
    one = F.concat(c % 90, F.lit(" High Street, Leeds LS1 "), c % 10, F.lit("AB"))
    other = F.when(c % 5 == 0, F.concat(c % 90, F.lit(" High St, Leeds"))).otherwise(F.concat(F.lit("Leeds, "), c % 88, F.lit(" High St LS1 "), c % 7, F.lit("AB")))
    x = table(spark, d, "customer").select("c_custkey", one.alias("a"), other.alias("b"))
    x = x.select("*", n.postcode(F.col("a")).alias("pa"), n.postcode(F.col("b")).alias("pb"), (token_sort_ratio(n.address(F.col("a")), n.address(F.col("b"))) / 100.0).alias("similarity"))
    same = F.coalesce(F.col("pa") == F.col("pb"), F.lit(False))
    overall = F.when(F.col("pa").isNotNull() & F.col("pb").isNotNull(), F.lit(0.4) * same.cast("double") + F.lit(0.6) * F.col("similarity")).otherwise(F.col("similarity"))
    x = x.select("c_custkey", "similarity", same.alias("postcode_match"), F.round(overall, 3).alias("overall"))
    band = F.when(F.col("overall") >= 0.95, "high").when(F.col("overall") >= 0.8, "medium").when(F.col("overall") >= 0.65, "low").otherwise("none")
    return x.select("*", (F.col("overall") >= 0.8).alias("is_match"), band.alias("confidence"))
