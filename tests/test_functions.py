"""Extractors, ratings and attribution on rows written by hand and against plain Python."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from brickwork import registry
from brickwork.functions import periods, prose, ratings
from brickwork.functions import schemes as rules
from brickwork.functions.similarity import indel_ratio, sorted_tokens
from brickwork.operators import attribution, changes

SF = "/root/testdata/sf0.001"
day = dt.date


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


PERIODS = [
    ("from 1st April 2024 to 31st March 2029", day(2024, 4, 1), day(2029, 3, 31)),
    ("Commencement date: 02/12/2024, termination date: 01-12-2027.", day(2024, 12, 2), day(2027, 12, 1)),
    ("Contract period: Sept 2024 - May 2026.", day(2024, 9, 1), day(2026, 5, 1)),
    ("running from 2024-01-31 until 2025-01-30, with extras", day(2024, 1, 31), day(2025, 1, 30)),
    ("starting 29 February 2024 for 1 year", day(2024, 2, 29), day(2025, 2, 28)),
    ("start date: 2024-02-30, signed 03/04/2024", day(2024, 4, 3), None),
    ("5 May 2025 and 4 May 2023 and 3 May 2021", day(2023, 5, 4), day(2025, 5, 5)),
    ("signed 1 May 2024, for a period of 18 months with option to extend for 6 months", day(2024, 5, 1), day(2026, 5, 1)),
    ("from 1 May 2024 for 99999999999 years", day(2024, 5, 1), None),
    ("nothing", None, None),
    ("", None, None),
    (None, None, None),
]


def test_contract_periods(spark):
    got = column(spark, [t for t, _, _ in PERIODS], periods.contract_period)
    assert [(r.starts, r.ends) for r in got] == [(a, b) for _, a, b in PERIODS]


def test_contract_months(spark):
    texts = ["3+2 yrs", "30 + 20 years", "for 36 months plus 12 months", "initial term of 5 years with an option to extend for 2 years", "a 31 year lease", "agreement for 2 years", "", None]
    assert column(spark, texts, periods.contract_months) == [60, None, 48, 84, None, 24, None, None]


def test_days_have_places(spark):
    text = "é 2024-04-01; 32 May 2024, June 2024 and 1 June 2024 x 05/06/2024"
    found = column(spark, [text, "none", "", None], periods.days_in)
    want = [(text.index("2024-04-01"), day(2024, 4, 1)), (text.index("June 2024"), day(2024, 6, 1)), (text.index("1 June"), day(2024, 6, 1)), (text.index("05/06"), day(2024, 6, 5))]
    assert [(r.position, r.day) for r in found[0]] == want
    assert found[1:] == [[], [], None]


def test_prose(spark):
    texts = ["awarded to Elm Housing Group. The work starts", "contract with Ash Homes Ltd and others for a range", "operator is a b c d e f g h i Trust", "managed by Required Services Ltd, agreement with Oak Living"]
    assert column(spark, texts, prose.named_operator) == ["Elm Housing Group", "Ash Homes Ltd", None, "Oak Living"]
    assert column(spark, ["", None, " MAIL@X "], lambda c: prose.contact_key(c, F.lit("Jo Ash"))) == ["jo ash", "jo ash", "mail@x"]
    assert sum(map(len, prose.SCOTTISH_AREAS.values())) == 33


def test_ratings(spark):
    assert column(spark, ["Ash Bank Housing", "Elm Housing", "Greystar Homes", "Elm", None], lambda c: ratings.self_operated(c, F.lit(None).cast("string"))) == [None, "self-managed", "brand owner", None, None]
    assert column(spark, ["Chapter One", "Old L&G Court", "none", None], ratings.brand_operator) == ["Chapter Living", "Legal & General Affordable Homes", None, None]
    assert column(spark, ["ls1  4bd", "L1", None], lambda c: ratings.checked_field("postcode", c)["value"]) == ["LS1 4BD", None, None]
    assert column(spark, ["5001", None], lambda c: ratings.checked_field("num_units", c)["error"].isNotNull()) == [True, False]
    empty = spark.createDataFrame([], "g int, id int, name string, score double, risk string")
    assert ratings.comparisons(empty, "g").count() == 0


def test_housing_tenders(spark):
    codes = lambda c: rules.about_housing(F.array(c), F.lit(None).cast("string"))
    assert column(spark, ["70399999", "55100000", "55199999", None], codes) == [True, True, False, False]


def test_address_match_against_plain_python(spark):
    from brickwork.functions.names import address

    rows = registry.QUERIES["address_match"](spark, SF).orderBy("c_custkey").collect()
    assert len(rows) == 150
    ones = [f"{k % 90} High Street, Leeds LS1 {k % 10}AB" for k in range(150)]
    others = [f"{k % 90} High St, Leeds" if k % 5 == 0 else f"Leeds, {k % 88} High St LS1 {k % 7}AB" for k in range(150)]
    keys = [r.c_custkey for r in rows]
    a, b = column(spark, [ones[k] for k in keys], address), column(spark, [others[k] for k in keys], address)
    for r, x, y in zip(rows, a, b):
        k, like = r.c_custkey, indel_ratio(sorted_tokens(x), sorted_tokens(y)) / 100.0
        overall = like if k % 5 == 0 else 0.4 * (k % 10 == k % 7) + 0.6 * like
        assert (r.similarity, r.overall) == (pytest.approx(like), pytest.approx(round(overall, 3)))
        assert r.confidence == ("high" if r.overall >= 0.95 else "medium" if r.overall >= 0.8 else "low" if r.overall >= 0.65 else "none")


SCHEME = "id int, name string, address string, postcode string, source string, owner int, operator int, council int"


def attributed(spark, schemes, titles=(), applications=(), companies=(), contracts=(), **options):
    make = spark.createDataFrame
    out = attribution.attribute(
        make(list(schemes), SCHEME), make(list(titles), "number string, postcode string, company int"), make(list(applications), "id int, postcode string, company int, submitted date"),
        make(list(companies), "id int, postcode string"), make(list(contracts), "id int, scheme int, client int, operator int"), **options,
    )
    return {r.id: r for r in out.collect()}


def test_attribution_order_and_nulls(spark):
    schemes = [
        (1, "A", "x LS1 1AB", None, "epc", None, None, None), (2, "B", None, "LS1 1AB", "directory", 7, 8, 3), (3, "C", None, "LS1 2AB", "epc", 5, 5, None),
        (4, "D", None, None, "epc", None, None, None), (5, "E", "", "", "epc", None, None, None), (6, "F", None, "LS1 3AB", "epc", 7, None, 3), (7, "G", None, "LS1 4AB", "epc", 7, None, 4), (8, "H", None, "LS1 5AB", "epc", None, None, None),
    ]
    got = attributed(spark, schemes, titles=[("T2", "LS1 1AB", 22), ("T1", "LS1 1AB", 21), ("T0", None, 20)], contracts=[(2, 4, None, 12), (1, 4, 11, None)])
    assert [(k, got[k].owner, got[k].owner_step, got[k].operator, got[k].operator_step, got[k].council) for k in sorted(got)] == [
        (1, 21, "title", 8, "directory", 3), (2, 7, None, 8, None, 3), (3, 5, None, 5, None, 3), (4, 11, "contract", 12, "contract", None),
        (5, None, None, None, None, None), (6, 7, None, None, None, 3), (7, 7, None, None, None, 4), (8, 7, "outward", None, None, 3),
    ]
    short = attributed(spark, schemes, titles=[("T1", "LS1 1AB", 21)], steps=attribution.SHORT)
    assert (short[1].owner, short[1].owner_step) == (7, "directory")
    assert attributed(spark, []) == {}


def test_nulls_only_decrease(spark):
    from brickwork.plans.pipelines import _sources

    before, after = _sources(spark, SF)[0], registry.QUERIES["enrich_full"](spark, SF)
    both = before.alias("a").join(after.alias("b"), "id")
    assert both.count() == before.count() == after.count()
    for field in ("owner", "operator", "council"):
        assert both.where(f"a.{field} IS NOT NULL AND NOT a.{field} <=> b.{field}").count() == 0
        assert after.where(f"{field} IS NULL").count() < before.where(f"{field} IS NULL").count()


def test_upsert_marks_changes(spark):
    state, delta = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string"), spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, v string")
    got = changes.upsert_marked(state, delta, ["k"], changes.non_null).collect()
    assert sorted((r.k, r.v, r.change) for r in got) == [(1, "a", "unchanged"), (2, "c", "changed"), (3, None, "unchanged"), (4, "d", "new")]
