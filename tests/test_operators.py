"""Operators at their boundaries, on rows written by hand."""

import datetime as dt
import difflib
import random

import pytest
from pyspark.sql import functions as F

from brickwork import registry  # noqa: F401  first, as plans import each other through it
from brickwork.functions import names, similarity
from brickwork.operators import changes, components, filling, graph, joining, ranking, scoring, similar
from brickwork.sources import files


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_company_names(spark):
    got = column(spark, ["Greystar Development Ltd", "Greystar Real Estate Partners LLC", "Greystar", "L&Q Housing", "", None], names.company_name)
    assert got == ["greystar", "greystar", "greystar", "l q housing", "", None]


def test_addresses(spark):
    got = column(spark, ["123 High Street, London SW1A 1AA", "123 High St., London, SW1A 1AA", None], names.address)
    assert got == ["123 high st london", "123 high st london", None]
    assert column(spark, ["x SW1A1AA y", "LS1  4bd", "none", None], names.postcode) == ["SW1A 1AA", "LS1 4BD", None, None]


def test_statuses(spark):
    got = column(spark, ["Invalid", "Undecided", "Not permitted", "Appeal refused", "", None, "else"], names.status)
    assert got == ["Validated", "Decided", "Approved", "Refused", "Unknown", "Unknown", "Unknown"]


def test_company_numbers(spark):
    assert column(spark, [" 123 ", "sc12", "123456789", None], names.company_number) == ["00000123", "SC12", "123456789", None]


def test_durations_and_dates(spark):
    assert column(spark, ["5+2+2 years", "30+30 years", "18 months", "31 years", "7-year", None], names.duration_months) == [108, 360, 18, None, 84, None]
    got = column(spark, ["on 2024-02-30 or 01/03/2024", "29 February 2024", "May 2027", "none"], names.any_date)
    assert got == [dt.date(2024, 3, 1), dt.date(2024, 2, 29), dt.date(2027, 5, 1), None]


def test_unit_counts(spark):
    got = column(spark, ["60,000 homes comprising 20", "1,250 dwellings", "0 flats", None], lambda c: names.first_number(c, names.UNIT_PATTERNS, 1, 50000))
    assert got == [20, 1250, None, None]


@pytest.mark.parametrize("units,score", [(None, 20), (0, 20), (49, 30), (50, 50), (99, 50), (100, 65), (200, 80), (299, 80), (300, 90), (499, 90), (500, 100)])
def test_size_steps(spark, units, score):
    assert column(spark, [units], scoring.size_score, "int") == [score]


def test_scheme_defaults_compose(spark):
    null = F.lit(None).cast("double")
    parts = {"contract_urgency": scoring.urgency_score(null), "csat_gap": scoring.rating_score(null, null), "occupancy_gap": scoring.occupancy_score(null, null), "financial_distress": scoring.distress_score(null, null)}
    assert spark.range(1).select(scoring.composite(scoring.SCHEME_WEIGHTS, parts).alias("c")).first().c == 39.2


@pytest.mark.parametrize("rating,score", [(3.4, 100), (3.5, 70), (4.0, 35), (4.5, 10), (0.0, 40)])
def test_rating_steps(spark, rating, score):
    assert column(spark, [rating], lambda c: scoring.rating_score(c, F.lit(None).cast("double")), "double") == [score]


@pytest.mark.parametrize("n,hot,warm", [(1, 1, 0), (2, 1, 1), (3, 1, 1), (9, 1, 1), (10, 1, 2), (11, 1, 2), (40, 4, 8)])
def test_tiers(spark, n, hot, warm):
    df = spark.createDataFrame([(1, i, 5.0) for i in range(n)], "k int, id int, s double")
    got = [r.tier for r in ranking.priority_tiers(df, ["k"], F.col("s"), F.col("id")).orderBy("id").collect()]
    assert (got.count("hot"), got.count("warm")) == (hot, warm) and got == sorted(got, key=["hot", "warm", "cold"].index)


def test_densest_span(spark):
    days = lambda *n: [(1, dt.date(2020, 1, 1) + dt.timedelta(days=d)) for d in n]
    run = lambda rows: [(r.starts, r.n) for r in ranking.densest_span(spark.createDataFrame(rows, "k int, day date"), ["k"], "day", 365, 5).collect()]
    assert run(days(0, 10, 20, 30, 365)) == [(dt.date(2020, 1, 1), 5)]
    assert run(days(0, 10, 20, 30, 366)) == []
    assert run(days(5, 5, 5, 5, 5)) == [(dt.date(2020, 1, 6), 5)]


def test_walk_ends_at_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 5), (3, 6), (6, 5), (7, 7)], "child long, parent long")
    got = sorted(map(tuple, graph.corporate_walk(edges, 4).collect()))
    assert got == sorted([(1, 2, 1), (2, 1, 1), (3, 4, 1), (3, 6, 1), (3, 5, 2), (3, 5, 2), (4, 5, 1), (6, 5, 1)])


def test_upserts(spark):
    schema = "id int, name string, n int"
    state, delta = spark.createDataFrame([(1, "a", 1), (2, "", 2)], schema), spark.createDataFrame([(1, "", 0), (2, "b", None), (3, "c", 3)], schema)
    run = lambda rule: sorted(map(tuple, changes.upsert(state, delta, ["id"], rule).collect()))
    assert run(changes.non_null) == [(1, "", 0), (2, "b", 2), (3, "c", 3)]
    assert run(changes.truthy) == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]
    log = sorted(map(tuple, changes.change_log(state, delta, "id", ["name", "n"]).collect()))
    assert log == [(1, "n", "1", "0"), (1, "name", "a", ""), (2, "n", "2", None), (2, "name", "", "b")]


def test_precedence(spark):
    writes = spark.createDataFrame([(1, "u", "epc", "5", 9), (1, "u", "manual", "7", 1), (1, "u", "manual", None, 10), (1, "u", "ai", "6", 20), (2, "u", "epc", "1", 1), (2, "u", "epc", "2", 2)], "id int, field string, source string, value string, seq int")
    got = sorted(map(tuple, changes.by_precedence(writes, "id", "field", "source", {"manual": 100, "epc": 60, "ai": 20}, "seq").collect()))
    assert got == [(1, "u", "7", "manual"), (2, "u", "2", "epc")]


def test_semi_on_any_keeps_duplicates(spark):
    left = spark.createDataFrame([(1, 5), (1, 5), (2, 2), (None, 3)], "a int, b int")
    right = spark.createDataFrame([(5,), (1,), (3,)], "k int")
    assert sorted(map(str, joining.semi_on_any(left, right, ["a", "b"], "k").collect())) == sorted(map(str, left.where("b <> 2").collect()))


def test_similarity(spark):
    df = spark.createDataFrame([("Unite Students Ltd", "ltd unite STUDENTS"), ("abc", "abd"), (None, "x"), ("", "")], "a string, b string")
    assert [r.s for r in df.select(similarity.token_sort_ratio("a", "b").alias("s")).collect()] == [100, 67, 0, 0]
    assert df.select(similarity.sequence_ratio("a", "b").alias("s")).collect()[1].s == difflib.SequenceMatcher(None, "abc", "abd").ratio()


def test_ratios_of_many_pairs_at_once():
    rng = random.Random(1)
    texts = ["", "a", "é漢", "z" * 62, "z" * 63, "ab" * 50] + ["".join(rng.choice("abcd é") for _ in range(rng.randrange(70))) for _ in range(60)]
    pairs = [(a, b) for a in texts for b in texts]
    assert similarity.indel_ratios(*map(list, zip(*pairs))).tolist() == [similarity.indel_ratio(a, b) for a, b in pairs]
    assert similarity.indel_ratios([], []).tolist() == []


@pytest.mark.parametrize("least, most_keys", [(70, 2000), (80, 300), (80, 1), (94, 2000), (94, 40)])
def test_similar_names_are_all_pairs(spark, least, most_keys):
    words = "unite students group homes limited greystar living property north star housing trust ab a".split()
    names = [" ".join(words[(i * k + k) % len(words)] for k in range(1, 2 + i % 4)) for i in range(60)] + ["Unite Studnets", "students, UNITE", "a", "b", "ab", "ba", "", "Greystarr Living", "greystar livin"]
    names = sorted(set(names))
    df = spark.createDataFrame([(n,) for n in [*names, names[3], None]], "name string")
    got = {(r.name, r.other_name): r.score for r in similar.similar_names(df, df, least, most_keys=most_keys).collect()}
    scores = {(a, b): similarity.indel_ratio(similarity.sorted_tokens(a), similarity.sorted_tokens(b)) for a in names for b in names}
    assert got == {p: s for p, s in scores.items() if s >= least}


def test_best_similar_is_the_best_of_all_pairs(spark):
    left = [(1, "Unite Students"), (2, "Students Unite Ltd"), (3, "Greystar Living"), (4, "zzz"), (5, None), (6, ""), (7, "Moda Living Group of Northern Homes Limited"), (8, "unite students"), (9, "North Star")]
    right = [(30, "unite student"), (20, "UNITE STUDENTS"), (25, "Students, Unite"), (40, "Greystarr Livng"), (41, "greystar livinn"), (50, "Moda Living Group of Northern Home Limited"), (60, None), (61, ""), (70, "Star Northern"), (20, "North Stars")]
    ratio = lambda a, b: similarity.indel_ratio(similarity.sorted_tokens(a), similarity.sorted_tokens(b))
    expected = set()
    for i, a in left:
        best = min(((-ratio(a, b), j) for j, b in right if a and b), default=(0, 0))
        if -best[0] >= 70:
            expected.add((i, best[1], -best[0]))
    l, r = spark.createDataFrame(left, "a long, name string"), spark.createDataFrame(right, "b long, other string")
    for options in ({}, {"step": 30}, {"most_keys": 1}):
        assert {tuple(x) for x in similar.best_similar(l, "a", "name", r, "b", "other", 70, **options).collect()} == expected


def test_equal_names_are_members_not_pairs(spark):
    rows = [(i, "Unite Students" if i % 2 else "students UNITE") for i in range(5, 45)] + [(1, "unite studentz"), (2, "other"), (3, None)]
    pairs, members = similar.duplicate_names(spark.createDataFrame(rows, "id long, name string"), "id", "name", 90)
    assert [tuple(p) for p in pairs.collect()] == [(1, 5, 93)]
    assert {r.id: r.representative for r in members.collect()} == {i: 5 for i in range(5, 45)} | {1: 1, 2: 2}


def test_keys_of_names_are_not_sent_to_the_driver(spark):
    """Spark takes the keys of a name for as small as the name."""
    df = spark.createDataFrame([(i, f"Customer#{i:09d}") for i in range(300)], "id long, name string")
    pairs, _ = similar.duplicate_names(df, "id", "name", 94)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key" in plan and "BroadcastHashJoin" not in plan
    texts = [f"{i:09d} customer" for i in range(300)]
    expected = {(i, j, s) for i in range(300) for j in range(i + 1, 300) if (s := similarity.indel_ratio(texts[i], texts[j])) >= 94}
    assert sorted(map(tuple, pairs.collect())) == sorted(expected)


def test_keys_are_listed_for_lengths_that_are_there(spark):
    texts = spark.createDataFrame([(0, "000012345 customer", 18)], "item long, text string, n int")
    listed = lambda lengths: sorted(r.key for r in similar._listed(texts, 94, 30, lengths, True).collect())
    assert listed([18]) == sorted("018018" + t for t in {texts.first().text[:i] + texts.first().text[i + 1 :] for i in range(18)})
    assert listed([19]) == ["018019000012345 customer"] and listed([15, 21]) == []


@pytest.mark.parametrize("most_keys", [2000, 1])
def test_duplicates_of_other_lengths_in_either_order(spark, most_keys):
    rows = [(1, "greystar living homes"), (2, "greystar livin homes"), (3, "greystar livin homess"), (4, "greysta livin homes"), (9, "grestar living homes"), (5, "greystar living homes")]
    pairs, _ = similar.duplicate_names(spark.createDataFrame(rows, "id long, name string"), "id", "name", 90, most_keys=most_keys)
    ratio = lambda a, b: similarity.indel_ratio(similarity.sorted_tokens(a), similarity.sorted_tokens(b))
    assert sorted(map(tuple, pairs.collect())) == sorted((i, j, ratio(a, b)) for i, a in rows for j, b in rows if i < j and i != 5 and j != 5 and ratio(a, b) >= 90)


def test_duplicates_of_one_id_with_several_names(spark):
    rows = [(1, "unite students"), (1, "unite student"), (2, "unite studentz"), (2, "unite studenta")]
    pairs, _ = similar.duplicate_names(spark.createDataFrame(rows, "id long, name string"), "id", "name", 90)
    assert sorted(map(tuple, pairs.collect())) == [(1, 2, 93), (1, 2, 93), (1, 2, 96), (1, 2, 96)]


@pytest.mark.parametrize("least", [50, 70, 81])
def test_best_ratios_are_the_best_of_all_pairs(least, monkeypatch):
    rng = random.Random(least)
    for letters, most in (("ab", 50), ("abcdé 漢", 1_000_000), ("0123456789", 1_000_000)):
        monkeypatch.setattr(similarity, "MOST_NODES", most)
        some = lambda count, ends: [t for _ in range(count) if (t := "".join(rng.choice(letters) for _ in range(rng.randrange(14))) + rng.choice(ends))]
        right = sorted(set(some(80, ["", " customer", "supplier", "z" * 60])), key=lambda t: t[::-1])
        left = some(40, ["", " customer"]) + right[:5] + ["q" * 62, "ab" * 31]
        left = [t for t in left if len(t) <= 62]
        scores = [similarity.indel_ratios([a] * len(right), right) for a in left]
        expected = [(int(s.argmax()), int(s.max())) if s.max() >= least else (-1, 0) for s in scores]
        assert list(zip(*(x.tolist() for x in similarity.best_ratios(left, right, least)))) == expected
    assert similarity.best_ratios([], ["a"], 70)[0].tolist() == [] and similarity.best_ratios(["a"], [], 70)[0].tolist() == [-1]


def test_best_search_compares_few_letters(monkeypatch):
    """Of 500 x 4,000 names, which have over 8 million pairs' letters to compare, few branches are followed."""
    met, count = [], similarity.np.bitwise_count
    monkeypatch.setattr(similarity.np, "bitwise_count", lambda x: met.append(len(x)) or count(x))
    right = [f"{i} customer" for i in range(1, 2001)] + [f"{i:09d} supplier" for i in range(2000)]
    left = [f"{i:09d} customer" for i in range(50_000, 50_500)]
    place, score = similarity.best_ratios(left, right, 80)
    assert (place >= 0).all() and sum(met) < 500 * 4000 / 2
    for k in range(0, 500, 50):
        every = similarity.indel_ratios([left[k]] * len(right), right)
        assert (place[k], score[k]) == (every.argmax(), every.max())


def test_best_similar_over_several_blocks(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde1") for _ in range(rng.randrange(2, 8)))
    left = [(i, " ".join(word() for _ in range(rng.randrange(1, 5)))) for i in range(120)] + [(500, "long " * 14 + "name")]
    right = [(rng.randrange(60), " ".join(word() for _ in range(rng.randrange(1, 5)))) for _ in range(150)] + [(70, "long " * 13 + "name"), (None, "abcde abcde"), (61, "x" * 80)]
    l, r = spark.createDataFrame(left, "id long, text string"), spark.createDataFrame(right, "right_id long, other string")
    texts = [(similarity.sorted_tokens(t), j) for j, t in right]
    got = {x[0]: tuple(x)[1:] for x in similar.best_similar(l, "id", "text", r, "right_id", "other", 60, most_keys=50).collect()}
    for i, t in left:
        best = min((-similarity.indel_ratio(similarity.sorted_tokens(t), o), 1e9 if j is None else j) for o, j in texts)
        assert got.get(i) == ((None if best[1] == 1e9 else best[1], -best[0]) if -best[0] >= 60 else None)
    known = r.groupBy("other").min("right_id").toDF("other", "right_id")
    blocks = similar._best_in_blocks(l.where("id < 500").select("text").distinct(), known, 60, most_left=30, most_right=40)
    best = {}
    ids = {x.other: x.right_id for x in known.collect()}
    for x in blocks.collect():
        best[x.text] = max(best.get(x.text, (0, 0)), (x.score, -(1e9 if ids[x.other] is None else ids[x.other])))
    for _, t in left[:-1]:
        every = max((similarity.indel_ratio(t, o), -(1e9 if j is None else j)) for o, j in ids.items())
        assert best.get(t, (0, 0))[0] == (every[0] if every[0] >= 60 else 0) and (t not in best or best[t] == every)


def test_titles_stop_at_the_first_empty_slot(spark):
    df = spark.createDataFrame([("T1", "", "a", "", "c", ""), ("T2", "", "", "b", "", ""), ("", "", "a", "b", "", "")], ["Title Number", "Postcode", *[f"Proprietor Name ({k})" for k in range(1, 5)]])
    assert [(r.title_number, len(r.proprietors)) for r in files.titles(df).collect()] == [("T1", 1)]


def test_rule_tables_on_hand_written_rows(spark):
    """Golden rows: (description, applicant, agent) -> scheme type; description -> number of homes."""
    from brickwork.functions import schemes

    types = [
        ("Erection of 40 flats", "GREYSTAR Europe Ltd", None, "BTR"),
        ("Change of use", None, "c/o Unite Students plc", "PBSA"),
        ("Retirement apartments", "Grainger plc", "", "Mixed"),
        ("32 affordable units for rent", None, None, "Mixed"),
        ("Build-to-rent tower", "Moda Living", None, "BTR"),
        ("Extra care village", "McCarthy Stone", None, "Senior"),
        ("Co-living rooms", None, None, "Co-living"),
        ("Rear extension, one bedroom", "J Smith", None, "Residential"),
        ("New shop front", "Uncle Ben Foods", None, "BTR"),  # names match inside words
        ("New shop front", "", "", "Unknown"),
        (None, None, None, "Unknown"),
    ]
    df = spark.createDataFrame(types, "d string, a string, g string, kind string")
    got = df.select("kind", schemes.scheme_type(F.col("d"), F.col("a"), F.col("g")).alias("got")).collect()
    assert [r.got for r in got] == [r.kind for r in got]
    counts = [
        ("Demolition and erection of 24 no. two-bedroom residential apartments", 24),
        ("Circa 523 residential units and a maximum of 9 dwellings", 523),
        ("a minimum of 3 houses", 3),
        ("50no. 2-storey dwellinghouses", 50),
        ("99,999 homes, later 1,250 dwellings; comprising 40 blocks", 40),  # the first match of a pattern decides whether it counts
        ("construction of 7 towers", 7),
        ("0 flats in a 12-unit scheme", 12),
        ("single storey shop", None),
        (None, None),
    ]
    got = spark.createDataFrame(counts, "d string, n int").select("n", schemes.unit_count(F.col("d")).alias("got")).collect()
    assert [r.got for r in got] == [r.n for r in got]
    tenders = [(["1", "55250000"], "Student halls", "BTR"), (None, "Student halls", "PBSA"), ([], "Block management of an estate", "Managed Scheme"), (["x"], "Rent collection", "Housing Management"), ([None], None, "Managed Scheme")]
    got = spark.createDataFrame(tenders, "c array<string>, d string, kind string").select("kind", schemes.contract_type(F.col("c"), F.col("d")).alias("got")).collect()
    assert [r.got for r in got] == [r.kind for r in got]
    work = [("CCTV and door entry, data", "security"), ("Boiler servicing", "maintenance"), ("retrofit", "maintenance"), ("Nothing of it", None), (None, None)]
    got = spark.createDataFrame(work, "d string, kind string").select("kind", schemes.most_keywords(F.col("d")).alias("got")).collect()
    assert [r.got for r in got] == [r.kind for r in got]


def test_positions_over_many_partitions(spark):
    rows = [(i, (i * 37) % 11 if i % 5 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v int").repartition(7)
    got = {r.id: r.pos for r in ranking.positions(df, [F.asc_nulls_first("v"), F.col("id")]).collect()}
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert got == {i: k for k, (i, _) in enumerate(ordered, 1)}
    assert ranking.positions(df.limit(0), [F.col("id")]).count() == 0


def test_containing_lists_all_texts_within(spark):
    longer, shorter = ["unite students", "greystar", "", None, "star", "aaa"], ["star", "student", "unite students", "", None, "aa", "ystart"]
    frame = lambda rows, name: spark.createDataFrame([(x,) for x in rows], f"{name} string")
    for least in (1, 3):
        got = {tuple(r) for r in joining.containing(frame(longer, "t"), "t", frame(shorter, "p"), "p", least).collect()}
        assert got == {(a, b) for a in longer for b in shorter if a and b and b in a and len(b) >= least}


def test_steps_go_by_what_they_read_and_fill_gaps_only(spark):
    rows = spark.createDataFrame([(1, None, None, None), (2, "A1", None, 5.0), (3, "", 7, None), (4, None, None, None)], "id int, code string, units int, rating double")
    told = spark.createDataFrame([(1, "B2", 4), (3, "C3", 9), (4, "", None)], "key int, told string, n int")
    places = spark.createDataFrame([("B2", 10), ("C3", 20), ("A1", 30)], "place string, north int")
    sides = {"told": filling.Side(told, "key", "id"), "places": filling.Side(places, "place", "code", ("code",))}
    steps = [
        filling.Step("rate", {"rating": F.col("units") * 1.5 + F.col("north")}, reads=("units",), uses=("places",)),
        filling.Step("text", {"code": F.col("told"), "units": F.col("n")}, uses=("told",)),
        filling.Step("count", {"units": F.col("n")}, uses=("told",), where=F.col("id") != 4),
        filling.Step("default", {"units": F.lit(1)}),
    ]
    out = filling.fill_gaps(rows, steps, sides)
    got = {r.id: (r.code, r.units, r.rating, r.filled_by) for r in out.collect()}
    assert got == {
        1: ("B2", 4, 16.0, {"code": "text", "units": "text", "rating": "rate"}),
        2: ("A1", 1, 5.0, {"units": "default"}),
        3: ("C3", 7, 30.5, {"code": "text", "rating": "rate"}),
        4: (None, 1, None, {"units": "default"}),
    }
    assert [s.name for s in filling.ordered(steps, sides)][-1] == "rate" and out.columns == [*rows.columns, "filled_by"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2  # each side once
    with pytest.raises(ValueError, match="cycle"):
        filling.ordered([filling.Step("a", {"x": F.lit(1)}, reads=("y",)), filling.Step("b", {"y": F.lit(1)}, reads=("x",))], {})


def test_gaps_only_decrease(spark):
    from brickwork.plans import gaps

    made = lambda sql, name: gaps._made(spark, "/root/testdata/sf0.001", sql, name)
    before = made(gaps.SCHEMES, "part").cache()
    after = gaps.filled_schemes(before, made(gaps.CONTRACTS, "lineitem"), made(gaps.COUNCILS, "nation"), made(gaps.PLACES, "customer"))
    fields = ["postcode", "address", "council", "contract_type", "units", "revenue", "rating", "latitude", "longitude"]
    old, new = ({r.id: r for r in df.collect()} for df in (before, after))
    for i, r in old.items():
        for f in fields:
            had = r[f] not in (None, "")
            assert new[i][f] == r[f] if had or f not in new[i].filled_by else new[i][f] not in (None, "")
    assert all(sum(f in r.filled_by for r in new.values()) > 0 for f in fields)
    before.unpersist()


def test_weighted_sums_are_exact(spark):
    weights = {"a": 0.35, "b": 0.15, "c": 0.1}
    df = spark.createDataFrame([(69.0, 30.0, 14.0), (50.3, 1.1, 0.0), (0.1, 0.1, 0.1), (None, 1.0, 1.0)], "a double, b double, c double")
    got = [r.s for r in df.select(scoring.composite(weights, {k: F.col(k) for k in weights}).alias("s")).collect()]
    assert got == [30.0, 17.8, 0.1, 0.0]  # the first is 30.05 exactly: to the even digit; without a part the sum counts as 0


def walked(up, root, depth):
    """What a depth-first walk lists, by recursion with one set of companies seen."""
    seen, out = set(), []

    def go(number, level):
        if level >= depth or number in seen:
            return
        seen.add(number)
        for parent in sorted(up.get(number, ())):
            out.append((root, parent, level + 1))
            go(parent, level + 1)

    go(root, 0)
    return out


@pytest.mark.parametrize("depth", [1, 2, 4, 6])
def test_walks_through_diamonds_and_cycles(spark, depth):
    rng = random.Random(depth)
    up = {}
    for _ in range(150):
        a, b = rng.randrange(45), rng.randrange(45)
        up.setdefault(a, set()).add(b)  # cycles and self loops among them
    up |= {100: {101, 102}, 101: {103}, 102: {105}, 103: {104}, 104: {105}, 105: {106}, 106: {107}}  # 105 is met first at the end of the long way
    edges = spark.createDataFrame([(a, b) for a, parents in up.items() for b in parents], "child long, parent long")
    got = {}
    for r in graph.depth_first_walk(edges, depth).collect():
        got.setdefault(r.root, []).append((list(r.path), (r.root, r.node, r.level)))
    assert {root: [x for _, x in sorted(found)] for root, found in got.items()} == {root: walked(up, root, depth) for root in up}


def test_merges_of_merges_end_at_one_primary(spark):
    pairs = [(3, 2), (2, 1), (9, 3), (20, 30), (30, 20), (31, 30), (5, 7), (5, 8), (6, 6), (None, 4), (40, 41), (40, 41)]
    got = {r.old: r.new for r in components.primaries(spark.createDataFrame(pairs, "old long, new long")).collect()}
    assert got == {2: 1, 3: 1, 9: 1, 30: 20, 31: 20, 5: 7, 8: 7, 40: 41}
    assert components.primaries(spark.createDataFrame([], "old long, new long")).count() == 0
