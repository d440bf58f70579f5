"""Linked data at any depth, rents of pages, archives read back, changes taken back."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from brickwork import registry  # noqa: F401  first, as plans import each other through it
from brickwork.functions import jsonld
from brickwork.operators import registers, snapshots
from brickwork.sources import archives
from brickwork.sources.workspace import new_path


def nested(depth, leaf, k=0):
    """A node within ``depth`` others, by arrays and objects in turn."""
    for n in range(depth):
        leaf = {"@graph": [leaf, n]} if (n + k) % 2 else {"item": leaf, "name": f"level {n}"}
    return leaf


def walked(value, path="$"):
    """path and node of every object, by plain recursion."""
    if isinstance(value, dict):
        yield path, value
        for k, v in value.items():
            yield from walked(v, f"{path}.{k}")
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from walked(v, f"{path}[{k}]")


TEXTS = [json.dumps(nested(depth, {"price": depth, "a": [[{"b": 1}], []], "x": None}, depth)) for depth in range(7)] + ["[1, [2, {\"q\": {}}]]", "7", "null", "no json", "", None, '{"open": '] * 2


def test_nodes_at_any_depth(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, json string")
    got = {}
    for r in jsonld.json_nodes(df, "json").select("i", "path", F.to_json("node").alias("n")).collect():
        got.setdefault(r.i, []).append((r.path, json.loads(r.n)))
    expected = {}
    for i, t in enumerate(TEXTS):
        try:
            found = sorted(walked(json.loads(t or "x")), key=lambda x: x[0])
        except ValueError:
            continue
        if found:
            expected[i] = found
    assert {i: sorted(v, key=lambda x: x[0]) for i, v in got.items()} == expected
    assert jsonld.json_nodes(df.where("i > 8"), "json").where("i < 14").count() == 0


def block(value):
    return f'<script async type="application/ld+json" id=x>{json.dumps(value)}</script>'


PAGES = [
    "<p>From £120 per week to £1,050.50 pcm</p>",
    "£95pw or £ 130.5 /week, £60 p/w, £59 pw, £551 pw",
    block(nested(4, {"price": "215.00", "unitText": "WEEK"})) + block({"price": 0, "lowPrice": "1,200", "offers": {"minPrice": 900}}),
    block(nested(6, {"price": "soon", "offers": [{"price": 800}, {"price": "", "minPrice": "3,999.5"}]})) + block([{"price": 100, "per": "Week"}]).replace("]", "", 1),
    '{"weeklyRent": "155", "price_per_week":199.5, "pricePerWeek":9}',
    "£5000 pcm", "", None, "<script type='application/ld+json'>{bad</script> £310 a month", "£, pw £ ,, per week £70 weekly",
]


def test_rents_of_pages_both_ways(spark):
    df = spark.createDataFrame(list(enumerate(PAGES)) + [(0, PAGES[0])], "i int, html string")
    expected = sorted((i, *r) for i, p in [*enumerate(PAGES), (0, PAGES[0])] for r in jsonld.rents_of_page(p))
    assert sorted(map(tuple, jsonld.page_rents(df, "html").collect())) == expected and len(expected) > 10
    rents = jsonld.page_rents_table()
    assert sorted(map(tuple, df.lateralJoin(rents(F.col("html").outer())).select("i", "rent_type", "ppw", "pcm").collect())) == expected


def test_addresses_of_nodes(spark):
    texts = ['{"address": "1 Mill Lane"}', '{"address": {"streetAddress": "2 Mill Lane", "addressRegion": "", "postalCode": "LS1 1AA"}}', '{"address": ""}', "{}", '{"address": {}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, json string").select("i", F.parse_json("json").alias("node"))
    assert [r.a for r in df.select("i", jsonld.address("node").alias("a")).orderBy("i").collect()] == ["1 Mill Lane", "2 Mill Lane, LS1 1AA", None, None, ""]


def test_zip_files_are_read_back(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/Data.CSV", '﻿Title,Name\r\n1,"A ""B"", C\nand D"\r\n\r\n2,é\r\n'.encode())
        z.writestr("other.csv", b"Name,Extra,Title\nbad \xff byte,e,3\nshort\n")
        z.writestr("read.me", "Title,Name\n9,9\n")
    with zipfile.ZipFile(tmp_path / "empty.zip", "w"):
        pass
    found = archives.zip_rows(archives.archives(spark, str(tmp_path)))
    rows = archives.with_header(found, ["Title", "Name", "None"]).collect()
    assert sorted((r.Title or "", r.Name or "", r["None"]) for r in rows) == [("", "", None), ("", "short", None), ("1", 'A "B", C\nand D', None), ("2", "é", None), ("3", "bad � byte", None)]


def workbook(rows, sheet="Table 1"):
    """A small XLSX file; a cell is a text, a number, a (date serial,) or None."""
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared = sorted({c for r in rows for c in r if isinstance(c, str)})

    def cell(ref, c):
        if isinstance(c, str):
            return f'<c r="{ref}" t="s"><v>{shared.index(c)}</v></c>'
        return f'<c r="{ref}" s="2"><v>{c[0]}</v></c>' if isinstance(c, tuple) else f'<c r="{ref}"><v>{c}</v></c>'

    body = "".join(f'<row r="{n}">' + "".join(cell(f"{'ABCDEFG'[k]}{n}", c) for k, c in enumerate(r) if c is not None) + "</row>" for n, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {space} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{sheet}" r:id="rId9"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId9" Target="/xl/worksheets/one.xml"/></Relationships>')
        z.writestr("xl/worksheets/one.xml", f"<worksheet {space}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {space}>" + "".join(f"<si><r><t>{t[:1]}</t></r><r><t>{t[1:]}</t></r></si>" for t in shared) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {space}><numFmts><numFmt numFmtId="170" formatCode="mmm\\-yy"/><numFmt numFmtId="171" formatCode="&quot;day&quot;0.0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="171"/><xf numFmtId="170"/></cellXfs></styleSheet>')
    return out.getvalue()


def test_sheets_are_read_back(spark, tmp_path):
    serial = lambda *day: ((dt.date(*day) - dt.date(1899, 12, 30)).days,)
    rows = [["Period", "Code", "Rent"], [serial(2026, 5, 1), "E06", 900], [serial(2026, 6, 1), "E06", 910.5], [None, "E06", 1], [serial(2026, 4, 1), "W07", None, "late"], [(45000.5,), None, 7]]
    (tmp_path / "a.xlsx").write_bytes(workbook(rows))
    (tmp_path / "b.xlsx").write_bytes(workbook([["x"]], "Other"))
    found = archives.sheet_rows(archives.archives(spark, str(tmp_path)), "Table 1")
    cells = {r.row: list(r.cells) for r in found.collect()}
    assert cells == {1: ["Period", "Code", "Rent"], 2: ["2026-05-01", "E06", "900"], 3: ["2026-06-01", "E06", "910.5"], 4: [None, "E06", "1"], 5: ["2026-04-01", "W07", None, "late"], 6: ["2023-03-15 12:00:00", None, "7"]}
    named = found.where("row > 1").select("row", *[F.get("cells", F.lit(k)).alias(c) for k, c in enumerate(("period", "code", "rent"))])
    assert sorted((r.code, r.period, r.rent) for r in archives.latest_rows(named, "code", "period").collect()) == [("E06", "2026-06-01", "910.5"), ("W07", "2026-04-01", None)]


def test_changes_are_taken_back_whole(spark):
    before = spark.createDataFrame([(1, "BTR", "a", 5), (2, "PBSA", None, 50), (3, None, "c", 5), (4, "BTR", None, None)], "id int, kind string, notes string, units int")
    where = F.col("units") < 20
    rows = lambda df: sorted(map(tuple, df.collect()))
    backup = snapshots.backed_up(before, None, "id", ["kind", "notes"], where)
    after = snapshots.changed(before, where, {"kind": F.lit("Residential"), "notes": F.concat(F.coalesce("notes", F.lit("")), F.lit("!"))})
    assert rows(after) == [(1, "Residential", "a!", 5), (2, "PBSA", None, 50), (3, "Residential", "c!", 5), (4, "BTR", None, None)]
    backup = snapshots.backed_up(after, backup, "id", ["kind", "notes"], where | (F.col("id") == 4))
    again = snapshots.changed(after, F.col("id") != 2, {"kind": F.lit("Gone")})
    path = new_path(spark, "test-backup")
    backup.write.parquet(path)  # as a table of its own, read again
    assert rows(snapshots.taken_back(again, spark.read.parquet(path), "id")) == rows(before)


def test_register_changes_with_nulls(spark):
    schema = "k int, a string, b int"
    old = spark.createDataFrame([(1, "x", 1), (2, "x", None), (3, None, 1), (4, "z", 4)], schema)
    new = spark.createDataFrame([(1, "x", 1), (2, "x", 2), (3, "y", None), (5, None, None)], schema)
    got = sorted(map(tuple, registers.register_changes(old, new, "k", ["a", "b"]).collect()))
    assert got == [(2, "changed", "x", 2, ["b"]), (3, "changed", "y", None, ["a", "b"]), (4, "gone", "z", 4, []), (5, "new", None, None, [])]


@pytest.mark.parametrize("text, months", [("Works for a period of 24 months", 24), ("5+2+2 years", 108), ("none", None), (None, None)])
def test_ends_from_terms(spark, text, months):
    from brickwork.functions import periods

    day = dt.date(2020, 1, 31)
    rows = [(day, None, None, None), (None, None, day, None), (None, None, None, day), (None, dt.date(2021, 1, 1), day, day), (None, None, None, None)]
    df = spark.createDataFrame([(*r, text) for r in rows], "starts date, ends date, published date, created date, text string")
    got = [tuple(r.b) for r in df.select(periods.backfilled(F.col("starts"), F.col("ends"), F.col("text"), {"published": F.col("published"), "created": F.col("created")}).alias("b")).collect()]
    end = {24: dt.date(2022, 1, 31), 108: dt.date(2029, 1, 31)}.get(months)
    if end:
        assert got == [(day, end, "duration"), (day, end, "published"), (day, end, "created"), (None, dt.date(2021, 1, 1), None), (None, None, None)]
    else:
        assert got == [(*r[:2], None) for r in rows]


def test_sequence_match_by_difflib(spark):
    import difflib
    import re

    from brickwork.plans import registers as plans

    def key(name):
        text = re.sub(r"[^a-z0-9 ]", " ", name.lower())
        return re.sub(r"\s+", " ", re.sub(r"\b(limited|ltd|plc|llp|the|of|and|company|co|uk|group)\b", " ", text)).strip()

    rows = plans.made(spark, "/root/testdata/sf0.001", plans.TITLED, "orders").collect()
    ratios = {r.id: 1.0 if key(r.ours) == key(r.title) else difflib.SequenceMatcher(None, key(r.ours), key(r.title)).ratio() for r in rows}
    got = {r.id: r.ratio for r in plans.sequence_match(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: round(x, 6) for i, x in ratios.items() if x >= 0.92} and 0 < len(got) < len(rows)


def test_sites_fill_what_is_missing(spark):
    from brickwork.operators import ingests

    columns = "reference string, council int, address string, postcode string, latitude double, longitude double, units int, status string"
    state = spark.createDataFrame([("A", 1, "x", "", None, 2.0, None, "old"), ("B", 1, "y", "LS1", 1.0, 1.0, 5, "old")], columns)
    sites = [(2, "A", "org", "new", "LS9", 7.0, 7.0, 70, "s"), (1, "A", "org", "first", "", None, 8.0, 60, "s"), (3, "C", "org", "c", "", None, None, None, "s"), (4, "C", "org", "d", "LS4", None, 4.0, None, "t"), (5, "", "org", "x", "", None, None, 1, "s"), (6, "D", "org", "", "", None, None, 1, "s"), (7, "E", "nobody", "e", "", None, None, 1, "s"), (8, None, "org", "e", "", None, None, 1, "s")]
    rows = spark.createDataFrame(sites, "row int, reference string, organisation string, address string, postcode string, latitude double, longitude double, units int, status string")
    councils = spark.createDataFrame([(1, "org"), (4, "org"), (5, "")], "id int, organisation string")
    got = sorted(map(tuple, ingests.merged_sites(state, rows, councils).collect()))
    assert got == [("A", 1, "x", "LS9", 7.0, 2.0, 60, "old"), ("B", 1, "y", "LS1", 1.0, 1.0, 5, "old"), ("C", 1, "c", "LS4", None, 4.0, None, "s")]
    assert sorted(map(tuple, ingests.merged_sites(state.limit(0), rows.limit(0), councils).collect())) == []
