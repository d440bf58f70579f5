"""Linked data, rents of pages and archives (F17, F31, S03, S08, U13, U15), in pages and files made from the tables."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from brickwork.functions import jsonld as j
from brickwork.registry import query, table
from brickwork.sources import archives as a

#: A node with a name and offers, within as many levels of other nodes and arrays as the page's number tells; rents in the text and in keys of other JSON. For both sides.
_NODE = (
    """concat('{"@type":"Apartment","name":"Block ', page_id, '","offers":', CASE WHEN page_id % 2 = 0 THEN '[' ELSE '' END, '{"price":', CASE page_id % 5 WHEN 0 THEN concat('"', page_id % 700, ',0"') WHEN 1 THEN 'null,"lowPrice":"soon"' ELSE CAST(page_id % 900 AS STRING) END, """
    """',"unitText":"', CASE WHEN page_id % 3 = 0 THEN 'WEEK' ELSE 'MON' END, '"}', CASE WHEN page_id % 2 = 0 THEN ']' ELSE '' END, '}')"""
)
HTML = (
    f"""CASE WHEN page_id % 4 = 3 THEN html ELSE concat(html, '<script type="application/ld+json">', repeat('{{"@graph":[', CAST(page_id % 7 AS INTEGER)), {_NODE}, repeat(']}}', CAST(page_id % 7 AS INTEGER)), '</script>', CASE WHEN page_id % 6 = 0 THEN '<script type="application/ld+json">no json</script>' ELSE '' END, """
    """CASE page_id % 9 WHEN 0 THEN concat('<p>Rooms from £', page_id % 300 + 1, ' per week</p>') WHEN 1 THEN concat('<p>£1,', 100 + page_id % 100, '.50 pcm</p>') WHEN 2 THEN concat('{"weeklyRent":"', 50 + page_id % 60, '"}') ELSE '' END) END"""
)


def _pages(spark, d):
    return table(spark, d, "pages").selectExpr("page_id", f"{HTML} AS html")


_PRICED = "CASE page_id % 5 WHEN 0 THEN concat(page_id % 700, ',0') WHEN 1 THEN 'soon' ELSE nullif(CAST(page_id % 900 AS VARCHAR), '0') END"


@query(
    "jsonld",
    f"SELECT page_id, '$' || repeat('.@graph[0]', n::INTEGER) AS path, 'Block ' || page_id AS name, NULL AS price FROM (SELECT page_id, page_id % 7 AS n FROM pages WHERE page_id % 4 <> 3) x UNION ALL SELECT page_id, '$' || repeat('.@graph[0]', n::INTEGER) || '.offers' || CASE WHEN page_id % 2 = 0 THEN '[0]' ELSE '' END, NULL, {_PRICED} FROM (SELECT page_id, page_id % 7 AS n FROM pages WHERE page_id % 4 <> 3) y "
    "UNION ALL SELECT page_id, '$' || repeat('.@graph[0]', k::INTEGER), NULL, NULL FROM (SELECT page_id, unnest(range(page_id % 7)) AS k FROM pages WHERE page_id % 4 <> 3) z",
)
def jsonld(spark, d):
    """Every node of the pages' linked data, from one to eight levels deep."""
    texts = _pages(spark, d).select("page_id", F.explode(j.blocks(F.col("html"))).alias("json"))
    price = F.coalesce(*[j.node_text("node", k) for k in j.PRICE_KEYS])
    return j.json_nodes(texts, "json").select("page_id", "path", j.node_text("node", "name").alias("name"), price.alias("price"))


_FOUND = f"""SELECT page_id, page_id % 3 = 0 AS weekly, try_cast(replace({_PRICED}, ',', '') AS DOUBLE) AS p FROM pages WHERE page_id % 4 <> 3 UNION ALL SELECT page_id, true, page_id % 300 + 1 FROM pages WHERE page_id % 4 <> 3 AND page_id % 9 = 0
  UNION ALL SELECT page_id, false, 1100.5 + page_id % 100 FROM pages WHERE page_id % 4 <> 3 AND page_id % 9 = 1 UNION ALL SELECT page_id, true, 50 + page_id % 60 FROM pages WHERE page_id % 4 <> 3 AND page_id % 9 = 2"""
_RENTS = f"""WITH f AS (SELECT page_id, min(CASE WHEN weekly AND p BETWEEN 60 AND 550 THEN p END) AS wl, max(CASE WHEN weekly AND p BETWEEN 60 AND 550 THEN p END) AS wh, min(CASE WHEN NOT weekly AND p BETWEEN 300 AND 4000 THEN p END) AS ml, max(CASE WHEN NOT weekly AND p BETWEEN 300 AND 4000 THEN p END) AS mh FROM ({_FOUND}) x GROUP BY 1),
  e AS (SELECT page_id, wl IS NOT NULL AS w, coalesce(wl, ml) AS low, CASE WHEN wl IS NOT NULL THEN wh ELSE mh END AS high FROM f WHERE wl IS NOT NULL OR ml IS NOT NULL), k AS (SELECT page_id, w, 'From' AS rent_type, low AS p FROM e UNION ALL SELECT page_id, w, 'To', high FROM e WHERE high > low)
  SELECT page_id, rent_type, CASE WHEN w THEN p ELSE round_even(p * 12 / 52, 2) END AS ppw, CASE WHEN w THEN round_even(p * 52 / 12, 2) ELSE p END AS pcm FROM k"""


@query("page_rents", _RENTS)
def page_rents(spark, d):
    return j.page_rents(_pages(spark, d), "html").select("page_id", "rent_type", "ppw", "pcm")


@query("page_rents_table", _RENTS)
def page_rents_table(spark, d):
    """The same by a table function that takes a page apart in one go."""
    rents = j.page_rents_table()
    return _pages(spark, d).lateralJoin(rents(F.col("html").outer())).select("page_id", "rent_type", "ppw", "pcm")


def _zipped(df, key: str, line: str):
    """(path, content): a ZIP for each value of ``key``, of two CSV members and one that is none, in Arrow batches of a group."""

    def run(table: pa.Table) -> pa.Table:
        name, lines = table[key][0].as_py(), sorted(table[line].to_pylist())
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for n in range(2):
                text = "Title Number,Postcode,Proprietor Name (1)\r\n" + "".join(x + "\r\n" for x in lines[n::2])
                archive.writestr(f"{name}/part{n}.CSV", text.encode("utf-8-sig").replace(b"~", b"\xff"))
            archive.writestr("readme.txt", "not,a,row")
        return pa.table({"path": [f"{name}.zip"], "content": [out.getvalue()]})

    return df.groupBy(key).applyInArrow(run, "path string, content binary")


@query("zip_scan", "SELECT concat('T', p_partkey) AS title_number, concat('LS', p_size, ' 1AA') AS postcode, concat('Firm \"', p_name, '\", ', chr(65533)) AS owner FROM part")
def zip_scan(spark, d):
    """Titles from the CSV members of archives, one archive a brand: quoted commas, a byte order mark, a byte that is no UTF-8."""
    line = F.concat(F.lit("T"), "p_partkey", F.lit(",LS"), "p_size", F.lit(' 1AA,"Firm ""'), "p_name", F.lit('"", ~"'))
    made = _zipped(table(spark, d, "part").select("p_brand", line.alias("line")), "p_brand", "line")
    rows = a.with_header(a.zip_rows(made), ["Title Number", "Postcode", "Proprietor Name (1)"])
    return rows.toDF("title_number", "postcode", "owner")


def _workbooks(df):
    """(path, content): an XLSX file for each n_regionkey, with shared texts, dates as numbers and empty cells."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("code", "name", "day", "rent"))))
        texts = sorted({x for r in rows for x in r[:2]})
        cell = lambda ref, body, kind="", style="": f'<c r="{ref}"{kind}{style}><v>{body}</v></c>'
        xml = ['<row r="1"><c r="A1" t="inlineStr"><is><t>Period</t></is></c><c r="B1" t="inlineStr"><is><t>Code</t></is></c></row>']
        for n, (code, name, day, rent) in enumerate(rows, 4):
            cells = [cell(f"A{n}", day, style=' s="1"'), cell(f"B{n}", texts.index(code), ' t="s"'), cell(f"C{n}", texts.index(name), ' t="s"')]
            xml.append(f'<row r="{n}">{"".join(cells)}{cell(f"E{n}", rent) if rent is not None else ""}</row>')
        space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            book.writestr("xl/workbook.xml", f'<workbook {space} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Notes" r:id="r1"/><sheet name="Table 1" r:id="r2"/></sheets></workbook>')
            book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
            book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData/></worksheet>")
            book.writestr("xl/worksheets/sheet2.xml", f"<worksheet {space}><sheetData>{''.join(xml)}</sheetData></worksheet>")
            book.writestr("xl/sharedStrings.xml", f"<sst {space}>{''.join(f'<si><t>{t}</t></si>' for t in texts)}</sst>")
            book.writestr("xl/styles.xml", f'<styleSheet {space}><cellXfs><xf numFmtId="0"/><xf numFmtId="17"/></cellXfs></styleSheet>')
        return pa.table({"path": [f"{table['n_regionkey'][0].as_py()}.xlsx"], "content": [out.getvalue()]})

    return df.groupBy("n_regionkey").applyInArrow(run, "path string, content binary")


@query(
    "xlsx_latest",
    "WITH x AS (SELECT concat('E0', n_nationkey) AS code, n_name AS name, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS rent, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey % 7 = 0) "
    "SELECT code, name, period, rent FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY period DESC, rent NULLS LAST) AS rn FROM x) y WHERE rn = 1",
)
def xlsx_latest(spark, d):
    """The latest period's rent of each area, from the second sheet of a workbook a region."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    serial = F.datediff(F.trunc("o_orderdate", "month"), F.lit("1899-12-30").cast("date"))
    key = F.col("o_orderkey")
    rows = o.where(key % 7 == 0).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    made = _workbooks(rows.select("n_regionkey", F.concat(F.lit("E0"), "n_nationkey").alias("code"), F.col("n_name").alias("name"), serial.alias("day"), F.when(key % 3 != 0, key).otherwise(F.lit(2**40)).alias("rent")))
    cells = a.sheet_rows(made, "Table 1").where("row >= 4").select("row", *[F.get("cells", F.lit(k)).alias(name) for k, name in enumerate(("period", "code", "name", "_", "rent"))])
    latest = a.latest_rows(cells.withColumn("row", F.col("rent").cast("long")), "code", "period")
    return latest.select("code", "name", F.to_date("period").alias("period"), F.when(F.col("rent").cast("long") < 2**40, F.col("rent").cast("long")).alias("rent"))
