"""Members of archives: lines and rows of CSV files in ZIP, rows of XLSX sheets.

Archives come as rows of (path, content), as Spark's ``binaryFile`` reader gives
them from any store; a task takes one apart member by member and row by row, in
batches, so only the archive itself (under 2 GB) has to fit.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BATCH = 5000
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files of a path."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _rows(df: DataFrame, read: Callable[[str, bytes], Iterator[tuple]], schema: str) -> DataFrame:
    types = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(batch.column(n).to_pylist() for n in (0, 1))):
                held: list[tuple] = []
                for row in read(path, content) if content is not None else ():
                    held.append((path, *row))
                    if len(held) == BATCH:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*held), types.types)), names=types.names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*held), types.types)), names=types.names)

    return df.select("path", "content").mapInArrow(run, schema)


def zip_rows(df: DataFrame, members: str = r"(?i)\.csv$", encoding: str = "utf-8-sig") -> DataFrame:
    """path, member, row, cells: the CSV rows of the members whose name fits; bytes that are no text in the encoding are replaced."""

    def read(_: str, content: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for info in archive.infolist():
                if re.search(members, info.filename):
                    with archive.open(info) as raw, io.TextIOWrapper(raw, encoding, errors="replace", newline="") as text:
                        for n, cells in enumerate(csv.reader(text)):
                            yield info.filename, n, cells

    return _rows(df, read, "path string, member string, row long, cells array<string>")


def with_header(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of rows whose first row of each member is a header; a column that a member does not have is null."""
    header = rows.where("row = 0").select("path", "member", F.col("cells").alias("header"))
    body = rows.where("row > 0").join(F.broadcast(header), ["path", "member"])  # a row a member
    place = lambda c: F.array_position("header", c)
    return body.select(*[F.when(place(c) > 0, F.get("cells", (place(c) - 1).cast("int"))).alias(c) for c in columns])


def _column(reference: str) -> int:
    """The number from 0 of a cell's column, as in "AB12"."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _dates(archive: zipfile.ZipFile) -> set[int]:
    """The numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in archive.namelist():
        return set()
    root = ElementTree.fromstring(archive.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{SHEET}numFmt")}
    shows = lambda n: n in range(14, 23) or n in range(45, 48) or bool(re.search("[ymd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(n, "")).lower()))
    formats = root.find(f"{SHEET}cellXfs")
    return {n for n, x in enumerate(formats if formats is not None else ()) if shows(int(x.get("numFmtId", 0)))}


def _sheet_file(archive: zipfile.ZipFile, sheet: str | None) -> str | None:
    """The member that holds a sheet, by its name; the first one without a name."""
    book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    for s in book.iter(f"{SHEET}sheet"):
        if sheet is None or s.get("name") == sheet:
            target = targets[s.get(RELATION)]
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return None


def sheet_rows(df: DataFrame, sheet: str | None = None) -> DataFrame:
    """path, row (from 1), cells: the rows of a sheet of each XLSX file, cells as text, dates as yyyy-mm-dd (with the time if there is one), empty cells null."""

    def read(_: str, content: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            member = _sheet_file(archive, sheet)
            if member is None:
                return
            text = lambda e: "".join(t.text or "" for t in e.iter(f"{SHEET}t"))
            shared = [text(e) for e in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")] if "xl/sharedStrings.xml" in archive.namelist() else []
            dates = _dates(archive)
            with archive.open(member) as raw:
                for _, element in ElementTree.iterparse(raw):
                    if element.tag != f"{SHEET}row":
                        continue
                    cells: list[str | None] = []
                    for c in element.iter(f"{SHEET}c"):
                        at, kind, value = _column(c.get("r", "")) if c.get("r") else len(cells), c.get("t", "n"), c.find(f"{SHEET}v")
                        cells += [None] * (at + 1 - len(cells))
                        found = text(c) if kind == "inlineStr" else None if value is None else value.text
                        if found is not None and kind == "s":
                            found = shared[int(found)]
                        elif found is not None and kind == "n" and int(c.get("s", 0)) in dates:
                            moment = datetime(1899, 12, 30) + timedelta(seconds=round(float(found) * 86400))
                            found = f"{moment:%Y-%m-%d}" if moment.time() == datetime.min.time() else f"{moment:%Y-%m-%d %H:%M:%S}"
                        cells[at] = found
                    yield int(element.get("r", 0)), cells
                    element.clear()

    return _rows(df, read, "path string, row long, cells array<string>")


def latest_rows(rows: DataFrame, code: str, period: str) -> DataFrame:
    """The row of each code's latest period; a code's rows without a period count as earliest, ties go to the first row."""
    best = F.max_by(F.struct(*rows.columns), F.struct(F.coalesce(F.col(period), F.lit("")), -F.col("row"))).alias("b")
    return rows.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("__code")).agg(best).select("b.*")
