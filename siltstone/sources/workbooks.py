"""Spreadsheets (XLSX): rows of all sheets of all workbooks in a folder, lists of businesses in them, and workbooks written from rows.

A workbook is read by one task, its sheets as streams of rows; memory is
bounded by its packed bytes and its table of shared texts.
"""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import urls as U
from siltstone.operators.frontier import first_wins, numbered_slugs

# Names of XML in workbooks, and of the columns of a list of businesses.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
NAME, SITE, PHONE, ADDRESS = "nombre", "pagina web", "telefono", "direccion"
#: What XML cannot hold.
UNFIT = re.compile("[" + "".join(map(chr, (*range(9), 11, 12, *range(14, 32), 0xFFFE, 0xFFFF))) + "]")
BROKEN = (zipfile.BadZipFile, zlib.error, KeyError, OSError, EOFError, ValueError, ElementTree.ParseError, NotImplementedError, RuntimeError)
ROWS = "path string, sheet_place int, sheet string, row int, cells array<string>, problem string"


def _plain(text: object) -> str:
    return unicodedata.normalize("NFKD", str(text or "")).encode("ascii", "ignore").decode().lower()


def ascii_slug(text: Column, limit: int = 72, otherwise: str = "tienda") -> Column:
    """Words of ASCII letters and digits joined by dashes, accents taken off, cut to ``limit``."""
    slugged = lambda x: re.sub(r"(^-|-$)", "", re.sub(r"[^a-z0-9]+", "-", _plain(x)))[:limit] or otherwise
    return F.pandas_udf(lambda s: s.map(slugged, na_action=None), "string")(text)


def folded_headers(cells: Column) -> Column:
    """Headers in small ASCII letters, white space collapsed."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda cells: [re.sub(r"\s+", " ", _plain(x)).strip() for x in cells])

    return F.pandas_udf(run, "array<string>")(cells)


def _place(reference: str | None, otherwise: int) -> int:
    """The number of a cell's column (from 0), from a reference such as AB12."""
    letters = re.match(r"[A-Z]+", reference or "")
    if not letters:
        return otherwise
    n = 0
    for c in letters[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(content: memoryview) -> Iterator[tuple[int, str | None, int | None, list[str | None] | None, str | None]]:
    """Sheet (place and name), row number, cells and problem of each row of a workbook."""
    sheet_place, name = 0, None
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            told = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
            shared = []
            if "xl/sharedStrings.xml" in book.namelist():
                shared = ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
            for sheet_place, sheet in enumerate(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")):
                name, target, last = sheet.get("name"), told[sheet.get(LINKED)], 0
                with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as stream:
                    for _, element in ElementTree.iterparse(stream):
                        if element.tag != f"{MAIN}row":
                            continue
                        last = int(element.get("r") or last + 1)
                        cells: list[str | None] = []
                        for cell in element.iter(f"{MAIN}c"):
                            at, value, kind = _place(cell.get("r"), len(cells)), cell.find(f"{MAIN}v"), cell.get("t")
                            text = None if value is None else value.text
                            if kind == "s" and text is not None:
                                text = shared[int(text)]
                            elif kind == "inlineStr":
                                text = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                            cells += [None] * (at + 1 - len(cells))
                            cells[at] = text
                        yield sheet_place, name, last, cells, None
                        element.clear()
    except BROKEN as problem:
        yield sheet_place, name, None, None, f"{type(problem).__name__}: {problem}"


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all sheets (ROWS); a workbook or sheet that cannot be read gives a row with its ``problem``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string()]
        names = [x.split()[0] for x in ROWS.split(", ")]
        for batch in batches:
            for at, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held: list[tuple] = []
                for row in sheet_rows(content.as_buffer()):
                    held.append((at, *row))
                    if len(held) == 2048:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ROWS)


def workbook_businesses(rows: DataFrame) -> DataFrame:
    """Businesses in the rows of workbooks: name, website, phone, address, slug, and all rows (sheet, row) of the same site.

    A sheet counts if its first row has the columns NAME and SITE; of headers that
    repeat the last counts.  The first row of a site in the order of sheets and rows names it.
    """
    headers = rows.where("row = 1").select("path", "sheet_place", folded_headers(F.col("cells")).alias("headers"))
    at = lambda name: F.size("headers") - F.array_position(F.reverse("headers"), name)  # noqa: E731  place of the last one
    has = lambda name: F.array_contains("headers", name)
    headers = headers.where(has(NAME) & has(SITE))  # a row for each sheet
    own = rows.where("row > 1").join(headers, ["path", "sheet_place"])
    said = lambda name: F.when(has(name), F.trim(F.coalesce(F.get("cells", at(name).cast("int")), F.lit("")))).otherwise(F.lit(""))
    own = own.select(F.struct("path", "sheet_place", "row").alias("place"), "sheet", "row", said(NAME).alias("name"), said(SITE).alias("website"), said(PHONE).alias("phone"), said(ADDRESS).alias("address"))
    own = own.where((F.col("name") != "") & F.col("website").rlike("^https?://"))
    host = F.regexp_replace(F.regexp_replace(U.host("website"), ":[0-9]+$", ""), r"^www\.", "")
    own = own.withColumn("key", F.concat(host, F.lower(F.regexp_replace(F.regexp_extract("website", r"(?i)^https?://[^/?#]*([^?#]*)", 1), "/+$", ""))))
    listed = own.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "sheet", "row"))), lambda x: F.struct(x["sheet"].alias("sheet"), x["row"].alias("row"))).alias("rows"))
    first = first_wins(own, "key", "place").withColumn("base", ascii_slug(F.col("name")))
    return numbered_slugs(first, "base", "place", "slug").drop("base", "sheet", "row").join(listed, "key").drop("key")


def write_workbooks(rows: DataFrame, folder: str, most: int = 50_000) -> None:
    """Rows of text columns as workbooks of one sheet with a header row, ``most`` rows each at most; files of Spark's text writer, one row of bytes each."""
    names = rows.columns

    def row(number: int, cells: list[str | None]) -> str:
        plain = lambda c: escape(UNFIT.sub("", c), {"\r": "&#13;"})
        return f'<row r="{number}">' + "".join("<c/>" if c is None else f'<c t="inlineStr"><is><t xml:space="preserve">{plain(c)}</t></is></c>' for c in cells) + "</row>"

    def book(lines: list[str]) -> bytes:
        out = io.BytesIO()
        main, linked = MAIN.strip("{}"), LINKED.strip("{").split("}")[0]
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/></Types>')
            z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{linked}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{linked}"><sheets><sheet name="rows" sheetId="1" r:id="r1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{linked}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
            z.comment = b"\n"  # which the text writer puts at the end
        return out.getvalue()[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[str] = []
        for batch in batches:
            for cells in batch.to_pylist():
                lines = lines or [row(1, names)]
                lines.append(row(len(lines) + 1, list(cells.values())))
                if len(lines) > most:
                    yield pa.RecordBatch.from_arrays([pa.array([book(lines)], pa.binary())], ["value"])
                    lines = []
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array([book(lines)], pa.binary())], ["value"])

    packed = rows.select(*[F.col(f"`{c}`").cast("string") for c in names]).mapInArrow(run, "value binary")
    packed.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
