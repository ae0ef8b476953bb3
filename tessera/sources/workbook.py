"""XLSX workbooks: read the first sheet of many files, write small reports."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of a workbook that is read. Fixed values.
MOST_BYTES, MOST_ROWS, MOST_COLUMNS, MOST_CELLS, MOST_TEXT = 5 << 20, 500, 128, 100_000, 20_000
_SPACE = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def is_workbook(content: Column) -> Column:
    """Starts like a ZIP file and is within the size limit."""
    return (F.substring(content, 1, 4) == F.lit(b"PK\x03\x04")) & (F.octet_length(content) <= MOST_BYTES)


def _column(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def read_grid(content: bytes) -> list[list[str]]:
    """The cells of the first sheet as text. ValueError for what is no workbook or too large."""
    if not content.startswith(b"PK\x03\x04") or len(content) > MOST_BYTES:
        raise ValueError("not a workbook of at most 5 MiB")
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        if sum(i.file_size for i in book.infolist()) > 20 * MOST_BYTES:
            raise ValueError("the workbook unpacks to too much")
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iterfind("m:si", _SPACE):
                shared.append("".join(t.text or "" for t in item.iter(f"{{{_SPACE['m']}}}t")))
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        if not sheets:
            raise ValueError("the workbook has no sheet")
        root = ElementTree.fromstring(book.read(sheets[0]))
    grid: list[list[str]] = []
    for row in root.iterfind(".//m:row", _SPACE):
        cells: list[str] = []
        for cell in row.iterfind("m:c", _SPACE):
            at = _column(cell.get("r") or "") if cell.get("r") else len(cells)
            if at >= MOST_COLUMNS:
                raise ValueError("too many columns")
            cells += [""] * (at + 1 - len(cells))
            value = cell.find("m:v", _SPACE)
            if cell.get("t") == "inlineStr":
                cells[at] = "".join(t.text or "" for t in cell.iter(f"{{{_SPACE['m']}}}t"))
            elif value is not None and value.text is not None:
                cells[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
            if len(cells[at]) > MOST_TEXT:
                raise ValueError("a cell is too long")
        grid.append(cells)
        if len(grid) > MOST_ROWS or sum(map(len, grid)) > MOST_CELLS:
            raise ValueError("too many rows or cells")
    return grid


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grids, errors = [], []
        for content in batch.column(1).to_pylist():
            try:
                grids.append(read_grid(content or b""))
                errors.append(None)
            except (ValueError, zipfile.BadZipFile, ElementTree.ParseError) as error:
                grids.append(None)
                errors.append(str(error))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grids, pa.list_(pa.list_(pa.string()))), pa.array(errors, pa.string())], ["path", "grid", "error"])


def read_workbooks(files: DataFrame) -> DataFrame:
    """path, position, cells, error of ``binaryFile`` rows: a row for each of the sheet's, or an error."""
    read = files.select("path", "content").mapInArrow(_reader, "path string, grid array<array<string>>, error string")
    return read.select("path", "error", F.posexplode_outer("grid").alias("position", "cells"))


def with_header(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """path, position and the named columns, found by the header row (trimmed, in any case) of each file."""
    header = rows.filter("position = 0").select("path", F.transform("cells", lambda c: F.lower(F.trim(c))).alias("header"))
    body = rows.filter("position > 0").join(header, "path")
    cell = lambda name: F.try_element_at("cells", F.nullif(F.array_position("header", name.lower()), F.lit(0)).cast("int"))
    return body.select("path", "position", *(F.nullif(F.trim(cell(c)), F.lit("")).alias(c) for c in columns))


def write_workbook(path: str, sheets: dict[str, DataFrame], most_rows: int = 2000) -> None:
    """A report of up to five small tables, a sheet each, with a frozen header and a filter."""
    if len(sheets) > 5:
        raise ValueError("a report has five sheets at most")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        listed, related, typed = [], [], []
        for i, (name, df) in enumerate(sheets.items(), 1):
            rows = df.limit(most_rows + 1).collect()
            if len(rows) > most_rows:
                raise ValueError(f"{name} has more than {most_rows} rows")
            grid = [df.columns, *([("" if v is None else str(v)) for v in r] for r in rows)]
            book.writestr(f"xl/worksheets/sheet{i}.xml", _sheet(grid))
            listed.append(f'<sheet name="{escape(name[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>')
            related.append(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>')
            typed.append(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>')
        head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        relations = "http://schemas.openxmlformats.org/package/2006/relationships"
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{"".join(typed)}</Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{relations}"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_SPACE["m"]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{"".join(listed)}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{relations}">{"".join(related)}</Relationships>')


def write_pack(path: str, drivers: DataFrame, sources: DataFrame) -> None:
    """A report of drivers (with a ``confidence``) and their sources, behind a sheet of totals."""
    totals = drivers.agg(F.count("*").alias("drivers"), F.round(F.avg("confidence"), 1).alias("mean_confidence"), F.count_if(F.col("confidence").isNull()).alias("without_confidence"))
    write_workbook(path, {"Summary": totals, "Drivers": drivers.orderBy(F.desc_nulls_last("confidence")), "Sources": sources})


def _sheet(grid: list[Sequence[str]]) -> str:
    rows = "".join(
        f'<row r="{r}">' + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(re.sub(r"[^\t\n\r -퟿-�]", "", str(v)))}</t></is></c>' for v in row) + "</row>"
        for r, row in enumerate(grid, 1)
    )
    last = ""
    n = len(grid[0])
    while n:
        n, rest = divmod(n - 1, 26)
        last = chr(65 + rest) + last
    pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{_SPACE["m"]}">{pane}<sheetData>{rows}</sheetData><autoFilter ref="A1:{last}{len(grid)}"/></worksheet>'


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
