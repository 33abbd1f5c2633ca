"""Workbook (xlsx) source: one task a file, rows as they are parsed."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Names of the file format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows handed to Spark at once.
BATCH_ROWS = 2_000


def _text(node: ElementTree.Element) -> str:
    """Its text and that of its runs, without reading aids."""
    runs = node.findall(f"{_MAIN}t") + node.findall(f"{_MAIN}r/{_MAIN}t")
    return "".join(t.text or "" for t in runs)


def _place(reference: str) -> int:
    """Number of the column of a cell, from 0."""
    n = 0
    for c in reference.rstrip("0123456789"):
        n = n * 26 + ord(c) - 64
    return n - 1


def _sheet_file(book: zipfile.ZipFile, sheet: str | int) -> str:
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).findall(f"{_MAIN}sheets/{_MAIN}sheet")
    chosen = sheets[sheet] if isinstance(sheet, int) else next(s for s in sheets if s.get("name") == sheet)
    relations = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in relations if r.get("Id") == chosen.get(_REL_ID))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _cells(book: zipfile.ZipFile, sheet: str | int) -> Iterator[dict[int, str]]:
    """Each row's values that are not empty, by column."""
    strings = []
    if "xl/sharedStrings.xml" in book.namelist():
        strings = [_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")]
    with book.open(_sheet_file(book, sheet)) as file:
        for _, row in ElementTree.iterparse(file):
            if row.tag != f"{_MAIN}row":
                continue
            found: dict[int, str] = {}
            last = -1
            for cell in row.findall(f"{_MAIN}c"):
                last = _place(cell.get("r")) if cell.get("r") else last + 1
                kind, value = cell.get("t", "n"), cell.findtext(f"{_MAIN}v")
                if kind == "inlineStr":
                    value = _text(cell.find(f"{_MAIN}is"))
                elif kind == "s" and value is not None:
                    value = strings[int(value)]
                elif kind == "b" and value is not None:
                    value = "true" if value == "1" else "false"
                elif kind == "e":
                    value = None
                if value is not None:
                    found[last] = value
            row.clear()
            yield found


def _names(header: dict[int, str], columns: int) -> list[str]:
    """Names of columns: those without one are ``__EMPTY``, and repeated ones are numbered."""
    names: list[str] = []
    for i in range(columns):
        base = header.get(i, "__EMPTY")
        name, n = base, 0
        while name in names:
            n += 1
            name = f"{base}_{n}"
        names.append(name)
    return names


def sheet_records(content: bytes, sheet: str | int = 0) -> Iterator[dict[str, str | None]]:
    """Rows below the header by column name, without rows that are all empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        rows = _cells(book, sheet)
        header = next((r for r in rows if r), {})
        names = _names(header, max(header, default=-1) + 1)
        for row in rows:
            if row:
                yield {name: row.get(i) for i, name in enumerate(names)}


def sheets_of(files: DataFrame, sheet: str | int = 0) -> DataFrame:
    """(path, row, cells) of the first or named sheet of each of ``files`` (path, content).

    ``cells`` are the values of a row as text, by the names in the sheet's first row that
    is not empty; an empty cell is NULL, a date its day number (``dates.excel_date``).
    ``row`` counts from 1.  A sheet holds a million rows at most, so a file is one task's work.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                part: list[tuple] = []
                for number, cells in enumerate(sheet_records(bytes(content), sheet), 1):
                    part.append((path, number, cells))
                    if len(part) == BATCH_ROWS:
                        yield pd.DataFrame(part, columns=["path", "row", "cells"])
                        part = []
                yield pd.DataFrame(part, columns=["path", "row", "cells"])

    return files.select("path", "content").mapInPandas(parse, "path string, row bigint, cells map<string,string>")


def read_workbooks(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """``sheets_of`` the xlsx files below ``path``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(path)
    return sheets_of(found, sheet)


def _escaped(value: object) -> str:
    return str(value).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def workbook(header: list[str], rows: list[tuple], name: str = "Sheet1") -> bytes:
    """A workbook of one sheet: numbers as numbers, all else as shared text, None as no cell."""
    strings: dict[str, int] = {}

    def cell(value: object, r: int, c: int) -> str:
        if value is None:
            return ""
        letters, c = "", c + 1
        while c:
            c, rest = divmod(c - 1, 26)
            letters = chr(65 + rest) + letters
        if isinstance(value, (int, float)):
            return f'<c r="{letters}{r}"><v>{value}</v></c>'
        return f'<c r="{letters}{r}" t="s"><v>{strings.setdefault(str(value), len(strings))}</v></c>'

    lines = "".join(
        f'<row r="{r}">{"".join(cell(v, r, c) for c, v in enumerate(row))}</row>' for r, row in enumerate([tuple(header), *rows], 1)
    )
    main, office = _MAIN[1:-1], _REL_ID[1:].split("}")[0]
    package = "http://schemas.openxmlformats.org/package/2006"
    form = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{form}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{form}.worksheet+xml"/>'
        f'<Override PartName="/xl/sharedStrings.xml" ContentType="{form}.sharedStrings+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="{_escaped(name)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/>'
        f'<Relationship Id="r2" Type="{office}/sharedStrings" Target="sharedStrings.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{lines}</sheetData></worksheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}">{"".join(f"""<si><t xml:space="preserve">{_escaped(s)}</t></si>""" for s in strings)}</sst>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for part, content in parts.items():
            book.writestr(part, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + content)
    return out.getvalue()
