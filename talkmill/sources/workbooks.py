"""Workbooks (.xlsx) in and out: zipped XML, read on executors, written for reports."""

from __future__ import annotations

import io
import math
import re
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the file format: name spaces, the longest text of a cell, the longest name of a sheet.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
MOST_CHARACTERS, MOST_NAME = 32_767, 31

#: Characters that XML can't hold, and text that looks like their escapes.
_UNWRITABLE = re.compile(r"[\x00-\x08\x0b\x0c\x0d\x0e-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
_HEADER, _WRAPPED = 1, 2
_STYLES = f"""<styleSheet xmlns="{MAIN}"><fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><name val="Calibri"/></font></fonts>
<fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFDDDDDD"/></patternFill></fill></fills>
<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>
<cellXfs count="3"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/><xf applyAlignment="1"><alignment wrapText="1" vertical="top"/></xf></cellXfs></styleSheet>"""


@dataclass(frozen=True)
class Sheet:
    """A sheet's name and looks: widths by column, wrapped cells, columns that fold away, and whether it is hidden."""

    name: str
    widths: dict[str, float] = field(default_factory=dict)
    wrap: bool = False
    folded: tuple[str, ...] = ()
    hidden: bool = False


def letters(n: int) -> str:
    """Name of the n-th column, from 0."""
    name = ""
    n += 1
    while n:
        n, rest = divmod(n - 1, 26)
        name = chr(65 + rest) + name
    return name


def _cell(place: str, value: Any, style: int) -> str:
    look = f' s="{style}"' if style else ""
    if value is None or isinstance(value, float) and math.isnan(value):
        return f'<c r="{place}"{look}/>' if style else ""
    if isinstance(value, bool):
        return f'<c r="{place}"{look} t="b"><v>{int(value)}</v></c>'
    # Spreadsheets keep 15 digits of a number.
    if isinstance(value, int | float | Decimal) and math.isfinite(value) and (isinstance(value, float) or abs(value) < 10**15):
        return f'<c r="{place}"{look}><v>{value}</v></c>'
    text = str(value)
    if len(text) > MOST_CHARACTERS:
        raise ValueError(f"{place}: a cell holds {MOST_CHARACTERS} characters at most, not {len(text)}")
    text = _UNWRITABLE.sub(lambda m: f"_x{ord(m.group()):04X}_", text)
    return f'<c r="{place}"{look} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _sheet_xml(sheet: Sheet, columns: Sequence[str], rows: Sequence[Sequence[Any]]) -> str:
    looks = []
    for n, column in enumerate(columns, 1):
        if column in sheet.widths or column in sheet.folded:
            width, fold = sheet.widths.get(column, 12), ' outlineLevel="1"' if column in sheet.folded else ""
            looks.append(f'<col min="{n}" max="{n}" width="{width}" customWidth="1"{fold}/>')
    lines = [(columns, _HEADER), *((row, _WRAPPED if sheet.wrap else 0) for row in rows)]
    body = "".join(f'<row r="{n}">{"".join(_cell(f"{letters(i)}{n}", v, style) for i, v in enumerate(line))}</row>' for n, (line, style) in enumerate(lines, 1))
    pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
    return f'<worksheet xmlns="{MAIN}">{pane}{f"<cols>{''.join(looks)}</cols>" if looks else ""}<sheetData>{body}</sheetData></worksheet>'


def workbook(tables: Sequence[tuple[Sheet, Sequence[str], Sequence[Sequence[Any]]]]) -> bytes:
    """The bytes of a workbook of (sheet, column names, rows), the header of each bold and frozen.

    Numbers beyond 15 digits, dates and all else are written as text; null and NaN are empty
    cells. Texts too long for a cell and names that a sheet can't have raise ValueError.
    """
    names = [sheet.name.lower() for sheet, _, _ in tables]
    if len(set(names)) < len(names) or all(sheet.hidden for sheet, _, _ in tables):
        raise ValueError("sheets need names of their own, and one must be visible")
    for name in names:
        if not 0 < len(name) <= MOST_NAME or re.search(r"[\[\]:*?/\\]", name):
            raise ValueError(f"not a sheet's name: {name!r}")
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{kind}.worksheet+xml"/>' for n in range(1, len(tables) + 1))
        + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>'
        + "".join(f'<sheet name={quoteattr(sheet.name)} sheetId="{n}" r:id="rId{n}"{" state=\"hidden\"" if sheet.hidden else ""}/>' for n, (sheet, _, _) in enumerate(tables, 1))
        + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">'
        + "".join(f'<Relationship Id="rId{n}" Type="{LINKS}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(tables) + 1))
        + f'<Relationship Id="rId{len(tables) + 1}" Type="{LINKS}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": _STYLES,
    }
    parts |= {f"xl/worksheets/sheet{n}.xml": _sheet_xml(*table) for n, table in enumerate(tables, 1)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, part in parts.items():
            archive.writestr(zipfile.ZipInfo(name), f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n{part}', zipfile.ZIP_DEFLATED)
    return out.getvalue()


def write_workbook(tables: Sequence[tuple[Sheet, DataFrame]], path: str, most: int = 100_000) -> None:
    """One workbook of several tables. For reports: fails beyond ``most`` rows a sheet rather than cutting them."""
    sheets = []
    for sheet, df in tables:
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} rows in sheet {sheet.name}; write_csv has no such limit")
        sheets.append((sheet, df.columns, rows))
    data = workbook(sheets)
    with open(path, "wb") as out:
        out.write(data)


def _text(element: ElementTree.Element) -> str:
    """Text of all runs, phonetic hints aside."""
    found = "".join(t.text or "" for part in (element.findall(f"{{{MAIN}}}t"), element.findall(f"{{{MAIN}}}r/{{{MAIN}}}t")) for t in part)
    return _ESCAPED.sub(lambda m: chr(int(m.group(1), 16)), found)


def _value(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind, inline, v = cell.get("t", "n"), cell.find(f"{{{MAIN}}}is"), cell.find(f"{{{MAIN}}}v")
    if kind == "inlineStr":
        return None if inline is None else _text(inline)
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "true" if v.text == "1" else "false"
    return _ESCAPED.sub(lambda m: chr(int(m.group(1), 16)), v.text) if kind == "str" else v.text


def _elements(archive: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a part one after the other, each freed when the next is asked for."""
    with archive.open(name) as part:
        for _, element in ElementTree.iterparse(part):
            if element.tag == f"{{{MAIN}}}{tag}":
                yield element
                element.clear()


def _rows(archive: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[tuple[int, list[str | None]]]:
    at = 0
    for row in _elements(archive, part, "row"):
        at = int(row.get("r", at + 1))
        cells: list[str | None] = []
        for cell in row:
            place = 0
            for letter in re.match(r"[A-Z]*", cell.get("r", "")).group():
                place = place * 26 + ord(letter) - 64
            cells.extend([None] * (place - 1 - len(cells)))
            cells.append(_value(cell, shared))
        yield at, cells


def _sheets(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) in the workbook's order; hidden sheets too."""
    links = ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
    target = {link.get("Id"): link.get("Target", "") for link in links}
    book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    found = [(s.get("name"), target[s.get(f"{{{LINKS}}}id")]) for s in book.iter(f"{{{MAIN}}}sheet")]
    return [(name, part[1:] if part.startswith("/") else f"xl/{part}") for name, part in found if "worksheets/" in part]


def parse_workbooks(files: DataFrame, preview: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantined) of workbooks in (path, content).

    Rows: path, sheet, row (from 1), cells (strings as stored; null where empty; dates are serial numbers). Every sheet is read,
    of each ``preview`` rows if given. Rows are made one at a time, so a workbook costs its
    bytes and its shared strings. A broken workbook or sheet is quarantined (path, sheet, problem); rows ahead
    of the damage stay.
    """
    damage = (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, KeyError, IndexError, ValueError, NotImplementedError, RuntimeError)

    def found(path: str, content: bytes) -> Iterator[tuple]:
        sheet = None
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                shared = [_text(s) for s in _elements(archive, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in archive.namelist() else []
                sheets = _sheets(archive)
                for sheet, part in sheets:
                    try:
                        for n, (at, cells) in enumerate(_rows(archive, part, shared)):
                            if preview is not None and n >= preview:
                                break
                            yield path, sheet, at, cells, None
                    except damage as problem:
                        yield path, sheet, None, None, f"{type(problem).__name__}: {problem}"
        except damage as problem:
            yield path, sheet, None, None, f"{type(problem).__name__}: {problem}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=["path", "sheet", "row", "cells", "problem"]).astype({"row": "Int64"})
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                for row in found(path, content):
                    rows.append(row)
                    if len(rows) == 1000:
                        yield frame(rows)
                        rows = []
                yield frame(rows)

    parsed = files.select("path", "content").mapInPandas(run, "path string, sheet string, row long, cells array<string>, problem string")
    return parsed.where("problem is null").drop("problem"), parsed.where("problem is not null").select("path", "sheet", "problem")


def read_workbooks(spark: SparkSession, path: str, preview: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All sheets of the .xlsx files of a folder; one task a file or more, each smaller than 2 GB."""
    return parse_workbooks(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path), preview)


def with_header(rows: DataFrame, sheet: str) -> DataFrame:
    """One sheet as a table of strings named by its first row; that row must be alike in all files."""
    rows = rows.where(F.col("sheet") == sheet)
    heads = [r["cells"] for r in rows.where("row = 1").select("cells").distinct().limit(2).collect()]
    if len(heads) != 1:
        raise ValueError(f"sheet {sheet} has {'no header' if not heads else 'several headers'}")
    return rows.where("row > 1").select("path", *[F.get("cells", F.lit(i)).alias(name or f"column_{i + 1}") for i, name in enumerate(heads[0])])
