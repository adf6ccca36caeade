"""A workbook of tables: one sheet each, a bold header row, numbers as numbers. Sheets are reports, so their rows come to the driver."""

from __future__ import annotations

import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

#: Rows and characters that a sheet and a cell can hold in this format.
MOST_ROWS, MOST_CHARS = 1_048_576, 32_767
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def sheet_name(name: str) -> str:
    return "".join(c for c in name if c not in "[]:*?/\\")[:31]


def _column(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def _cell(at: str, value: object, style: int = 0) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{at}"><v>{value}</v></c>'
    text = "".join(c for c in str(value) if c >= " " or c in "\t\n")[:MOST_CHARS]
    return f'<c r="{at}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _sheet(columns: list[str], rows: list[tuple]) -> str:
    body = [(columns, 1), *((row, 0) for row in rows)]
    lines = ["".join(_cell(f"{_column(j)}{i}", v, style) for j, v in enumerate(row)) for i, (row, style) in enumerate(body, 1)]
    return f'{_XML}<worksheet xmlns="{_SHEET}"><sheetData>' + "".join(f'<row r="{i}">{line}</row>' for i, line in enumerate(lines, 1)) + "</sheetData></worksheet>"


def write_xlsx(path: str | Path, sheets: dict[str, DataFrame]) -> None:
    """``sheets`` by name, in order. A table of more rows than a sheet holds is an error, not a shorter sheet."""
    parts = {}
    for i, (name, df) in enumerate(sheets.items(), 1):
        rows = [tuple(r) for r in df.limit(MOST_ROWS).collect()]
        if len(rows) >= MOST_ROWS:
            raise ValueError(f"{name} has more rows than a sheet holds: write it as a table")
        parts[f"xl/worksheets/sheet{i}.xml"] = _sheet(df.columns, rows)
    n = len(parts)
    book = "".join(f'<sheet name="{escape(sheet_name(name))}" sheetId="{i}" r:id="r{i}"/>' for i, name in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = f'{_XML}<workbook xmlns="{_SHEET}" xmlns:r="{_LINK}"><sheets>{book}</sheets></workbook>'
    links = "".join(f'<Relationship Id="r{i}" Type="{_LINK}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1))
    parts["xl/_rels/workbook.xml.rels"] = f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships">{links}<Relationship Id="s" Type="{_LINK}/styles" Target="styles.xml"/></Relationships>'
    parts["xl/styles.xml"] = f'{_XML}<styleSheet xmlns="{_SHEET}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>'
    parts["_rels/.rels"] = f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="b" Type="{_LINK}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_TYPE}.worksheet+xml"/>' for i in range(1, n + 1))
    parts["[Content_Types].xml"] = f'{_XML}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{_TYPE}.styles+xml"/>{kinds}</Types>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name in ("[Content_Types].xml", *(p for p in parts if p != "[Content_Types].xml")):
            z.writestr(name, parts[name])
