"""Spreadsheets of one sheet, written and read as bytes: rating samples for people, and tables that people send."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Rows of a sheet that a spreadsheet program opens.
MOST_ROWS = 1_048_576


def sheet_bytes(columns: list[str], rows: list[tuple]) -> bytes:
    """A workbook with one sheet: a header, then rows; nulls are blank cells, numbers stay numbers."""
    if len(rows) >= MOST_ROWS:
        raise ValueError(f"a sheet has at most {MOST_ROWS} rows; split the table")

    def cell(v: object) -> str:
        if v is None or v != v:
            return "<c/>"
        if isinstance(v, int | float) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿\ud800-\udfff]", " ", str(v))
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    lines = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [tuple(columns), *rows])
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="sample" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_MAIN}"><sheetData>{lines}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def sheets(df: DataFrame, key: str, order: list[str], *, rows: int = 100_000) -> DataFrame:
    """path, content: a workbook for each value of `key`, in parts of at most `rows` rows, rows in `order`. The key is no column of the sheet."""
    from scorewright.operators.scan import numbered

    columns = [c for c in df.columns if c != key]
    placed = numbered(df, [key], order, "place_").withColumn("part_", F.floor((F.col("place_") - 1) / rows))

    def write(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place_")[columns].astype(object)
        told = [tuple(v.item() if hasattr(v, "item") else v for v in r) for r in part.itertuples(index=False, name=None)]
        return pd.DataFrame({"path": [f"{group[0]}_{int(group[1])}.xlsx"], "content": [sheet_bytes(columns, told)]})

    return placed.groupBy(key, "part_").applyInPandas(write, "path string, content binary")


def _cells(content: bytes) -> Iterator[list[str]]:
    """Rows of a workbook's first sheet as texts; cells keep their columns where blank ones are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = ["".join(t.text or "" for t in s.iter(f"{{{_MAIN}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{{{_MAIN}}}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        with z.open("xl/worksheets/sheet1.xml") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{{{_MAIN}}}row":
                    continue
                out: list[str] = []
                for c in row.iter(f"{{{_MAIN}}}c"):
                    letters = re.match("[A-Z]+", c.get("r") or "")
                    at = sum(26**i * (ord(x) - 64) for i, x in enumerate(reversed(letters[0]))) - 1 if letters else len(out)
                    v = c.find(f"{{{_MAIN}}}v")
                    said = shared[int(v.text)] if c.get("t") == "s" and v is not None else v.text if v is not None else "".join(t.text or "" for t in c.iter(f"{{{_MAIN}}}t"))
                    out += [""] * (at + 1 - len(out))
                    out[at] = said or ""
                yield out
                row.clear()


def sheet_rows(files: DataFrame, columns: list[str]) -> DataFrame:
    """path, row_ord, columns, error: rows of workbooks (path, content) that have all `columns` in their header.

    A workbook that lacks some, or cannot be read, is one row with an error code and
    row_ord -1: missing_columns:<names>, no_rows or unreadable_xlsx. Rows without any value are passed over.
    """
    names = ["path", "row_ord", *columns, "error"]

    def one(path: str, content: bytes) -> Iterator[tuple]:
        bad = lambda e: (path, -1, *[None] * len(columns), e)
        try:
            lines = _cells(content)
            header = next(lines, None)
            if header is None:
                yield bad("no_rows")
                return
            missing = [c for c in columns if c not in header]
            if missing:
                yield bad("missing_columns:" + ",".join(missing))
                return
            rows = [(k, r) for k, r in enumerate(lines) if any(x.strip() for x in r)]
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, IndexError, ValueError):
            yield bad("unreadable_xlsx")
            return
        where = [header.index(c) for c in columns]
        for k, r in rows:
            yield path, k, *[r[i] if i < len(r) else "" for i in where], None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows = list(one(path, content))
                for lo in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[lo : lo + 10_000], columns=names)

    return files.where("content is not null").select("path", "content").mapInPandas(read, "path string, row_ord long, " + ", ".join(f"`{c}` string" for c in columns) + ", error string")
