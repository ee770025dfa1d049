"""OOXML workbooks as cell rows: values, formulas with shared ones written out, formats, hidden parts."""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.formulas import name_cell, split_cell

FILE_BYTES, PARTS, UNPACKED, MEMBER, RATIO, SHEETS, CELLS, DECLARED = 100 << 20, 10_000, 500 << 20, 100 << 20, 200, 512, 5_000_000, 20_000_000
SCHEMA = "path string, sheet string, ref string, row int, col int, kind string, value string, formula string, number_format string, hidden boolean, code string"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Built-in number formats that are dates or times.
DATES = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_MOVED = re.compile(r"(\$?)([A-Z]{1,3})(\$?)([1-9]\d*)(?![\w(])")


class Refused(ValueError):
    """The workbook isn't read; the message is a code."""


def preflight(content: bytes) -> zipfile.ZipFile:
    """The open archive, after limits on its directory hold."""
    if len(content) > FILE_BYTES:
        raise Refused("excel_file_size_limit")
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, OSError, ValueError) as error:
        raise Refused("unreadable_openxml_archive") from error
    infos = z.infolist()
    if len(infos) > PARTS:
        raise Refused("ooxml_entry_count_limit")
    if sum(i.file_size for i in infos) > UNPACKED:
        raise Refused("ooxml_uncompressed_size_limit")
    if any(i.file_size > MEMBER for i in infos):
        raise Refused("ooxml_member_size_limit")
    if any(i.file_size > RATIO * max(1, i.compress_size) for i in infos):
        raise Refused("ooxml_compression_ratio_limit")
    sheets = [i.filename for i in infos if i.filename.startswith("xl/worksheets/") and i.filename.endswith(".xml")]
    if len(sheets) > SHEETS:
        raise Refused("excel_sheet_count_limit")
    if sum(_declared(z, n) for n in sheets) > DECLARED:
        raise Refused("excel_declared_cell_limit")
    return z


def _declared(z: zipfile.ZipFile, name: str) -> int:
    """Cells of the range that a sheet says it has; it comes before the cells."""
    with z.open(name) as f:
        found = re.search(rb'<(?:\w+:)?dimension\b[^>]*\bref="([A-Z]+)([0-9]+)(?::([A-Z]+)([0-9]+))?"', f.read(1 << 16))
    if not found or not found[3]:
        return 0
    (r1, c1), (r2, c2) = (split_cell((found[i] + found[i + 1]).decode()) for i in (1, 3))
    return max(0, r2 - r1 + 1) * max(0, c2 - c1 + 1)


def _part(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    return _safe(z.read(name)) if name in z.namelist() else None


def _safe(data: bytes) -> ET.Element:
    if re.search(rb"<!\s*(DOCTYPE|ENTITY)", data, re.IGNORECASE):
        raise Refused("unreadable_openxml_workbook")
    return ET.fromstring(data)


def _formats(z: zipfile.ZipFile) -> list[tuple[str, bool]]:
    """Number format and whether it is a date, by cell style."""
    root = _part(z, "xl/styles.xml")
    if root is None:
        return []
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{MAIN}numFmt")}
    out = []
    for xf in root.findall(f"{MAIN}cellXfs/{MAIN}xf"):
        n = int(xf.get("numFmtId", 0))
        code = own.get(n, "General" if n == 0 else f"builtin:{n}")
        out.append((code, n in DATES or (n in own and date_format(code))))
    return out


def date_format(code: str) -> bool:
    """Whether a number format of the workbook's own shows dates or times: letters of them beside quoted text, and no digits."""
    plain = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code)
    return bool(re.search(r"[ymdhs]", plain, re.IGNORECASE)) and "0" not in plain


def moved(formula: str, rows: int, cols: int) -> str:
    """A shared formula as it reads in a cell that many rows and columns away; absolute parts stay."""

    def one(m: re.Match) -> str:
        row, col = split_cell(m[2] + m[4])
        row, col = row + (0 if m[3] else rows), col + (0 if m[1] else cols)
        ref = name_cell(row, col)
        letters = re.match("[A-Z]+", ref)[0]
        return f"{m[1]}{letters}{m[3]}{row}"

    return "".join(p if p.startswith('"') else _MOVED.sub(one, p) for p in re.split(r'("[^"]*")', formula))


def _number(text: str, is_date: bool, base: dt.datetime) -> tuple[str, str]:
    try:
        number = Decimal(text)
    except InvalidOperation:
        return "text", text
    if is_date:
        moment = base + dt.timedelta(seconds=round(float(number) * 86400))
        if number < 1:
            return "time", moment.time().isoformat()
        return ("date", moment.date().isoformat()) if number == number.to_integral_value() else ("datetime", moment.isoformat())
    value = float(text)
    return "number", str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def cells(content: bytes) -> Iterator[dict]:
    """Cells of all sheets, in order."""
    z = preflight(content)
    try:
        book, rels = _part(z, "xl/workbook.xml"), _part(z, "xl/_rels/workbook.xml.rels")
        if book is None or rels is None:
            raise Refused("unreadable_openxml_workbook")
        targets = {r.get("Id"): r.get("Target", "") for r in rels}
        shared_root = _part(z, "xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in shared_root] if shared_root is not None else []
        formats = _formats(z)
        flag = book.find(f"{MAIN}workbookPr")
        base = dt.datetime(1904, 1, 1) if flag is not None and flag.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)
        count = 0
        for sheet in book.iter(f"{MAIN}sheet"):
            target = targets.get(sheet.get(f"{REL}id"), "")
            name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            root = _part(z, name)
            if root is None:
                continue
            off = sheet.get("state", "visible") != "visible"
            columns = [(int(c.get("min")), int(c.get("max"))) for c in root.iter(f"{MAIN}col") if c.get("hidden") in ("1", "true")]
            masters: dict[str, tuple[str, int, int]] = {}
            for row in root.iter(f"{MAIN}row"):
                hidden_row = off or row.get("hidden") in ("1", "true")
                for c in row.iter(f"{MAIN}c"):
                    count += 1
                    if count > CELLS:
                        raise Refused("excel_cell_count_limit")
                    ref = c.get("r")
                    at, col = split_cell(ref)
                    style = int(c.get("s", 0))
                    code, is_date = formats[style] if style < len(formats) else ("General", False)
                    f, v, kind = c.find(f"{MAIN}f"), c.find(f"{MAIN}v"), c.get("t", "n")
                    formula = None
                    if f is not None:
                        formula = f.text
                        if f.get("t") == "shared":
                            if formula:
                                masters[f.get("si")] = (formula, at, col)
                            elif f.get("si") in masters:
                                text, r0, c0 = masters[f.get("si")]
                                formula = moved(text, at - r0, col - c0)
                        formula = None if formula is None else f"={formula}"
                    raw = v.text if v is not None else None
                    if kind == "inlineStr":
                        kind, raw = "text", "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                    elif kind == "s":
                        kind, raw = "text", shared[int(raw)] if raw is not None and int(raw) < len(shared) else None
                    elif kind == "n" and raw is not None:
                        kind, raw = _number(raw, is_date, base)
                    else:
                        kind = {"str": "text", "b": "boolean", "e": "error", "n": "empty"}.get(kind, kind)
                    yield {"sheet": sheet.get("name"), "ref": ref, "row": at, "col": col, "kind": kind, "value": raw, "formula": formula, "number_format": code, "hidden": hidden_row or any(a <= col <= b for a, b in columns)}
    except (ET.ParseError, KeyError, zipfile.BadZipFile, TypeError, AttributeError) as error:
        raise Refused("unreadable_openxml_workbook") from error


def read(files: DataFrame) -> DataFrame:
    """Rows as SCHEMA for the cells of files (path, content); a refused workbook gives one row with a code."""
    text = ("path", "sheet", "ref", "kind", "value", "formula", "number_format", "code")
    schema = pa.schema([(n, pa.string() if n in text else pa.bool_() if n == "hidden" else pa.int32()) for n in (p.split()[0] for p in SCHEMA.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    for c in cells(content or b""):
                        rows.append({"path": path, **c})
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                except Refused as error:
                    rows.append({"path": path, "kind": "refused", "code": str(error)})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", F.col("content").alias("content")).mapInArrow(run, SCHEMA)


STRUCTURE = "path string, kind string, sheet string, name string, ref string, value string"


def structure(content: bytes) -> Iterator[dict]:
    """What a workbook has beside cells: sheets and their state, tables, merged ranges, defined names, calculation mode, macros, external links."""
    z = preflight(content)
    try:
        book, rels = _part(z, "xl/workbook.xml"), _part(z, "xl/_rels/workbook.xml.rels")
        if book is None or rels is None:
            raise Refused("unreadable_openxml_workbook")
        targets = {r.get("Id"): r.get("Target", "") for r in rels}
        names = z.namelist()
        calc = book.find(f"{MAIN}calcPr")
        yield {"kind": "calculation", "value": "auto" if calc is None else calc.get("calcMode", "auto")}
        yield {"kind": "macros", "value": str(any(n.lower().endswith("vbaproject.bin") for n in names)).lower()}
        yield {"kind": "external_links", "value": str(any(n.startswith("xl/externalLinks/") for n in names)).lower()}
        order = [s.get("name") for s in book.iter(f"{MAIN}sheet")]
        for d in book.iter(f"{MAIN}definedName"):
            at = d.get("localSheetId")
            yield {"kind": "defined_name", "name": d.get("name"), "value": d.text, "sheet": order[int(at)] if at and int(at) < len(order) else None}
        for sheet in book.iter(f"{MAIN}sheet"):
            target = targets.get(sheet.get(f"{REL}id"), "")
            name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            yield {"kind": "sheet", "sheet": sheet.get("name"), "value": sheet.get("state", "visible")}
            root = _part(z, name)
            if root is None:
                continue
            for m in root.iter(f"{MAIN}mergeCell"):
                yield {"kind": "merged", "sheet": sheet.get("name"), "ref": m.get("ref")}
            folder, _, leaf = name.rpartition("/")
            own = _part(z, f"{folder}/_rels/{leaf}.rels")
            for r in own if own is not None else ():
                if r.get("Type", "").endswith("/table"):
                    part = r.get("Target", "")
                    table = _part(z, part.lstrip("/") if part.startswith("/") else posixpath.normpath(f"{folder}/{part}"))
                    if table is not None:
                        yield {"kind": "table", "sheet": sheet.get("name"), "name": table.get("displayName") or table.get("name"), "ref": table.get("ref")}
    except (ET.ParseError, KeyError, zipfile.BadZipFile, TypeError, AttributeError, ValueError) as error:
        raise Refused("unreadable_openxml_workbook") from error


def read_structure(files: DataFrame) -> DataFrame:
    """Rows as STRUCTURE for files (path, content); a refused workbook has one row with its code as value."""
    schema = pa.schema([(n, pa.string()) for n in (p.split()[0] for p in STRUCTURE.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows = [{"path": path, **r} for r in structure(content or b"")]
                except Refused as error:
                    rows = [{"path": path, "kind": "refused", "value": str(error)}]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "content").mapInArrow(run, STRUCTURE)


def declared_tables(found: DataFrame) -> DataFrame:
    """(path, sheet, name, first, last): the rows of the tables that workbooks name, of read_structure's rows."""
    rows = F.regexp_extract_all("ref", F.lit("[A-Z]+([0-9]+)"), F.lit(1))
    return found.where("kind = 'table'").select("path", "sheet", "name", F.get(rows, F.lit(0)).try_cast("int").alias("first"), F.element_at(rows, -1).try_cast("int").alias("last"))
