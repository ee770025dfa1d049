"""Workbooks of the old binary format as cell rows: compound files, and the records of their workbook stream.

Only cached values are read: a formula's own text would need the parser of its tokens, so such files are partial.
"""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlens.operators.formulas import name_cell
from ledgerlens.sources.workbooks import CELLS, DATES, FILE_BYTES, SCHEMA, SHEETS, Refused, _number, date_format

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
END, FREE = 0xFFFFFFFE, 0xFFFFFFFF
# The numbers of the records that are read, and the texts of error cells.
BOF, EOF, SHEET, STRINGS, CONTINUE, FORMAT, STYLE, DATEMODE, LOCKED = 0x809, 0x0A, 0x85, 0xFC, 0x3C, 0x41E, 0xE0, 0x22, 0x2F
NUMBER, RK, MULRK, LABEL, LABELSST, BOOLERR, FORMULA, STRING = 0x203, 0x27E, 0xBD, 0x204, 0xFD, 0x205, 0x06, 0x207
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


def _chain(table: list[int], first: int) -> Iterator[int]:
    seen = 0
    while first not in (END, FREE):
        seen += 1
        if first >= len(table) or seen > len(table):
            raise Refused("unreadable_xls_workbook")
        yield first
        first = table[first]


def stream(content: bytes, names: tuple[str, ...] = ("Workbook", "Book")) -> bytes:
    """The first of the named streams of a compound file."""
    if len(content) < 512 or content[:8] != MAGIC:
        raise Refused("unreadable_xls_workbook")
    size, small = 1 << struct.unpack_from("<H", content, 30)[0], 1 << struct.unpack_from("<H", content, 32)[0]
    first_dir, cutoff, first_mini, _, first_more, n_more = (struct.unpack_from("<I", content, at)[0] for at in (48, 56, 60, 64, 68, 72))
    if size not in (512, 4096) or small != 64:
        raise Refused("unreadable_xls_workbook")

    def sector(i: int) -> bytes:
        data = content[(i + 1) * size : (i + 2) * size]
        return data + bytes(size - len(data))

    blocks, at = [i for i in struct.unpack_from("<109I", content, 76) if i != FREE], first_more
    for _ in range(n_more):
        more = struct.unpack(f"<{size // 4}I", sector(at))
        blocks += [i for i in more[:-1] if i != FREE]
        at = more[-1]
    if len(blocks) * size > len(content):
        raise Refused("unreadable_xls_workbook")
    table = [x for i in blocks for x in struct.unpack(f"<{size // 4}I", sector(i))]
    entries = b"".join(sector(i) for i in _chain(table, first_dir))
    found = {}
    for at in range(0, len(entries) - 127, 128):
        n, kind = struct.unpack_from("<HB", entries, at + 64)
        name = entries[at : at + max(0, min(n, 64) - 2)].decode("utf-16-le", "replace")
        found.setdefault("/" if kind == 5 else name, struct.unpack_from("<II", entries, at + 116))
    own = next((found[n] for n in names if n in found), None)
    if own is None or "/" not in found:
        raise Refused("unreadable_xls_workbook")
    if own[1] >= cutoff:
        return b"".join(sector(i) for i in _chain(table, own[0]))[: own[1]]
    mini = [x for i in _chain(table, first_mini) for x in struct.unpack(f"<{size // 4}I", sector(i))]
    inner = b"".join(sector(i) for i in _chain(table, found["/"][0]))
    return b"".join(inner[i * 64 : (i + 1) * 64] for i in _chain(mini, own[0]))[: own[1]]


def _records(data: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes], int]]:
    """(kind, parts, place) of records; the parts after the first are what continues it."""
    while at + 4 <= len(data):
        place = at
        kind, n = struct.unpack_from("<HH", data, at)
        parts = [data[at + 4 : at + 4 + n]]
        at += 4 + n
        while at + 4 <= len(data) and struct.unpack_from("<H", data, at)[0] == CONTINUE:
            n = struct.unpack_from("<H", data, at + 2)[0]
            parts.append(data[at + 4 : at + 4 + n])
            at += 4 + n
        yield kind, parts, place


def _strings(parts: list[bytes]) -> list[str]:
    """Shared strings. A string's letters may go on in the next part, which says anew how wide they are."""
    total = struct.unpack_from("<I", parts[0], 4)[0]
    out: list[str] = []
    part, at = 0, 8

    def take(n: int) -> bytes:
        nonlocal part, at
        got = b""
        while len(got) < n:
            if at >= len(parts[part]):
                part, at = part + 1, 0
            got += parts[part][at : at + n - len(got)]
            at = min(len(parts[part]), at + n)
        return got

    while len(out) < total:
        if at >= len(parts[part]):
            part, at = part + 1, 0
        n, flags = struct.unpack("<HB", take(3))
        runs = struct.unpack("<H", take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", take(4))[0] if flags & 4 else 0
        letters, wide = "", flags & 1
        while n:
            if at >= len(parts[part]):
                part, at = part + 1, 1
                wide = parts[part][0] & 1
            have = min(n, (len(parts[part]) - at) // (2 if wide else 1))
            raw = parts[part][at : at + have * (2 if wide else 1)]
            letters += raw.decode("utf-16-le", "replace") if wide else raw.decode("latin-1")
            at += len(raw)
            n -= have
            if not have and at < len(parts[part]):
                raise Refused("unreadable_xls_workbook")
        rest = runs * 4 + extra
        while rest:
            if at >= len(parts[part]):
                part, at = part + 1, 0
            step = min(rest, len(parts[part]) - at)
            at, rest = at + step, rest - step
        out.append(letters)
    return out


def _text(data: bytes, wide_count: bool = True) -> str:
    n = struct.unpack_from("<H" if wide_count else "<B", data)[0]
    at = 2 if wide_count else 1
    return data[at + 1 : at + 1 + 2 * n].decode("utf-16-le", "replace") if data[at] & 1 else data[at + 1 : at + 1 + n].decode("latin-1")


def _rk(raw: int) -> float:
    value = float((raw - (1 << 32) if raw >> 31 else raw) >> 2) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


def cells(content: bytes) -> Iterator[dict]:
    """Cells of all sheets with cached values, as workbooks.cells gives them; formulas are marked `partial` by their code."""
    if len(content) > FILE_BYTES:
        raise Refused("excel_file_size_limit")
    try:
        yield from _cells(stream(content))
    except (struct.error, IndexError) as error:
        raise Refused("unreadable_xls_workbook") from error


def _cells(data: bytes) -> Iterator[dict]:
    sheets, shared, formats, styles, base = [], [], {}, [], dt.datetime(1899, 12, 30)
    for kind, parts, _ in _records(data):
        own = parts[0]
        if kind == BOF and struct.unpack_from("<H", own)[0] != 0x600:
            raise Refused("unsupported_xls_version")
        if kind == LOCKED:
            raise Refused("encrypted_xls_workbook")
        if kind == SHEET and own[5] == 0:
            sheets.append((_text(own[6:], False), struct.unpack_from("<I", own)[0], own[4] & 3 != 0))
        elif kind == STRINGS:
            shared = _strings(parts)
        elif kind == FORMAT:
            formats[struct.unpack_from("<H", own)[0]] = _text(own[2:])
        elif kind == STYLE:
            styles.append(struct.unpack_from("<H", own, 2)[0])
        elif kind == DATEMODE and struct.unpack_from("<H", own)[0]:
            base = dt.datetime(1904, 1, 1)
        elif kind == EOF:
            break
    if len(sheets) > SHEETS:
        raise Refused("excel_sheet_count_limit")
    count = 0
    for name, place, hidden in sheets:
        waiting = None
        for kind, parts, _ in _records(data, place):
            own, found = parts[0], []
            if kind == EOF:
                break
            if kind == STRING and waiting:
                found, waiting = [(*waiting, ("text", _text(own)), True)], None
            elif kind in (NUMBER, RK, LABEL, LABELSST, BOOLERR, FORMULA):
                row, col, style = struct.unpack_from("<HHH", own)
                value = None
                if kind == NUMBER:
                    value = struct.unpack_from("<d", own, 6)[0]
                elif kind == RK:
                    value = _rk(struct.unpack_from("<I", own, 6)[0])
                elif kind == LABEL:
                    value = ("text", _text(own[6:]))
                elif kind == LABELSST:
                    value = ("text", shared[struct.unpack_from("<I", own, 6)[0]])
                elif kind == BOOLERR:
                    value = ("error", ERRORS.get(own[6], "#ERR")) if own[7] else ("boolean", str(own[6]))
                elif own[12:14] != b"\xff\xff":
                    value = struct.unpack_from("<d", own, 6)[0]
                elif own[6] == 0:
                    waiting = (row, col, style)
                else:
                    value = {1: ("boolean", str(own[8])), 2: ("error", ERRORS.get(own[8], "#ERR"))}.get(own[6], ("empty", None))
                found = [] if value is None else [(row, col, style, value, kind == FORMULA)]
            elif kind == MULRK:
                row, first = struct.unpack_from("<HH", own)
                found = [(row, first + i, *struct.unpack_from("<H", own, 4 + 6 * i), _rk(struct.unpack_from("<I", own, 6 + 6 * i)[0]), False) for i in range((len(own) - 6) // 6)]
            for row, col, style, value, computed in found:
                count += 1
                if count > CELLS:
                    raise Refused("excel_cell_count_limit")
                number = styles[style] if style < len(styles) else 0
                code = formats.get(number, "General" if number == 0 else f"builtin:{number}")
                what, text = value if isinstance(value, tuple) else _number(repr(value), number in DATES or (number in formats and date_format(code)), base)
                yield {"sheet": name, "ref": name_cell(row + 1, col + 1), "row": row + 1, "col": col + 1, "kind": what, "value": text, "formula": None, "number_format": code, "hidden": hidden, "code": "legacy_xls_formula_metadata_unavailable" if computed else None}


def read(files: DataFrame) -> DataFrame:
    """Rows as the SCHEMA of workbooks for files (path, content); a refused file gives one row with a code. No formula has its text."""
    schema = pa.schema([(n, pa.int32() if t == "int" else pa.bool_() if t == "boolean" else pa.string()) for n, t in (p.split() for p in SCHEMA.split(", "))])

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

    return files.select("path", "content").mapInArrow(run, SCHEMA)
