import json
import struct

import pytest

from ledgerlens.plans import package
from ledgerlens.sources import schemas, xls
from test_package import CONTEXT


def rec(kind, *parts):
    data = b"".join(parts)
    return struct.pack("<HH", kind, len(data)) + data


def short(text, wide=False):
    return struct.pack("<HB", len(text), int(wide)) + (text.encode("utf-16-le") if wide else text.encode("latin-1"))


def cell(kind, row, col, style, data):
    return rec(kind, struct.pack("<HHH", row, col, style), data)


def biff(cells, strings):
    """A workbook stream: globals, and one sheet of cell records."""
    sst = struct.pack("<II", len(strings), len(strings)) + b"".join(short(s, not s.isascii()) for s in strings)
    shared = rec(xls.STRINGS, sst)
    bof = rec(xls.BOF, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0))
    start = bof + rec(xls.DATEMODE, b"\0\0") + rec(xls.FORMAT, struct.pack("<H", 164), short("dd.mm.yyyy")) + b"".join(rec(xls.STYLE, struct.pack("<HH", 0, n), bytes(16)) for n in (0, 164, 14)) + shared
    size = len(start) + len(rec(xls.SHEET, bytes(6), b"\x03\x00LSR")) + len(rec(xls.EOF))
    sheet = rec(xls.SHEET, struct.pack("<IBB", size, 0, 0), b"\x03\x00LSR")
    return start + sheet + rec(xls.EOF) + bof + b"".join(cells) + rec(xls.EOF)


def compound(data, small=False):
    """A compound file that holds the stream, among small ones or in sectors of its own."""
    if small:
        inner, n = data + bytes(-len(data) % 64), -(-len(data) // 64)
        mini = list(range(1, n)) + [xls.END]
        body, root = inner + bytes(-len(inner) % 512), (2, len(inner))
        own, first_mini = (0, len(data)), 2 + len(inner + bytes(-len(inner) % 512)) // 512
        body += struct.pack(f"<{n}I", *mini) + b"\xff" * (-4 * n % 512)
        chains = [(2, len(inner + bytes(-len(inner) % 512)) // 512), (first_mini, -(-4 * n // 512))]
    else:
        data = data + bytes(max(0, 4096 - len(data)))
        body, root, own, first_mini = data + bytes(-len(data) % 512), (xls.END, 0), (2, len(data)), xls.END
        chains = [(2, -(-len(data) // 512))]
    fat = [0xFFFFFFFD, xls.END] + [xls.FREE] * 126
    for first, n in chains:
        for i in range(n):
            fat[first + i] = first + i + 1 if i + 1 < n else xls.END
    entry = lambda name, kind, at, size: (name.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + b"\xff" * 12 + bytes(36) + struct.pack("<IIQ", *([at, size & 0xFFFFFFFF, 0]))[:12]
    folder = b"".join(entry(*x).ljust(128, b"\0") for x in (("Root Entry", 5, *root), ("Workbook", 2, *own))) + bytes(256)
    head = xls.MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, 1, 1, 0, 4096, first_mini, 1 if small else 0, xls.END, 0) + struct.pack("<109I", 0, *[xls.FREE] * 108)
    assert len(head) == 512
    return head + struct.pack("<128I", *fat) + folder + body


STRINGS = ["№", "Наименование", "Ед. изм.", "Количество", "Цена за единицу", "Сумма", "brick", "pcs"]
CELLS = [cell(xls.LABELSST, 0, i, 0, struct.pack("<I", i)) for i in range(6)] + [
    cell(xls.NUMBER, 1, 0, 0, struct.pack("<d", 1)), cell(xls.LABELSST, 1, 1, 0, struct.pack("<I", 6)), cell(xls.LABELSST, 1, 2, 0, struct.pack("<I", 7)), rec(xls.MULRK, struct.pack("<HH", 1, 3), struct.pack("<HI", 0, 2 << 2 | 2), struct.pack("<HI", 0, 1050 << 2 | 3), struct.pack("<H", 4)),
    cell(xls.FORMULA, 1, 5, 0, struct.pack("<d", 21.0) + bytes(8)), cell(xls.RK, 3, 0, 1, struct.pack("<I", 45000 << 2 | 2)), cell(xls.BOOLERR, 3, 1, 0, b"\x01\x00"), cell(xls.BOOLERR, 3, 2, 0, b"\x07\x01"),
    cell(xls.FORMULA, 3, 3, 0, b"\x00" + bytes(5) + b"\xff\xff" + bytes(8)), rec(xls.STRING, short("said")), cell(xls.LABEL, 3, 4, 0, short("plain")), cell(xls.FORMULA, 3, 5, 0, b"\x02\x00\x2a" + bytes(3) + b"\xff\xff" + bytes(8)),
]


@pytest.mark.parametrize("small", [False, True])
def test_cells_of_a_binary_workbook(small):
    got = {c["ref"]: c for c in xls.cells(compound(biff(CELLS, STRINGS), small))}
    assert (got["B1"]["value"], got["B2"]["value"], got["D2"]["value"], got["E2"]["value"], got["F2"]["value"], got["F2"]["code"]) == ("Наименование", "brick", "2", "10.5", "21", "legacy_xls_formula_metadata_unavailable")
    assert [(got[f"{c}4"]["kind"], got[f"{c}4"]["value"]) for c in "ABCDEF"] == [("date", "2023-03-15"), ("boolean", "1"), ("error", "#DIV/0!"), ("text", "said"), ("text", "plain"), ("error", "#N/A")]
    assert got["A4"]["number_format"] == "dd.mm.yyyy" and got["A1"]["sheet"] == "LSR" and not got["A1"]["hidden"]


def test_strings_that_go_on_in_another_record():
    narrow = ["abcdef", "xyz"]
    sst = struct.pack("<II", 2, 2) + b"".join(short(s) for s in narrow)
    assert xls._strings([sst[:14], b"\x00" + sst[14:]]) == narrow  # within the letters of the first
    wide = struct.pack("<II", 1, 1) + short("жук", True)[:5]
    assert xls._strings([wide, b"\x01" + "ук".encode("utf-16-le")]) == ["жук"]
    assert xls._strings([struct.pack("<II", 1, 1) + struct.pack("<HB", 4, 0) + b"ab", b"\x01" + "жз".encode("utf-16-le")]) == ["abжз"]
    rich = struct.pack("<II", 2, 2) + struct.pack("<HBH", 2, 8, 1) + b"ok" + bytes(4) + short("next")
    assert xls._strings([rich]) == ["ok", "next"]


def test_broken_binary_workbooks():
    good = compound(biff(CELLS, STRINGS))
    loop = bytearray(good)
    struct.pack_into("<I", loop, 512 + 8, 2)  # the stream's first sector leads to itself
    for bad in (b"", b"x" * 600, good[:600], bytes(loop), xls.MAGIC + bytes(504), compound(rec(xls.BOF, struct.pack("<H", 0x500), bytes(14))), compound(biff(CELLS, STRINGS).replace(rec(xls.DATEMODE, b"\0\0"), rec(xls.LOCKED, b"\0\0")))):
        with pytest.raises(xls.Refused):
            list(xls.cells(bad))


def test_binary_workbook_in_a_package(spark, tmp_path):
    (tmp_path / "old.xls").write_bytes(compound(biff(CELLS, STRINGS)))
    out = package.inspect(spark, str(tmp_path), "full", "check", CONTEXT)
    assert [(i["path"], i["extraction_status"]) for i in out["input_inventory"]] == [("old.xls", "partial")] and out["coverage"]["extracted_records"] == 1
    assert "legacy_xls_formula_metadata_unavailable" in {x["code"] for x in out["limitations"]}


def test_schema_store(spark):
    one = {"schema_id": "a", "root": "R", "extensions": ["xml"], "path": "s/a.xsd", "sha256": "A" * 64, "source_url": "https://host/a.zip"}
    text = json.dumps({"network_resolution": False, "schemas": [one, one | {"schema_id": "b", "path": "b.xsd"}, one | {"schema_id": "c", "path": "c.xsd"}]})
    known = schemas.registry(spark, text, {"host"})
    files = spark.createDataFrame([("s/a.xsd", "a" * 64), ("b.xsd", "b" * 64)], "path string, sha256 string")
    assert {r.schema_id: r.state for r in schemas.verified(known, files).collect()} == {"a": "ok", "b": "changed", "c": "missing"}
    assert [r.schema_id for r in schemas.trusted(known, files).collect()] == ["a"]
    for bad in ({"network_resolution": True, "schemas": []}, {"schemas": []}, {"network_resolution": False, "schemas": [one, one]}, {"network_resolution": False, "schemas": [one | {"path": "../x"}]}, {"network_resolution": False, "schemas": [one | {"sha256": "1"}]}, {"network_resolution": False, "schemas": [{}]}):
        with pytest.raises(schemas.Refused):
            schemas.registry(spark, json.dumps(bad))
    for url in ("http://host/x", "https://other/x", "https://u@host/x", "https://host:8443/x"):
        with pytest.raises(schemas.Refused):
            schemas.check_url(url, {"host"})
