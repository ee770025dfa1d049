import json
import os

import pytest
from pyspark.sql import functions as F
from test_sources import packed

from ledgerlens.functions.evidence import FIELDS
from ledgerlens.plans import context, contract, package
from ledgerlens.sources import canonical, inventory, recognition, workbooks

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
CONTEXT = {k: "x" for k in context.TEXT_FIELDS} | {"document_set": ["LSR"]}


def workbook(rows, extra="", rels="", parts=(), calc=""):
    """A workbook of one sheet; cells are numbers, texts, or (formula, cached value)."""
    lines = []
    for r, cells in rows.items():
        made = "".join(
            f'<c r="{chr(65 + i)}{r}"><f>{v[0]}</f><v>{v[1]}</v></c>' if isinstance(v, tuple) else f'<c r="{chr(65 + i)}{r}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{chr(65 + i)}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
            for i, v in enumerate(cells) if v is not None
        )
        lines.append(f'<row r="{r}">{made}</row>')
    return packed(
        ("xl/workbook.xml", f'<workbook {NS}><sheets><sheet name="LSR" sheetId="1" r:id="rId1"/></sheets>{calc}</workbook>'), ("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>'),
        ("xl/worksheets/sheet1.xml", f'<worksheet {NS}><sheetData>{"".join(lines)}</sheetData>{extra}</worksheet>'), *([("xl/worksheets/_rels/sheet1.xml.rels", rels)] if rels else []), *parts,
    )


HEAD = ["№", "Наименование", "Ед. изм.", "Количество", "Цена за единицу", "Сумма"]


def test_tables_of_a_sheet(spark):
    rows = {
        1: ["Estimate"], 3: HEAD, 4: [1, "brick", "pcs", 2, 10, ("D4*E4", 20)], 5: [2, "sand", "t", 3, 5, 15], 6: [None, "", "", None, None, None, "note"], 7: [3, "lost", "t", 1, 1, 1], 9: ["x", *HEAD[1:]], 10: [4, "steel", "t", 1, 100, ("D10*E10", 99)], 11: HEAD, 12: [5, "last", "m", 1, 2, 2], 14: [6, "apart", "m", 1, 2, 2],
    }
    cells = workbooks.read(spark.createDataFrame([("b.xlsx", bytearray(workbook(rows)))], "path string, content binary"))
    got = {r.row: r for r in canonical.sheet_rows(cells).collect()}
    assert sorted(got) == [4, 5, 10, 12]  # a row blank under the headers, a new header and a gap end a table
    assert got[4].fields["name"] == "brick" and got[4].basis.formula == "quantity * unit_price" and got[4].basis.locator == "LSR!F4" and got[5].basis.formula is None
    declared = spark.createDataFrame([("b.xlsx", "LSR", 3, 14)], "path string, sheet string, first int, last int")
    assert sorted(r.row for r in canonical.sheet_rows(cells, declared).collect() if r.header == 3) == [4, 5, 7, 9, 10, 11, 12, 14]


def below_shuffles(df):
    """What the first plan has below each shuffle."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].split("Exchange hashpartitioning(")[1:]


def test_sheets_are_dealt_once(spark):
    kind = "path string, sheet string, ref string, row int, col int, kind string, value string, formula string"
    head = [("b", "S", None, 1, c, "text", v, None) for c, v in ((2, " Наименование: "), (3, "Qty"), (5, "Quantity"), (4, "Сумма"), (6, "12"))]
    body = [("b", "S", "B2", 2, 2, "text", "x", None), ("b", "S", "E2", 2, 5, "text", "not", None), ("b", "S", "D2", 2, 4, "number", None, "=C2"), ("b", None, "B3", 3, 2, "text", "lost", None), ("b", "S", None, 3, 3, "number", "3", None)]
    got = canonical.sheet_rows(spark.createDataFrame(head + body, kind))
    assert {(r.row, r.fields["name"], r.fields["quantity"], r.fields["amount"], tuple(sorted(r.refs))) for r in got.collect()} == {(2, "x", None, None, ("B2", "C2", "D2")), (3, None, "3", None, ("B3", "C3", "D3"))}
    assert len(below_shuffles(got)) == 1


def test_page_tables_are_dealt_before_they_are_counted(spark):
    kind = "source_path string, page int, table int, row int, col int, text string, x0 double, top double, x1 double, bottom double"
    lines = [["name", "quantity", "Total", "total"], ["a", "1", "2", "3"], ["b", "1", None, "4"]]
    cells = [(p, 1, t, r, c, x, 0.0, 0.0, 1.0, 1.0) for p, t in (("p", 1), ("p", 2), (None, 1)) for r, line in enumerate(lines) for c, x in enumerate(line) if (t, r, c) != (2, 2, 1)]
    got = canonical.page_table_rows(spark.createDataFrame(cells, kind))
    assert {(r.fields["row_id"], r.fields["declared_total"]) for r in got.collect()} == {("p:page:1:table:1:row:1", "2"), ("p:page:1:table:1:row:2", None), ("p:page:1:table:2:row:1", "2")}
    below = below_shuffles(got)
    assert len(below) == 1 and "Aggregate" not in below[0]


def test_structure_of_a_workbook(spark):
    table = '<Relationships xmlns="x"><Relationship Id="t1" Type="http://x/table" Target="../tables/table1.xml"/></Relationships>'
    calc = '<definedNames><definedName name="Rate" localSheetId="0">LSR!$A$1</definedName></definedNames><calcPr calcMode="manual"/>'
    book = workbook({1: HEAD}, '<mergeCells><mergeCell ref="A1:B1"/></mergeCells>', table, [("xl/tables/table1.xml", f'<table {NS} name="T" displayName="T" ref="A1:F2"/>'), ("xl/vbaProject.bin", b"x")], calc)
    huge = workbook({1: HEAD}).replace(b"", b"")
    got = workbooks.read_structure(spark.createDataFrame([("b.xlsx", bytearray(book)), ("h.xlsx", bytearray(huge)), ("bad.xlsx", bytearray(b"z"))], "path string, content binary"))
    rows = {(r.kind, r.sheet, r.name, r.ref, r.value) for r in got.where("path = 'b.xlsx'").collect()}
    assert {("calculation", None, None, None, "manual"), ("macros", None, None, None, "true"), ("external_links", None, None, None, "false"), ("defined_name", "LSR", "Rate", None, "LSR!$A$1"), ("merged", "LSR", None, "A1:B1", None), ("table", "LSR", "T", "A1:F2", None), ("sheet", "LSR", None, None, "visible")} == rows
    assert [tuple(r) for r in workbooks.declared_tables(got).collect()] == [("b.xlsx", "LSR", "T", 1, 2)]
    assert [r.value for r in got.where("kind = 'refused'").collect()] == ["unreadable_openxml_archive"]
    wide = packed(("xl/worksheets/sheet1.xml", f'<worksheet {NS}><dimension ref="A1:XFD1048576"/></worksheet>'))
    with pytest.raises(workbooks.Refused, match="excel_declared_cell_limit"):
        workbooks.preflight(wide)


def test_inspection_of_a_folder(spark, tmp_path):
    rows = {1: HEAD, 2: [1, "brick", "pcs", 2, 10, ("D2*E2", 20)], 3: [2, "sand", "t", 3, 5, ("D3*E3", 16)], 4: [3, "", "t", 1, 1, 1]}
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "a.xlsx").write_bytes(workbook(rows))
    (tmp_path / "in" / "p.zip").write_bytes(packed(("inner/b.xlsx", workbook({1: HEAD, 2: [9, "zip", "m", 1, 7, ("D2*E2", 7)]})), ("d.xml", "<Construction><Name>n</Name></Construction>"), ("u.xml", "<other/>")))
    (tmp_path / "in" / "old.xls").write_bytes(b"old")
    (tmp_path / "in" / "q.pdf").write_bytes(b"%PDF")
    (tmp_path / "in" / "empty.txt").write_bytes(b"")
    root = str(tmp_path / "in")
    registry = spark.createDataFrame([("minstroy.local_estimate_rim.3_01", "Construction", None, ["xml"])], "schema_id string, root string, namespace string, extensions array<string>")
    out = package.inspect(spark, root, "full", "check", CONTEXT, registry=registry)
    contract.validate(out)
    assert str(tmp_path) not in json.dumps(out)
    assert {i["path"]: i["extraction_status"] for i in out["input_inventory"]} == {"sub/a.xlsx": "reliable", "p.zip": "reliable", "old.xls": "failed", "empty.txt": "not_inspected", "q.pdf": "not_inspected", "p.zip!/inner/b.xlsx": "reliable", "p.zip!/d.xml": "reliable", "p.zip!/u.xml": "not_inspected"}
    details = {i["path"]: i["details"] for i in out["input_inventory"]}
    assert details["sub/a.xlsx"] == {"sheet_count": "1", "hidden_sheet_count": "0", "merged_range_count": "0", "defined_name_count": "0", "table_count": "0", "calculation": "auto", "macros": "false", "external_links": "false", "cell_count": "24", "formula_count": "2", "missing_cached_formula_value_count": "0"} and details["old.xls"] is None
    checks = {c["id"]: c["status"] for c in out["checks"]}
    assert checks["ARITH-01"] == "finding" and checks["FORMULA-01"] == "finding" and checks["INV-01"] == "limited" and checks["FULL-ROW-01"] == "needs_input"
    assert [f["id"] for f in out["findings"] if f["id"].startswith("ARITH")] == ["ARITH-01:sub/a.xlsx:LSR:3"]
    assert out["coverage"]["extracted_records"] == 4 and out["execution_status"] == "needs_input" and "check:FIELD-01" in out["questions"][0]["missing_fields"]
    assert {x["code"] for x in out["limitations"]} >= {inventory.UNSUPPORTED, "xml_schema_unknown", "full_control_matrix_incomplete", "full_row_controls_incomplete"}
    blocked = package.inspect(spark, root, "full", None, CONTEXT | {"stage": " "})
    assert [c["id"] for c in blocked["checks"]] == package.BLOCKED and {c["status"] for c in blocked["checks"]} == {"needs_input"} and blocked["questions"][0]["missing_fields"] == ["purpose", "stage"] and blocked["findings"] == []
    os.symlink(root, tmp_path / "in" / "loop")
    refused = package.inspect(spark, root, "light", "check", CONTEXT)
    assert refused["overall_status"] == "verification_impossible" and refused["execution_status"] in ("failed", "needs_input") and refused["limitations"][0]["code"] == "input_symlink_forbidden"


def test_clean_rows_that_are_attested_are_covered(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook({1: HEAD, 2: [1, "brick", "pcs", 2, 10, ("D2*E2", 20)]}))
    told = {"a.xlsx:LSR:2": {"completed_dimensions": context.DIMENSIONS, "evidence": [{"source_path": "a.xlsx", "locator": "LSR!2:2"}]}}
    out = package.inspect(spark, str(tmp_path / "a.xlsx"), "full", "check", CONTEXT, coverage=told)
    assert out["coverage"]["row_level_checked"] and out["coverage"]["checked_records"] == 1 and {c["id"]: c["status"] for c in out["checks"]}["FULL-ROW-01"] == "passed"
    light = package.inspect(spark, str(tmp_path / "a.xlsx"), "light", "check", CONTEXT, coverage=told)
    assert light["coverage"]["checked_records"] == 0 and not light["coverage"]["row_level_checked"]


def test_routing_and_generic_tables(spark):
    place = [None] * len(FIELDS)
    made = [("estimate_row", {"row_id": "r", "amount": "5", "price": "2", "index": "1.1"}, None, "s", "l", *place[2:]), (" KAC ", {"kac_id": "k", "price": "3"}, "partial", "s", "l2", *place[2:]), ("unknown", {}, None, "s", "l", *place[2:])]
    model = canonical.routed(spark.createDataFrame(made, canonical.RECORD))
    row = model["rows"].first()
    assert (row.declared_total, row.unit_price, row.reliability) == ("5", "2", "reliable") and [r.reliability for r in model["kacs"].collect()] == ["partial"]
    assert [(r.index_id, r.value) for r in model["indices"].collect()] == [("r:index", "1.1")] and model["coefficients"].count() == 0
    tables = spark.createDataFrame([("f", None, 2, None, None, None, [["Наименование", "Количество", "Всего"], ["a", "1", "2"], ["b"]]), ("g", "S", None, "A1:B2", "e", ["name", "?", "total"], [["x", "y", "7"]]), ("h", None, None, None, None, None, [["name"], ["q"]])], "source_path string, sheet string, page int, range string, estimate_id string, headers array<string>, rows array<array<string>>")
    got = {r.fields["row_id"]: r for r in canonical.table_records(tables).collect()}
    assert sorted(got) == ["f:2:1", "g:S:1"] and got["f:2:1"].fields["quantity"] == "1" and got["f:2:1"].locator == "page:2!row:1" and got["g:S:1"].fields["estimate_id"] == "e" and got["g:S:1"].locator == "S!A1:B2"
    cells = [("p", 1, 1, r, c, t, 0.0, 0.0, 0.0 if t == "bad" else 1.0, 1.0) for r, line in enumerate([["name", "quantity", "total"], ["a", "1", "2"], ["bad", "1", "2"]]) for c, t in enumerate(line)]
    page = canonical.page_table_rows(spark.createDataFrame(cells, "source_path string, page int, table int, row int, col int, text string, x0 double, top double, x1 double, bottom double")).collect()
    assert [(r.fields["name"], r.locator) for r in page] == [("a", "page:1:table:1:row:1")]
    notes = spark.createDataFrame([("s", None, "/a", 3, None), (None, "", None, None, 4), (None, None, None, None, None), ("s", "l", "/a", 1, 1)], "source_path string, locator string, xpath string, line int, page int")
    assert [(r.source_path, r.locator) for r in canonical.located(notes).collect()] == [("s", "xpath:/a;line:3"), ("unknown", "page:4"), ("unknown", "unresolved-evidence"), ("s", "l")]
    paths = spark.createDataFrame([("file:/x/in/a/b.zip!/c/d.xml",), ("/x/in/q.pdf",), ("file:///x/other.xml",)], "p string").select(canonical.displayed(F.col("p"), "/x/in").alias("d"))
    assert [r.d for r in paths.collect()] == ["a/b.zip!/c/d.xml", "q.pdf", "other.xml"]


def tsv(lines):
    return "\n".join(["level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext", *["\t".join(map(str, x)) for x in lines]])


def test_recognised_tables(spark):
    heads, at = ["Name", "Unit", "Quantity", "Price", "Total"], [10, 90, 170, 250, 330]
    line = lambda n, words, conf=98: [(5, 1, 1, 1, n, i, x, 10 * n, 40, 8, conf, w) for i, (x, w) in enumerate(zip(at, words, strict=True))]
    body = line(1, heads) + line(2, ["Work", "m2", "2", "100", "200"]) + line(3, ["Bad", "m2", "two", "100", "200"]) + line(4, ["Low", "m2", "2", "100", "200"], 70) + line(5, heads) + line(6, ["Next", "m", "1", "1 000,5", "3"])
    body += [(5, 1, 1, 1, 9, i, 5, 95, 10, 5, 99, "fill") for i in range(10)] + [(5, 1, 1, 1, 9, 0, 395, 95, 10, 5, 99, "outside"), (5, 1, 1, 1, 9, 0, 5, 95, 10, 5, 10, "vague"), (5, 1, 1, 1, "x", 0, 5, 95, 10, 5, 99, "broken")]
    pages = spark.createDataFrame([("s.pdf", 1, tsv(body), 400, 100, 0), ("s.pdf", 2, "", 400, 100, 0), ("s.pdf", 3, None, 400, 100, 0)], "source_path string, page int, tsv string, image_width int, image_height int, rotation int")
    words = recognition.words(pages)
    assert {r.text: r.reason for r in words.where("NOT reliable").collect()} == {"outside": "invalid_bbox", "vague": "low_confidence"}
    told = recognition.summary(words).first()
    assert (told.lines, told.reliable, told.low) == (7, 40, 2) and told.text.startswith("Name Unit Quantity Price Total Work")
    found = recognition.candidates(words)
    got = {r.candidate_id: r for r in found.collect()}
    assert {k: r.fields["name"] for k, r in got.items()} == {"page:1:ocr-table:1:row:1": "Work", "page:1:ocr-table:2:row:1": "Next"}
    assert got["page:1:ocr-table:1:row:1"].bbox == [10, 20, 370, 28] and got["page:1:ocr-table:1:row:1"].table_bbox == [10, 10, 370, 28]
    assert [r.fault for r in recognition.validated(found).collect()] == [None, None]
    one = found.where("table = 1")
    spoil = {"identity": one.withColumn("row", F.lit(7)), "image": one.withColumn("rotation", F.lit(45)), "geometry": one.withColumn("table_bbox", F.array(*map(F.lit, [50, 10, 370, 28]))), "confidence": one.withColumn("confidence", F.lit(float("nan"))),
             "fields": one.withColumn("fields", F.map_filter("fields", lambda k, _: k != "unit")), "cells": one.withColumn("fields", F.transform_values("fields", lambda k, v: F.when(k == "name", "other").otherwise(v))),
             "numbers": one.withColumns({"fields": F.transform_values("fields", lambda k, v: F.when(k == "quantity", "two").otherwise(v)), "cells": F.transform("cells", lambda c: F.when(c["field"] == "quantity", c.withField("text", F.lit("two"))).otherwise(c))})}
    assert {k: df.transform(recognition.validated).first().fault for k, df in spoil.items()} == {k: k for k in spoil}


def test_contract():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": ["integer", "null"], "minimum": 1}, "b": {"type": "array", "minItems": 1, "items": {"$ref": "#/definitions/t"}}, "u": {"type": "string", "format": "uri"}}, "additionalProperties": False, "definitions": {"t": {"type": "string", "pattern": "^x", "maxLength": 2}}, "allOf": [{"if": {"properties": {"a": {"const": 5}}}, "then": {"required": ["b"]}}], "oneOf": [{"properties": {"a": {"enum": [1, 5]}}}, {"properties": {"a": {"const": None}}}]}
    for good in ({"a": 1}, {"a": None, "b": ["x"]}, {"a": 5, "b": ["xy"], "u": "urn:x"}):
        assert contract.fits_schema(good, schema), list(contract.faults(good, schema))
    for bad, fault in (({}, "$: required"), ({"a": True}, "$.a: type"), ({"a": 0}, "$.a: minimum"), ({"a": 5}, "$: required"), ({"a": 1, "b": []}, "$.b: minItems"), ({"a": 1, "b": ["yyy"]}, "$.b[0]: pattern"), ({"a": 1, "c": 1}, "$: additionalProperties"), ({"a": 2}, "$: oneOf"), ({"a": 1, "u": "http:"}, "$.u: format")):
        assert fault in list(contract.faults(bad, schema)), bad
    deep = {"a": 1}
    for _ in range(50_000):
        deep = {"x": deep}
    assert list(contract.faults(deep, {"type": "object"})) == []


def test_contexts(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"object": "o"}')
    assert context.merged(context.read(str(path)), {"object": None, "stage": "s"}) == {"object": "o", "stage": "s"}
    os.symlink(path, tmp_path / "l.json")
    path2 = tmp_path / "big.json"
    path2.write_text(" " * (1 << 20) + "{}")
    for bad in (tmp_path / "l.json", path2, tmp_path):
        with pytest.raises((context.Refused, OSError)):
            context.read(str(bad))
    deep: dict = {}
    for _ in range(40):
        deep = {"a": deep}
    for mode, purpose, value in (("other", None, {}), ("full", "a\n", {}), ("full", "x" * 257, {}), ("full", "p", {"full_row_coverage": {}}), ("full", "p", {"_trusted": 1}), ("full", "p", {"stage": 1}), ("full", "p", {"document_set": [""]}), ("full", "p", deep), ("full", "p", {"n": float("inf")})):
        with pytest.raises(context.Refused):
            context.public(mode, purpose, value)
    with pytest.raises(context.Refused):
        context.attestations({"r": {"completed_dimensions": ["arithmetic"], "evidence": []}})
    with pytest.raises(context.Refused):
        context.trusted({"other": 1})
    assert context.attestations(None) == {} and context.trusted(None) == {}
