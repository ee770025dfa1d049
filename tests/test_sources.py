import io
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import inventory, packages, workbooks, xml
from ledgerlens.streaming.intake import inventory_stream


def packed(*files, compress=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", compress) as z:
        for name, data in files:
            z.writestr(name, data)
    return out.getvalue()


def test_nested_archives(spark):
    inner = packed(("folder/file.xml", "<a/>"))
    deep = packed(("d.zip", packed(("e.zip", packed(("f.zip", inner))))))
    made = [("outer.zip", packed(("inner.zip", inner), ("x.txt", "hello"))), ("deep.zip", deep), ("bad.zip", b"no"), ("unsafe.zip", packed(("../x", "1"))), ("twice.zip", packed(("A/É", "1"), ("a/é", "2"))), ("bomb.zip", packed(("z", b"0" * 10_000_000)))]
    rows = packages.expand(spark.createDataFrame([(p, bytearray(c)) for p, c in made], "path string, content binary")).collect()
    got = {r.path: (r.status, r.code) for r in rows}
    assert got["outer.zip!/inner.zip!/folder/file.xml"] == ("reliable", None) and got["outer.zip!/x.txt"] == ("reliable", None)
    assert got["deep.zip!/d.zip!/e.zip!/f.zip"] == ("not_inspected", "zip_nesting_limit")
    assert (got["bad.zip"][1], got["unsafe.zip"][1], got["twice.zip"][1], got["bomb.zip"][1]) == ("zip_invalid", "zip_unsafe_path", "zip_path_collision", "zip_limit_exceeded")


def test_archive_budget(spark):
    data = packed(*((f"f{i}", "x" * 100) for i in range(5)))
    rows = packages.expand(spark.createDataFrame([("a.zip", bytearray(data))], "path string, content binary"), budget=250).orderBy("path").collect()
    assert [r.code for r in rows] == [None, None, *["zip_global_limit_exceeded"] * 3] and rows[3].content is None


def test_xml_values_and_rules(spark):
    doc = '<?xml version="1.0"?><r xmlns="u" a="1"><i n="x"><q>2</q></i><i><q> 3.5 </q><q/></i></r>'
    files = spark.createDataFrame([("d.xml", bytearray(doc.encode())), ("e.xml", bytearray(b'<!DOCTYPE r [<!ENTITY e "z">]><r>&e;</r>')), ("f.xml", bytearray(b"<r>")), ("g.xml", None)], "path string, content binary")
    rows = xml.values(files).collect()
    got = {(r.kind, r.xpath): r.raw_value for r in rows if r.source_path == "d.xml" and r.kind != "element"}
    assert got == {("attribute", "/r/@a"): "1", ("attribute", "/r/i[1]/@n"): "x", ("text", "/r/i[1]/q"): "2", ("text", "/r/i[2]/q[1]"): "3.5"}
    assert {r.source_path: r.code for r in rows if r.kind == "error"} == {"e.xml": "xml_dtd_forbidden", "f.xml": "xml_parse_error", "g.xml": "xml_parse_error"}
    found = xml.values(files).withColumn("schema_id", F.lit("s"))
    rules = spark.createDataFrame([("item", "s", "/r/i")], "rule string, schema_id string, pattern string")
    mapping = spark.createDataFrame([("item", "q", "quantity", 1, "first"), ("item", "n", "code", 1, "unique")], "rule string, local_name string, field string, ordinal int, mode string")
    out = xml.mapped(xml.direct_fields(xml.anchors(found, rules), found), mapping)
    assert sorted((r.anchor, r.field, r.value) for r in out.collect()) == [("/r/i[1]", "code", "x"), ("/r/i[1]", "quantity", "2"), ("/r/i[2]", "quantity", "3.5")]
    kinds = spark.createDataFrame([("schema.object_or_summary_estimate",), ("local_estimate",), ("other",)], "s string").select(xml.document_type(F.col("s")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["SSR", "LSR", None]


def book():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    return packed(
        ("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Смета" sheetId="1" r:id="rId1"/><sheet name="Off" sheetId="2" state="hidden" r:id="rId2"/></sheets></workbook>'),
        ("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>'),
        ("xl/sharedStrings.xml", f"<sst {ns}><si><t>кирпич</t></si><si><r><t>два </t></r><r><t>слова</t></r></si></sst>"),
        ("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="4"/></cellXfs></styleSheet>'),
        ("xl/worksheets/sheet1.xml", f'<worksheet {ns}><cols><col min="3" max="3" hidden="1"/></cols><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1"><v>2.50</v></c><c r="D1" s="1"><v>45000</v></c><c r="E1" s="2"><v>45000.5</v></c></row>'
         '<row r="2" hidden="1"><c r="A2"><f t="shared" ref="A2:A3" si="0">B2*$C$1</f><v>4</v></c><c r="B2" t="inlineStr"><is><t>in</t></is></c></row><row r="3"><c r="A3"><f t="shared" si="0"/><v>5</v></c><c r="B3" t="b"><v>1</v></c><c r="C3"/></row></sheetData></worksheet>'),
        ("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1"><v>1e2</v></c></row></sheetData></worksheet>'),
    )


def test_workbook_cells(spark):
    rows = workbooks.read(spark.createDataFrame([("b.xlsx", bytearray(book())), ("bad.xlsx", bytearray(b"x")), ("none.xlsx", bytearray(packed(("a", "b"))))], "path string, content binary")).collect()
    got = {(r.sheet, r.ref): r for r in rows if r.path == "b.xlsx"}
    at = lambda ref: (got[("Смета", ref)].kind, got[("Смета", ref)].value)
    assert [at(r) for r in ("A1", "B1", "C1", "D1", "E1", "B2", "B3", "C3")] == [("text", "кирпич"), ("text", "два слова"), ("number", "2.5"), ("date", "2023-03-15"), ("datetime", "2023-03-15T12:00:00"), ("text", "in"), ("boolean", "1"), ("empty", None)]
    assert got[("Смета", "A2")].formula == "=B2*$C$1" and got[("Смета", "A3")].formula == "=B3*$C$1"
    assert got[("Смета", "C1")].hidden and got[("Смета", "A2")].hidden and not got[("Смета", "A1")].hidden and got[("Off", "A1")].hidden and got[("Off", "A1")].value == "100"
    assert {r.path: r.code for r in rows if r.kind == "refused"} == {"bad.xlsx": "unreadable_openxml_archive", "none.xlsx": "unreadable_openxml_workbook"}


def test_inventory_and_intake(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.XLSX").write_bytes(b"abc")
    (root / "sub" / "b.docx").write_bytes(b"")
    got = {r.path.rpartition("/")[2]: (r.reader, r.size_bytes, r.sha256[:8]) for r in inventory.scan(spark, str(root)).collect()}
    assert got == {"a.XLSX": ("ooxml", 3, "ba7816bf"), "b.docx": (inventory.UNSUPPORTED, 0, "e3b0c442")}
    with pytest.raises(ValueError, match="input_directory_limit_exceeded"):
        inventory.scan(spark, str(root), max_files=1)
    for expected in (1, 2):
        inventory_stream(spark, str(root), f"{tmp_path}/table", f"{tmp_path}/seen").awaitTermination(120)
        assert spark.read.parquet(f"{tmp_path}/table").count() == expected
        (root / f"c{expected}.xml").write_bytes(b"<a/>")


def test_xml_layout_is_parsed_once(monkeypatch):
    from ledgerlens.sources import xml

    real, calls = xml.parse, []
    monkeypatch.setattr(xml, "parse", lambda *a: calls.append(a) or real(*a))
    reader = xml.Reader()
    rows = lambda doc: [tuple(r) for r in zip(*(lambda c: (*c[0], c[1]))(reader.columns(doc)), strict=True)]
    made = lambda i: f'<?xml version="1.0"?>\n<o id="{i}">\n<i n="">{i}</i><i n="x{i}"> {i} </i><n:e xmlns:n="u{i}"/></o>'.encode()
    for i in range(50):
        assert rows(made(i)) == real(made(i))
    assert len(calls) == 1
    odd = ["<a> </a>", "<a>x</a>", "<a>x &lt; y</a>", "<a>x<!-- k=\"v\" -->y</a>", "<a k='b=\"c\"'>1</a>", "<a k='b=\"it's\"'>1</a>", '<a k="v=" l="w">2</a>', '<a>p="q"</a>', '<a>p="q" &amp;</a>', "<a><![CDATA[x]]>y</a>", "<a>x<b/>y</a>", '<a k="1" k="2"/>', "<a>", "", '<a k="\t"/>']
    for doc in [*odd, *odd]:
        for content in (doc.encode(), doc.encode("utf-16")):
            try:
                want = real(content)
            except xml.Refused as error:
                want = str(error)
            try:
                got = rows(content)
            except xml.Refused as error:
                got = str(error)
            assert got == want, doc
