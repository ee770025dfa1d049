import hashlib
import io
import json
import zipfile
from xml.etree import ElementTree as ET

import pytest
from pyspark.sql import functions as F
from test_sources import book

from ledgerlens.sources import sinks, workbooks, xml, xml_rules


def request(content, *items):
    return sinks.parse_request(json.dumps({"schema_version": "v1", "source_sha256": hashlib.sha256(content).hexdigest(), "corrections": [dict(id=f"c{i}", status="confirmed", reason="r") | x for i, x in enumerate(items)]}))


def test_corrected_copy():
    content = book()
    spec = request(content, {"target": {"sheet": "Смета", "cell": "C1"}, "expected_old": 2.5, "replacement": 3}, {"target": {"sheet": "Смета", "cell": "a1"}, "expected_old": "кирпич", "replacement": "брус"}, {"target": {"sheet": "Off", "cell": "A1"}, "expected_old": 100, "replacement": 1, "status": "disputed"})
    data, log = sinks.corrected_workbook(content, spec)
    got = {(c["sheet"], c["ref"]): c["value"] for c in workbooks.cells(data)}
    assert (got["Смета", "C1"], got["Смета", "A1"], got["Off", "A1"], got["Смета", "B1"]) == ("3", "брус", "100", "два слова")
    assert [c["action"] for c in log["changes"]] == ["replaced", "replaced", "commented"]
    z = zipfile.ZipFile(io.BytesIO(data))
    comment = ET.fromstring(z.read("xl/comments_notes1.xml"))
    assert [(c.get("ref"), "".join(c.itertext())) for c in comment.iter(f"{workbooks.MAIN}comment")] == [("A1", "c2: r -> 1")]
    assert "<x:Row>0</x:Row>" in z.read("xl/drawings/vmlDrawing_notes1.vml").decode() and b"comments+xml" in z.read("[Content_Types].xml") and b"legacyDrawing" in z.read("xl/worksheets/sheet2.xml")
    again, _ = sinks.corrected_workbook(data, request(data, {"target": {"sheet": "Off", "cell": "A1"}, "expected_old": 100.0, "replacement": 2, "status": "disputed"}))
    kept = ET.fromstring(zipfile.ZipFile(io.BytesIO(again)).read("xl/comments_notes1.xml"))
    assert len(list(kept.iter(f"{workbooks.MAIN}comment"))) == 2
    for bad in ({"target": {"sheet": "Смета", "cell": "C1"}, "expected_old": 9, "replacement": 1}, {"target": {"sheet": "None", "cell": "C1"}, "expected_old": 9, "replacement": 1}, {"target": {"sheet": "Смета", "cell": "A2"}, "expected_old": 4, "replacement": 1}):
        with pytest.raises(sinks.Rejected):
            sinks.corrected_workbook(content, request(content, bad))


def test_requests_and_files(tmp_path):
    good = {"target": {"locator": "page:1"}, "expected_old": None, "replacement": "x"}
    assert json.loads(sinks.sidecar(b"pdf", request(b"pdf", good)))["proposals"][0]["applied"] is False
    for bad in (good | {"replacement": " =1"}, good | {"extra": 1}, good | {"target": {"sheet": "a", "cell": "1A"}}, good | {"id": "é"}):
        with pytest.raises(sinks.Rejected):
            request(b"pdf", bad)
    with pytest.raises(sinks.Rejected):
        request(b"pdf", good, good)
    with pytest.raises(sinks.Rejected):
        sinks.sidecar(b"other", request(b"pdf", good))
    with pytest.raises(sinks.Rejected):
        sinks.parse_request('{"a": 1, "a": 2}')
    path = str(tmp_path / "r.json")
    sinks.write_result({"b": 1, "a": "я"}, path)
    assert json.loads(open(path).read()) == {"a": "я", "b": 1}
    with pytest.raises(FileExistsError):
        sinks.create_pair((str(tmp_path / "new"), b"1"), (path, b"2"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["r.json"]


def test_local_estimate_rules(spark):
    doc = "<Construction><Name>Дом</Name><Object><Estimate><Num>01</Num><Sections><Section><Items><Item><Cost><Name>Кладка</Name><Code>A</Code><Quantity>2</Quantity><Totals><Current><Direct>20</Direct></Current></Totals></Cost></Item><Item><Cost><Name>Б</Name><QuantityTotal>3</QuantityTotal><Quantity>9</Quantity></Cost></Item></Items></Section></Sections></Estimate></Object></Construction>"
    found = xml.values(spark.createDataFrame([("d.xml", bytearray(doc.encode()))], "path string, content binary")).withColumn("schema_id", F.lit("minstroy.local_estimate_rim.3_01"))
    rules, paths = xml_rules.tables(spark)
    got = xml.mapped_paths(xml.anchors(found, rules), found, paths).collect()
    rows = {(r.anchor[-12:], r.field): r.value for r in got if ":estimate_row:" in r.rule}
    assert rows == {("Item[1]/Cost", "name"): "Кладка", ("Item[1]/Cost", "code"): "A", ("Item[1]/Cost", "quantity"): "2", ("Item[1]/Cost", "declared_total"): "20", ("Item[2]/Cost", "name"): "Б", ("Item[2]/Cost", "quantity"): "3"}
    assert {(r.field, r.value) for r in got if ":estimate:" in r.rule} == {("code", "01")}


def test_unique_and_first_fields(spark):
    doc = '<Document><Indexes><Index Caption="a" Pz="1.1"/><Index Caption="b" Pz="1.1" Oz="2"/></Indexes><Chapters><Chapter><Position Caption="p" Obosn="o" EdPr="5"><Total Total="10"/></Position></Chapter></Chapters></Document>'
    schema = "grandsmeta.object_or_summary_estimate.2026_1_1"
    found = xml.values(spark.createDataFrame([("d.xml", bytearray(doc.encode()))], "path string, content binary")).withColumn("schema_id", F.lit(schema))
    rules, paths = xml_rules.tables(spark)
    got = {(r.anchor.rpartition("/")[2], r.field): r.value for r in xml.mapped_paths(xml.anchors(found, rules), found, paths).collect()}
    assert got["Index[1]", "value"] == "1.1" and ("Index[2]", "value") not in got and got["Index[2]", "name"] == "b"
    assert got["Position", "declared_total"] == "10" and got["Position", "code"] == "o" and got["Total", "declared_total"] == "10"
    assert len(xml_rules.RULES) == 13
