import decimal
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import coords, decimals, text
from ledgerlens.operators import formulas, hierarchy, rollup, rows, tables
from ledgerlens.plans.audit import audit, missing_passport, routes
from ledgerlens.plans.views import configure

ROW = "row_id string, estimate_id string, code string, name string, quantity string, unit string, unit_price string, `index` string, coefficient string, declared_total string, basis_formula string, basis_verified boolean, basis_locator string, reliability string, category string, source_fields_verified_complete boolean, source_path string, locator string, sheet string, cell_range string, ord int"
FOUR = "quantity * unit_price * index * coefficient"


def row(i, **k):
    base = dict(row_id=f"r-{i}", estimate_id="lsr-1", code="A", name="Brick work", quantity="2", unit="m2", unit_price="100", index=None, coefficient=None, declared_total="200", basis_formula="quantity * unit_price", basis_verified=True, basis_locator="S!A1", reliability=None, category="work", source_fields_verified_complete=False, source_path="b.xlsx", locator="S!A1", sheet="S", cell_range="A1:H1", ord=i)
    return tuple((base | k).values())


def frame(spark, *made):
    return spark.createDataFrame(list(made), ROW)


def test_exact_arithmetic_keeps_scale(spark):
    configure(spark)
    df = frame(
        spark, row(1, index="1.10", coefficient="1", declared_total="219.99", basis_formula=FOUR), row(2, quantity="1", unit_price="80", declared_total="80"), row(3, unit_price=None),
        row(4, basis_verified=False), row(5, basis_formula=FOUR), row(6, reliability="partial"), row(7, quantity="1,5", unit_price="1 000", declared_total="1500"), row(8, quantity="n/a"), row(9, basis_locator=" "),
    )
    got = {r.row_id: r for r in rows.arithmetic(df).collect()}
    assert (got["r-1"].status, got["r-1"].expected, got["r-1"].difference) == ("finding", "220.00", "-0.01")
    assert [got[f"r-{i}"].status for i in (2, 3, 4, 5, 7, 8, 9)] == ["passed", "needs_input", "limited", "needs_input", "passed", "needs_input", "limited"]
    assert "r-6" not in got


def test_native_and_text_arithmetic_agree(spark):
    configure(spark)
    rnd = random.Random(1)
    made = []
    for i in range(300):
        q, p, x, c = (decimal.Decimal(rnd.randint(1, n)).scaleb(-2) for n in (9999, 999999, 999, 999))
        total = q * p * x * c + (decimal.Decimal("0.00000001") if i % 3 == 0 else 0)
        made.append(row(i, quantity=str(q), unit_price=str(p), index=str(x), coefficient=str(c), declared_total=str(total), basis_formula=FOUR))
    df = frame(spark, *made)
    typed = df.withColumns({f: F.col(f).cast(f"decimal({n},2)") for f, n in (("quantity", 6), ("unit_price", 8), ("index", 5), ("coefficient", 5))}).withColumn("declared_total", F.col("declared_total").cast("decimal(24,8)"))
    one = {r.row_id: r.status for r in rows.arithmetic(df).collect()}
    assert one == {r.row_id: r.status for r in rows.arithmetic(typed).collect()} == {f"r-{i}": "finding" if i % 3 == 0 else "passed" for i in range(300)}


@pytest.mark.parametrize(("raw", "want"), [("1 234,5", "1234.5"), ("1 234,5", None), ("1,234.5", None), ("1_000", "1000"), ("1e3", "1000"), ("NaN", None), ("", None), (None, None), ("-.5", "-0.5"), ("0.12345678901234567890123", None)])
def test_decimal_parsing(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "v string").select(decimals.parse(F.col("v")).alias("d")).first().d
    assert got == (None if want is None else decimal.Decimal(want))


def test_duplicates_number_all_groups(spark):
    df = frame(spark, row(1, name="Single", code="Z"), row(2), row(3, name="  BRICK   work "), row(4, name="Brick-work!", code="B", declared_total="300"), row(5, name=None))
    assert [(r.ordinal, r.copies) for r in rows.exact_duplicates(df).collect()] == [(2, 2)]
    assert [(r.ordinal, r.copies) for r in rows.semantic_duplicates(df).collect()] == [(2, 3)]


def test_fields_components_quotes(spark):
    df = frame(spark, row(1, name=""), row(2, unit=None, source_fields_verified_complete=True), row(3))
    assert sorted((r.row_id, r.status, r.missing) for r in rows.fields(df).collect()) == [("r-1", "needs_input", "name"), ("r-2", "finding", "unit")]
    index = spark.createDataFrame([("i1", "not-a-number", False), ("i2", "1.15", False), ("i3", "", False)], "index_id string, value string, source_fields_verified_complete boolean")
    assert sorted((r.record_id, r.status) for r in rows.components({"indices": index}).collect()) == [("i1", "finding"), ("i2", "passed"), ("i3", "needs_input")]
    quote = spark.createDataFrame([("k1", "10", "n", "c", "pcs", "67", "RUB", True, "s", "2026", False, False, "p", "l", 1), ("k2", "0", "n", " ", "pcs", "67", "RUB", False, "s", "2026", None, False, "p", "l", 0)], "kac_id string, price string, name string, characteristics string, unit string, region string, currency string, comparability boolean, source string, date string, vat_included boolean, delivery_included boolean, source_path string, locator string, page int").withColumn("reliability", F.lit(None).cast("string"))
    got = {r.kac_id: (r.status, r.missing) for r in rows.quotes(quote).collect()}
    assert got == {"k1": ("passed", ""), "k2": ("needs_input", "price, name_characteristics, comparability, vat_included, evidence")}


ESTIMATE = "estimate_id string, estimate_type string, parent_id string, declared_total decimal(12,2), reliability string, source_path string, locator string, page int"


def estimates(spark, *made):
    return spark.createDataFrame([(i, t, p, None if v is None else decimal.Decimal(v), r, "s", "l", 1) for i, t, p, v, r in made], ESTIMATE)


def test_hierarchy(spark):
    df = estimates(spark, ("ssr", "SSR", None, 205, None), ("osr", "OSR", "ssr", 200, None), ("lsr-1", "LSR", "osr", 100, None), ("lsr-2", "LSR", "osr", 110, None))
    assert {r.status for r in hierarchy.relations(df).collect()} == {"passed"}
    assert sorted((r.parent_id, r.observed, r.expected, r.status) for r in hierarchy.totals(df).collect()) == [("osr", 200, 210, "finding"), ("ssr", 205, 200, "finding")]
    odd = estimates(spark, ("a", "OSR", None, 1, None), ("a", "OSR", None, 1, None), ("b", "LSR", "a", 1, None), ("c", "LSR", "none", 1, None), ("d", "SSR", "b", None, None), ("e", "LSR", "d", 1, "partial"), ("f", "LSR", "d", 1, None))
    assert {r.child_id: r.reason for r in hierarchy.relations(odd).collect()} == {"b": "parent_id_not_unique", "c": "parent_not_found", "d": "invalid_hierarchy_direction", "e": "hierarchy_records_not_reliable", "f": "direct_lsr_to_ssr_route_not_attested"}


def test_cycles_name_the_entry(spark):
    links = [("a", "m"), ("m", "n"), ("n", "k"), ("k", "m"), ("x", "y"), ("y", "x"), ("q", "gone"), ("s", "s")]
    got = sorted((r.entry, r.length, r.least) for r in hierarchy.cycles(spark.createDataFrame(links, "child string, parent string")).collect())
    assert got == [("m", 3, "k"), ("s", 1, "s"), ("x", 2, "x")]
    assert hierarchy.cycles(spark.createDataFrame([("a", "b")], "child string, parent string")).count() == 0


def test_status_order_and_demotion(spark):
    states = spark.createDataFrame([("passed",), ("limited",), ("needs_input",), ("finding",)], "status string")
    assert rollup.state(states).first().status == "finding" and rollup.state(states, order=rollup.INPUT_FIRST).first().status == "needs_input"
    assert rollup.state(states.limit(0)).first().status == "not_applicable"
    checks = spark.createDataFrame([("A", "passed"), ("B", "needs_input"), ("C", "limited")], "id string, status string")
    assert {r.id: r.status for r in rollup.demote(checks).collect()} == {"A": "needs_input", "B": "needs_input", "C": "limited"}
    assert {r.status for r in rollup.demote(checks.where("id <> 'B'")).collect()} == {"passed", "limited"}
    matrix = {r.id: r.status for r in rollup.matrix(spark.createDataFrame([("HIER-01", "not_applicable"), ("ARITH-01", "passed")], "id string, status string"), "снос").collect()}
    assert len(matrix) == 28 and matrix["PKG-03"] == "limited" and matrix["QTY-02"] == "passed" and matrix["RATE-01"] == "limited" and matrix["CAP-01"] == "limited"


def test_formula_language(spark):
    cells = [("s", "A1", "1", None), ("s", "A2", "2", None), ("s", "B1", None, "=SUM(A1:A2)"), ("s", "B2", None, "=ROUND(B1/2,0)"), ("s", "C1", None, "=MIN(A1:A2,B1)"), ("s", "C2", None, "=MAX(A1,A2,B2)"), ("s", "D1", None, "=B2+C1+C2"), ("s", "D2", None, "=Calc!A1"), ("s", "E1", None, "=E2"), ("s", "E2", None, "=E1"), ("s", "F1", None, "=SUM(A1:A3)"), ("s", "F2", None, "=-A1*(2+3)^2"), ("s", "G1", None, "=1/0"), ("s", "G2", None, "=.5+1e2")]
    got = {r.ref: (r.value, r.error) for r in formulas.evaluate(spark.createDataFrame(cells, "sheet string, ref string, value string, formula string")).collect()}
    assert got == {"B1": ("3", None), "B2": ("2", None), "C1": ("1", None), "C2": ("2", None), "D1": ("5", None), "D2": (None, "unsupported_formula"), "E1": (None, "formula_cycle"), "E2": (None, "formula_cycle"), "F1": (None, "unsupported_formula"), "F2": (None, "unsupported_formula"), "G1": (None, "unsupported_formula"), "G2": ("100.5", None)}


def test_text_and_coordinates(spark):
    df = spark.createDataFrame([(" Наименование  работ ", "Ёлка-1 ß")], "a string, b string")
    r = df.select(text.collapsed(F.col("a")).alias("a"), text.semantic_name(F.col("b")).alias("b"), coords.column_letters(F.lit(16384)).alias("c"), coords.column_number(F.lit("AA")).alias("d"), coords.cell_range(F.array(F.lit("$B$2"), F.lit("A10"), F.lit("C2"))).alias("e"), coords.plain_xpath(F.lit("/a[2]/b[13]/@c")).alias("f")).first()
    assert tuple(r) == ("наименование работ", "елка 1 ss", "XFD", 27, "B2:A10", "/a/b/@c")


def test_anchored_lines_drift(spark):
    words = spark.createDataFrame([(1, 0.0, 0.0, "a"), (1, 2.0, 1.0, "b"), (1, 4.0, 2.0, "c"), (1, 6.0, 3.0, "d"), (1, 30.0, 0.0, "e")], "page int, top double, x0 double, text string")
    assert [(r.line_no, r.text) for r in tables.text_lines(words).orderBy("line_no").collect()] == [(1, "a b"), (2, "c d"), (3, "e")]


def test_budgets(spark):
    pages = spark.createDataFrame([("d", i, s) for i, s in enumerate([50, 70, 40, 20, 5])], "doc string, page int, size int")
    r = tables.page_budget(pages, "doc", "page", "size", 100).first()
    assert (r.accepted, r.used, r.n) == (3, 95, 5)
    got = [(x.page, x.used, x.accepted) for x in tables.running_budget(pages, "doc", ["page"], "size", 160).orderBy("page").collect()]
    assert got == [(0, 50, True), (1, 120, True), (2, 160, True), (3, 180, False), (4, 185, False)]


def test_audit_end_to_end(spark):
    context = {k: "x" for k in ("object", "work_type", "funding_source", "region_or_price_zone", "price_level_date", "calculation_method", "stage")} | {"document_set": ["LSR"]}
    model = {"rows": frame(spark, row(1, declared_total="199"), row(2), row(3, code="C", name="Other")), "estimates": estimates(spark, ("ssr", "SSR", None, 10, None), ("osr", "OSR", "ssr", 10, None))}
    out = json.loads(audit(spark, model, context).to_json())
    checks = {c["id"]: c["status"] for c in out["checks"]}
    assert checks["ARITH-01"] == "finding" and checks["HIER-01"] == "passed" and checks["FORMULA-01"] == "not_applicable" and checks["QTY-02"] == "finding" and out["status"] == "finding"
    assert [f["id"] for f in out["findings"]] == ["ARITH-01:r-1", "DUP-02:1"] and out["findings_omitted"] == 0
    light = {c["id"]: c["status"] for c in audit(spark, model, context, "light").result()["checks"]}
    assert light["ARITH-01"] == "limited" and light["HIER-01"] == "passed"
    blocked = audit(spark, model, context | {"stage": " "}).result()
    assert blocked["status"] == "needs_input" and blocked["questions"] == ["stage"] == missing_passport(context | {"stage": None}) and {c["status"] for c in blocked["checks"]} == {"needs_input"}


def test_routes():
    at = lambda c, ids=(): {n: (s, r) for n, s, r in routes(c, set(ids))}["ROUTE-PIR"]
    assert at({"work_type": "x"}) == ("not_applicable", "") and at({"work_type": " ПИР "}) == ("needs_input", "route_inputs_not_available")
    own = {"work_type": "pir", "special_routes": {"pir": {"source_id": "s"}}}
    assert at(own) == ("limited", "currentness_not_verified") and at(own, ["s"]) == ("needs_input", "route_inputs_incomplete")
    own["special_routes"]["pir"]["inputs_complete"] = True
    assert at(own, ["s"]) == ("limited", "manual_route_review_required")


def test_tax_and_contract(spark):
    d = decimal.Decimal
    vat = spark.createDataFrame([("v1", d(1000), d("0.2"), d("180"), [d(100)], True), ("v2", d(1000), d("0.2"), d("199"), [], True), ("v3", d(1), d(1), d(1), [], False), ("v4", d(1), d(1), None, [], True)], "vat_id string, base_before_exemptions decimal(12,2), rate decimal(3,2), declared_amount decimal(12,2), exempt_amounts array<decimal(18,2)>, source_fields_verified_complete boolean")
    assert {r.vat_id: (r.status, r.difference) for r in rows.vat(vat).collect()} == {"v1": ("passed", 0), "v2": ("finding", -1), "v3": ("needs_input", None), "v4": ("needs_input", None)}
    deal = spark.createDataFrame([("c1", d(900), d(50), d(960), d(1000)), ("c2", d(900), d(200), d(1100), d(1000))], "contract_id string, original decimal(12,2), changes decimal(12,2), revised decimal(12,2), project decimal(12,2)")
    assert sorted((r.contract_id, r.finding, r.observed, r.expected) for r in rows.contracts(deal).collect()) == [("c1", "revised_total", 960, 950), ("c2", "project_exceeded", 1100, 1000)]
