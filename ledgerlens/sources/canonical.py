"""Canonical collections from sources: records routed by entity, tables of sheets and pages, evidence and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions import coords, decimals, text
from ledgerlens.functions.evidence import FIELDS
from ledgerlens.operators import formulas

# The collection of each entity, the fields that audits read from it, and other names of row fields.
COLLECTIONS = {
    "document": "documents", "estimate": "estimates", "estimate_row": "rows", "row": "rows", "resource": "resources", "accrual": "accruals", "index": "indices",
    "coefficient": "coefficients", "kac": "kacs", "market_price": "kacs", "total": "totals", "formula": "formulas",
}
COLUMNS = {
    "documents": ["document_id", "document_type", "schema_id", "name", "code"],
    "estimates": ["estimate_id", "estimate_type", "parent_id", "declared_total", "currency_unit"],
    "rows": ["row_id", "estimate_id", "code", "name", "quantity", "unit", "unit_price", "declared_total", "index", "coefficient", "category", "currency_unit", "basis_formula", "basis_verified", "basis_locator", "source_fields_verified_complete"],
    "resources": ["resource_id", "name", "quantity", "unit", "unit_price", "declared_total", "source_fields_verified_complete"],
    "accruals": ["accrual_id", "name", "basis", "rate", "declared_total", "source_fields_verified_complete"],
    "indices": ["index_id", "row_id", "value", "source_fields_verified_complete"],
    "coefficients": ["coefficient_id", "row_id", "value", "source_fields_verified_complete"],
    "kacs": ["kac_id", "price", "unit_price", "name", "characteristics", "name_characteristics", "description", "unit", "region", "region_or_price_zone", "supply_terms", "delivery_terms", "terms_of_supply", "currency", "currency_code", "comparability", "comparability_basis", "comparison_basis", "source", "date", "vat_included", "delivery_included"],
    "totals": ["total_id", "total_type", "declared_total", "source_fields_verified_complete"],
    "formulas": ["formula_id", "formula", "computed_value", "cached_value", "unit"],
}
ROW_ALIASES = {"declared_total": "amount", "unit_price": "price"}
ANCHORS = ["quantity", "unit_price", "amount"]
FLAGS = ("basis_verified", "source_fields_verified_complete")
RECORD = "entity string, fields map<string,string>, reliability string, " + ", ".join(f"{n} {t}" for n, t in FIELDS.items())


def evidence(found: dict[str, Column], source_path: Column, locator: Column) -> dict[str, Column]:
    """Evidence columns: what was found, a `cell` as its range, and the source and locator given where none was."""
    out = {n: found.get(n, F.lit(None)).cast(t) for n, t in FIELDS.items()}
    out["cell_range"] = F.coalesce(out["cell_range"], found.get("cell", F.lit(None)).cast("string"))
    return out | {"source_path": F.coalesce(out["source_path"], source_path), "locator": F.coalesce(out["locator"], locator)}


def routed(records: DataFrame) -> dict[str, DataFrame]:
    """One DataFrame per collection of records (RECORD), its COLUMNS wide, with evidence, reliability and `ord`.

    Unknown entities go nowhere. Rows take amounts and prices under their other names where they lack their own;
    an index or coefficient of a row is a record of its own as well.
    """
    collection = text.lookup(COLLECTIONS, text.folded(text.trimmed(F.coalesce("entity", F.lit("")))))
    known = records.withColumn("collection", collection).where("collection IS NOT NULL").withColumn("reliability", F.coalesce("reliability", F.lit("reliable")))
    out = {}
    for name, columns in COLUMNS.items():
        own = known.where(F.col("collection") == name)
        value = lambda c, n=name: F.coalesce(F.try_element_at("fields", F.lit(c)), F.try_element_at("fields", F.lit(ROW_ALIASES[c]))) if n == "rows" and c in ROW_ALIASES else F.try_element_at("fields", F.lit(c))
        typed = lambda c, n=name: value(c).try_cast("boolean") if c in FLAGS else decimals.parse(value(c)) if (n, c) == ("estimates", "declared_total") else value(c).try_cast("double") if n == "formulas" and c.endswith("_value") else value(c)
        wide = own.select(*[typed(c).alias(c) for c in columns], "reliability", *FIELDS)
        out[name] = wide.withColumn("ord", F.struct("source_path", "locator", columns[0]))
    for field, name in (("index", "indices"), ("coefficient", "coefficients")):
        key = COLUMNS[name][0]
        rows = out["rows"].where(F.col(field).isNotNull())
        made = rows.select(F.concat("row_id", F.lit(f":{field}")).alias(key), "row_id", F.col(field).alias("value"), "source_fields_verified_complete", "reliability", *FIELDS)
        out[name] = out[name].unionByName(made.withColumn("ord", F.struct("source_path", "locator", key)))
    return out


def table_records(tables: DataFrame) -> DataFrame:
    """Records of tables (source_path, sheet, page, range, estimate_id, headers, rows): headers are given or the first row.

    Headers are looked up; a row needs an amount, a price or a quantity. `rows` is an array of arrays of text.
    """
    given = F.col("headers").isNotNull()
    rows = tables.select("*", F.when(given, F.col("headers")).otherwise(F.get("rows", F.lit(0))).alias("_heads"), F.posexplode("rows").alias("_at", "_cells"))
    rows = rows.where(given | (F.col("_at") > 0)).withColumn("_n", F.col("_at") + F.when(given, 1).otherwise(0))
    pairs = F.filter(F.transform("_heads", lambda h, i: F.struct(text.lookup(text.RECORD_HEADERS, text.collapsed(h)).alias("key"), F.get("_cells", i).alias("value"), i.alias("at"))), lambda p: p["key"].isNotNull() & (p["at"] < F.size("_cells")))
    last = F.filter(pairs, lambda p: ~F.exists(pairs, lambda q: (q["key"] == p["key"]) & (q["at"] > p["at"])))
    fields = F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"])))
    where = F.coalesce("sheet", F.col("page").cast("string"), F.lit("table"))
    own = F.create_map(F.lit("row_id"), F.concat_ws(":", "source_path", where, "_n"), F.lit("estimate_id"), F.coalesce("estimate_id", "sheet", F.concat("source_path", F.lit(":estimate"))))
    place = F.concat(F.coalesce("sheet", F.concat(F.lit("page:"), F.col("page").cast("string")), F.lit("table")), F.lit("!"), F.coalesce("range", F.concat(F.lit("row:"), "_n")))
    rows = rows.withColumn("fields", fields).where(F.exists(F.map_keys("fields"), lambda k: k.isin("quantity", "unit_price", "declared_total")))
    named = evidence({"sheet": F.col("sheet"), "page": F.col("page")}, F.col("source_path"), place)
    return rows.select(F.lit("estimate_row").alias("entity"), F.map_concat("fields", own).alias("fields"), F.lit("reliable").alias("reliability"), *[c.alias(n) for n, c in named.items()])


def _first_columns(named: Column) -> Column:
    """(field, col) of an array of (field, col): the first column of each field."""
    first = lambda f: F.array_min(F.transform(F.filter(named, lambda x: x["field"] == f), lambda x: x["col"]))
    return F.transform(F.array_distinct(F.transform(named, lambda x: x["field"])), lambda f: F.struct(f.alias("field"), first(f).alias("col")))


def sheet_lines(cells: DataFrame) -> DataFrame:
    """(path, sheet, row, cells, map) of occupied rows, a sheet's in one partition; map has the first column of each field where the row is a header.

    A header has three different header texts or more, an anchor among them. Header texts have letters, so rows
    with fewer than three such texts aren't looked up.
    """
    said = F.col("value").isNotNull() & F.col("formula").isNull()
    # dealt by sheet once: rows, windows and joins by sheet need no other shuffle
    dealt = cells.where("path IS NOT NULL AND sheet IS NOT NULL AND row IS NOT NULL AND (value IS NOT NULL OR formula IS NOT NULL)").repartition("path", "sheet")
    rows = dealt.groupBy("path", "sheet", "row").agg(F.collect_list(F.struct("col", "ref", "value", "formula")).alias("cells"), F.count_if(said & F.col("value").rlike(r"[\p{L}№]")).alias("lettered"))
    field = lambda c: text.lookup(text.SHEET_HEADERS, text.sheet_header(c["value"]))
    named = F.transform(F.filter("cells", lambda c: c["value"].isNotNull() & c["formula"].isNull()), lambda c: F.struct(field(c).alias("field"), c["col"].alias("col")))
    rows = rows.withColumn("map", F.when(F.col("lettered") >= 3, F.filter(named, lambda x: x["field"].isNotNull())))
    fit = (F.size("map") >= 3) & F.exists("map", lambda m: m["field"].isin(ANCHORS))
    return rows.withColumn("map", _first_columns(F.col("map"))).select("path", "sheet", "row", "cells", F.when(fit, F.col("map")).alias("map"))


def sheet_rows(cells: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(path, sheet, header, row, fields, refs, basis) of the rows of tables in sheets; cells as the workbook reader gives them.

    The body under a header is the run of occupied rows up to a gap, the next header, or a row that is blank
    where the headers are. declared (path, sheet, first, last) are tables that the workbook names: from their
    header in row `first` they go on to row `last`, blank rows left out. A sheet is bounded by the reader.
    """
    occupied = sheet_lines(cells)
    w = W.partitionBy("path", "sheet").orderBy("row")
    lines = occupied.withColumn("rank", F.row_number().over(w))
    under = F.last(F.when(F.col("map").isNotNull(), F.struct(F.col("row").alias("header"), "rank", "map")), ignorenulls=True).over(w)
    body = lines.withColumn("under", under).where("map IS NULL AND row - under.header = rank - under.rank").select("path", "sheet", "row", "cells", F.col("under.header").alias("header"), F.col("under.map").alias("map"), F.lit(False).alias("named"))
    if declared is not None:
        heads = occupied.where("map IS NOT NULL").select("path", "sheet", F.col("row").alias("header"), "map")
        tables = declared.select("path", "sheet", F.col("first").alias("header"), "last").join(heads, ["path", "sheet", "header"])
        body = body.join(tables.select("path", "sheet", "header"), ["path", "sheet", "header"], "left_anti")
        inside = occupied.drop("map").join(tables, ["path", "sheet"]).where("row > header AND row <= last")
        body = body.unionByName(inside.select("path", "sheet", "row", "cells", "header", "map", F.lit(True).alias("named")))
    letters = lambda m: coords.column_letters(m["col"].cast("long"))
    at = lambda m: F.filter("cells", lambda c: c["col"] == m["col"])
    one = lambda m, c: F.struct(m["field"].alias("field"), m["col"].alias("col"), F.coalesce(c["ref"], F.concat(letters(m), F.col("row").cast("string"))).alias("ref"), c["value"].alias("value"), c["formula"].alias("formula"))
    none = F.array(F.lit(None).cast(dict(occupied.dtypes)["cells"].removeprefix("array<")[:-1]))
    found = body.withColumn("found", F.flatten(F.transform("map", lambda m: F.transform(F.when(F.size(at(m)) > 0, at(m)).otherwise(none), lambda c: one(m, c)))))
    amounts = F.filter("found", lambda f: f["field"] == "amount")
    operand = lambda f: text.lookup({"amount": "declared_total"} | {n: n for n in ("quantity", "unit_price", "index", "coefficient")}, f["field"])
    per = found.select(
        "path", "sheet", "header", "row", "named", F.map_from_entries(F.transform("found", lambda f: F.struct(f["field"], f["value"]))).alias("fields"), F.col("found")["ref"].alias("refs"),
        F.array_max(F.transform(amounts, lambda f: f["formula"])).alias("formula"), F.array_max(F.transform(amounts, lambda f: f["ref"])).alias("amount_ref"),
        F.exists("found", lambda f: F.coalesce(f["value"] != "", F.lit(False))).alias("filled"), F.map_from_entries(F.transform("found", lambda f: F.struct(letters(f), operand(f)))).alias("letters"),
    )
    blank = F.min(F.when(~F.col("filled") & ~F.col("named"), F.col("row"))).over(W.partitionBy("path", "sheet", "header"))
    kept = per.withColumn("blank", blank).where("filled AND (named OR blank IS NULL OR row < blank)")
    basis = formulas.product_basis(kept.select("path", "sheet", "header", "row", "fields", "refs", "formula", "amount_ref", F.col("fields").alias("values"), F.map_filter("letters", lambda _, f: f.isNotNull()).alias("mapped")).withColumn("fields", F.col("mapped")))
    return basis.select("path", "sheet", "header", "row", F.col("values").alias("fields"), "refs", F.struct(F.col("basis").alias("formula"), F.when(F.col("basis").isNotNull(), F.concat_ws("!", "sheet", "amount_ref")).alias("locator")).alias("basis"))


def _entries(values: dict[str, Column]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values()))


def sheet_records(cells: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Records of the rows and formulas of workbook cells."""
    rows = sheet_rows(cells, declared)
    basis = F.col("basis.formula")
    own = _entries({"row_id": F.concat_ws(":", "path", "sheet", "row"), "estimate_id": F.concat_ws(":", "path", "sheet"), "basis_formula": basis, "basis_verified": F.when(basis.isNotNull(), F.lit("true")), "basis_locator": F.col("basis.locator")})
    place = evidence({"sheet": F.col("sheet"), "cell_range": coords.cell_range(F.col("refs"))}, F.col("path"), F.concat("sheet", F.lit("!"), "row", F.lit(":"), "row"))
    found = rows.select(F.lit("estimate_row").alias("entity"), F.map_concat("fields", own).alias("fields"), F.lit("reliable").alias("reliability"), *[c.alias(n) for n, c in place.items()])
    key = F.concat_ws("\u0001", "path", "sheet")
    numbers = cells.where("ref IS NOT NULL").select(key.alias("sheet"), "ref", F.when(F.col("kind") == "number", F.col("value")).alias("value"), "formula")
    done = formulas.evaluate(numbers).select(F.col("sheet").alias("_key"), F.col("ref").alias("_ref"), F.col("value").alias("computed"))
    made = cells.where("formula IS NOT NULL").withColumn("_key", key).join(done.withColumnRenamed("_ref", "ref"), ["_key", "ref"], "left")
    fields = _entries({"formula_id": F.concat_ws(":", "path", "sheet", "ref"), "formula": F.col("formula"), "computed_value": F.col("computed"), "cached_value": F.col("value")})
    place = evidence({"sheet": F.col("sheet"), "cell_range": F.col("ref")}, F.col("path"), F.concat_ws("!", "sheet", "ref"))
    return found.unionByName(made.select(F.lit("formula").alias("entity"), fields.alias("fields"), F.lit("reliable").alias("reliability"), *[c.alias(n) for n, c in place.items()]))


def unclassified(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """(source_path, sheet, locator, reason) of sheets with cells but no row of a table."""
    sheets = cells.where("sheet IS NOT NULL AND value IS NOT NULL").select("path", "sheet").distinct()
    left = sheets.join(rows.select("path", "sheet").distinct(), ["path", "sheet"], "left_anti")
    return left.select(F.col("path").alias("source_path"), "sheet", F.concat("sheet", F.lit("!used-range")).alias("locator"), F.lit("header_not_recognized").alias("reason"))


def details(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """(path, details) of workbooks: scalars and counts of what they hold, none of their contents. parts as workbooks.read_structure gives them."""
    said = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("value"))).alias(kind)
    many = lambda kind, name: F.count_if(F.col("kind") == kind).alias(name)
    held = parts.where("kind <> 'refused'").groupBy("path").agg(
        many("sheet", "sheet_count"), F.count_if((F.col("kind") == "sheet") & (F.col("value") != "visible")).alias("hidden_sheet_count"), many("merged", "merged_range_count"), many("defined_name", "defined_name_count"), many("table", "table_count"),
        said("calculation"), said("macros"), said("external_links"),
    )
    formula = F.col("formula").isNotNull()
    counts = cells.where("kind <> 'refused'").groupBy("path").agg(F.count("*").alias("cell_count"), F.count_if(formula).alias("formula_count"), F.count_if(formula & F.col("value").isNull()).alias("missing_cached_formula_value_count"))
    both = held.join(counts, "path", "full")
    names = [c for c in both.columns if c != "path"]
    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).cast("string").alias("v")) for n in names]), lambda e: e["v"].isNotNull())
    return both.select("path", F.map_from_entries(pairs).alias("details"))


def page_table_rows(cells: DataFrame) -> DataFrame:
    """Records of table rows on pages: cells (source_path, page, table, row, col, text, x0, top, x1, bottom), row 0 the headers.

    A table needs three headers of different fields or more, with an anchor, and boxes for all mapped cells of a row.
    """
    key = ["source_path", "page", "table"]
    boxed = (F.col("x1") > F.col("x0")) & (F.col("bottom") > F.col("top")) & (F.col("x0") >= 0) & (F.col("top") >= 0)
    # dealt by table before anything is counted, into a fixed number of parts: a task that reads many cells, or many parts at once, would hold them all
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.where("source_path IS NOT NULL AND page IS NOT NULL AND `table` IS NOT NULL AND row >= 0").repartition(parts, *key)
    rows = dealt.groupBy(*key, "row").agg(F.collect_list(F.struct("col", "text", F.coalesce(boxed, F.lit(False)).alias("boxed"))).alias("cells"))
    field = lambda c: text.lookup(text.RECORD_HEADERS, text.collapsed(c["text"]))
    named = F.when(F.col("row") == 0, F.filter(F.transform("cells", lambda c: F.struct(field(c).alias("field"), c["col"].alias("col"))), lambda x: x["field"].isNotNull()))
    rows = rows.withColumn("map", F.first(_first_columns(named), ignorenulls=True).over(W.partitionBy(*key).orderBy("row")))
    fit = (F.size("map") >= 3) & F.exists("map", lambda m: m["field"].isin("quantity", "unit_price", "declared_total"))
    found = F.flatten(F.transform("map", lambda m: F.transform(F.filter("cells", lambda c: c["col"] == m["col"]), lambda c: F.struct(m["field"].alias("field"), c["text"].alias("text"), c["boxed"].alias("boxed")))))
    per = rows.where("row > 0").where(fit).withColumn("found", found).where(F.size(F.filter("found", lambda f: f["boxed"])) == F.size("map"))
    per = per.select(*key, "row", F.map_from_entries(F.transform("found", lambda f: F.struct(f["field"], f["text"]))).alias("fields"))
    name = F.concat(F.lit("page:"), "page", F.lit(":table:"), "table", F.lit(":row:"), "row")
    own = F.create_map(F.lit("row_id"), F.concat_ws(":", "source_path", name), F.lit("estimate_id"), F.concat("source_path", F.lit(":estimate")))
    place = evidence({"page": F.col("page")}, F.col("source_path"), name)
    return per.select(F.lit("estimate_row").alias("entity"), F.map_concat("fields", own).alias("fields"), F.lit("reliable").alias("reliability"), *[c.alias(n) for n, c in place.items()])


def located(limitations: DataFrame) -> DataFrame:
    """limitations with a source and a locator: by XPath and line, or page, where they have none."""
    line = F.coalesce(F.concat(F.lit(";line:"), F.col("line").cast("string")), F.lit(""))
    made = F.coalesce(F.concat(F.lit("xpath:"), F.when(F.col("xpath") != "", F.col("xpath")), line), F.concat(F.lit("page:"), F.col("page").cast("string")), F.lit("unresolved-evidence"))
    return limitations.withColumns({"locator": F.coalesce(F.when(F.col("locator") != "", F.col("locator")), made), "source_path": F.coalesce("source_path", F.lit("unknown"))})


def displayed(path: Column, root: str) -> Column:
    """A path below root as it is shown: without the folders above, and without a scheme. Members keep what follows `!/`."""
    plain = F.regexp_replace(path, "^[a-z][a-z0-9+.-]*:/+", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") if "://" in root or ":/" in root else root.rstrip("/")
    inner = F.when(plain.startswith(base + "/"), F.substring(plain, len(base) + 2, 1 << 30))
    return F.coalesce(inner, F.regexp_extract(plain, r"([^/]+(?:!/.*)?)$", 1))
