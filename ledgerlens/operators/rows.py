"""Controls over rows: arithmetic, stored formulas, required fields, duplicates, components, quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions import decimals
from ledgerlens.functions.evidence import precise, reliable, with_evidence
from ledgerlens.functions.text import blank, collapsed, folded, semantic_name, trimmed
from ledgerlens.operators.ranges import dealt

# The products that a row total may be.
OPERANDS = {
    "quantity * unit_price": ["quantity", "unit_price"],
    "quantity * unit_price * index": ["quantity", "unit_price", "index"],
    "quantity * unit_price * coefficient": ["quantity", "unit_price", "coefficient"],
    "quantity * unit_price * index * coefficient": ["quantity", "unit_price", "index", "coefficient"],
}
# The fields that a row, and a record of each component collection, must have.
REQUIRED = ["name", "quantity", "unit", "unit_price", "declared_total"]
COMPONENTS = {
    "resources": ["resource_id", "name", "quantity", "unit", "unit_price", "declared_total"],
    "accruals": ["accrual_id", "name", "basis", "rate", "declared_total"],
    "indices": ["index_id", "value"],
    "coefficients": ["coefficient_id", "value"],
    "totals": ["total_type", "declared_total"],
}


def missing(fields: list[str]) -> Column:
    """Names of the blank ones of these columns."""
    pairs = F.array(*[F.when(blank(F.col(f)), F.lit(f)) for f in fields])
    return F.array_compact(pairs)


def arithmetic(rows: DataFrame) -> DataFrame:
    """(row_id, status, observed, expected, difference) of each reliable row.

    A row needs quantity, price and total, then a verified basis of a known formula, then its operands; the
    total must equal their exact product. Columns of narrow decimals are multiplied natively; texts and wider
    decimals go through a decimal context of 28 digits, in Arrow batches.
    """
    rows = rows.where(reliable())
    fields = OPERANDS["quantity * unit_price * index * coefficient"]
    native = decimals.narrow(rows, fields)
    text = not native and dict(rows.dtypes)["quantity"] == "string"
    value = (lambda f: decimals.cleaned(F.col(f))) if text else (lambda f: F.col(f) if native else F.col(f).cast("string"))
    known = F.col("basis_formula").isin(*OPERANDS) & F.coalesce(F.col("basis_verified"), F.lit(False)) & F.coalesce(trimmed(F.col("basis_locator")) != "", F.lit(False))
    uses = lambda f: F.col("basis_formula").contains(f"* {f}")
    lacks = (uses("index") & value("index").isNull()) | (uses("coefficient") & value("coefficient").isNull())
    base = value("quantity").isNull() | value("unit_price").isNull() | value("declared_total").isNull()
    early = F.when(base, "needs_input").when(~F.coalesce(known, F.lit(False)), "limited").when(lacks, "needs_input")
    if native:
        one = F.lit(1).cast("decimal(1,0)")
        factors = [F.col("quantity"), F.col("unit_price"), F.when(uses("index"), F.col("index")).otherwise(one), F.when(uses("coefficient"), F.col("coefficient")).otherwise(one)]
        expected = decimals.product(factors)
        rows = rows.withColumns({"early": early, "expected": expected})
        open_ = F.col("early").isNull()
        status = F.coalesce("early", F.when(F.col("declared_total") == F.col("expected"), "passed").otherwise("finding"))
        gap = F.col("declared_total") - F.col("expected")
        return rows.select("row_id", status.alias("status"), F.col("declared_total").alias("observed"), F.when(open_, F.col("expected")).alias("expected"), F.when(open_, gap).alias("difference"))
    chosen = F.array_compact(F.array(value("quantity"), value("unit_price"), F.when(uses("index"), value("index")), F.when(uses("coefficient"), value("coefficient"))))
    rows = rows.withColumns({"early": early, "stated": value("declared_total")})
    rows = rows.withColumn("p", decimals.product_text(F.when(F.col("early").isNull(), F.col("stated")), F.when(F.col("early").isNull(), chosen)))
    status = F.coalesce("early", F.when(F.col("p.equal"), "passed").otherwise("finding"))
    return rows.select("row_id", status.alias("status"), F.col("stated").alias("observed"), F.col("p.expected").alias("expected"), F.col("p.difference").alias("difference"))


def formulas(records: DataFrame) -> DataFrame:
    """(formula_id, status, reason, difference) of stored formulas: computed against cached value."""
    records = with_evidence(records)
    computed, cached = F.col("computed_value"), F.col("cached_value")
    both = computed.isNull() & cached.isNull()
    one = computed.isNull() | cached.isNull()
    status = F.when(~reliable() | ~precise(), "limited").when(both, "needs_input").when(one, "limited").when(computed == cached, "passed").otherwise("finding")
    reason = (
        F.when(~reliable(), "formula_extraction_not_reliable").when(~precise(), "formula_evidence_not_precise").when(both, "formula_values_not_available")
        .when(one, "formula_independent_recalculation_unavailable").when(computed != cached, "cached_value_mismatch")
    )
    gap = F.when(status == "finding", cached - computed)
    return records.select("formula_id", status.alias("status"), reason.alias("reason"), gap.alias("difference"))


def fields(rows: DataFrame) -> DataFrame:
    """(row_id, status, missing) of reliable rows with blank required fields; unverified ones need input."""
    gone = missing(REQUIRED)
    status = F.when(F.coalesce(F.col("source_fields_verified_complete"), F.lit(False)), "finding").otherwise("needs_input")
    return rows.where(reliable()).select("row_id", status.alias("status"), F.array_join(gone, ", ").alias("missing")).where("missing <> ''")


def _complete(rows: DataFrame) -> DataFrame:
    return rows.where(reliable() & (F.size(missing(REQUIRED)) == 0))


def _numbered(groups: DataFrame) -> DataFrame:
    """groups numbered by first appearance, singletons included.

    The numbers need a total order; ranks are taken within ranges of it, so no task gets all groups.
    """
    ranged = dealt(groups, "first")
    ranged = ranged.withColumn("rank", F.row_number().over(W.partitionBy("part").orderBy("first")))
    ahead = ranged.groupBy("part").agg(F.max("rank").alias("n"))
    before = ahead.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row per range
    return ranged.join(F.broadcast(before), "part").withColumn("ordinal", (F.col("rank") + F.col("before")).cast("long"))


def exact_duplicates(rows: DataFrame) -> DataFrame:
    """(ordinal, copies, first) of groups of rows equal in seven normalised fields. `ord` orders the rows."""
    keys = [collapsed(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f) for f in ("estimate_id", "code", "name", "quantity", "unit", "unit_price", "declared_total")]
    groups = _complete(rows).groupBy(*keys).agg(F.count("*").alias("copies"), F.min("ord").alias("first"))
    return _numbered(groups).where("copies > 1").select("ordinal", "copies", "first")


def semantic_duplicates(rows: DataFrame) -> DataFrame:
    """(ordinal, copies, first) of groups of one estimate, name, quantity and unit that differ otherwise."""
    text = lambda f: F.coalesce(F.col(f).cast("string"), F.lit(""))
    keys = [text("estimate_id").alias("k1"), semantic_name(text("name")).alias("k2"), F.replace(text("quantity"), F.lit(","), F.lit(".")).alias("k3"), folded(trimmed(text("unit"))).alias("k4")]
    sign = F.xxhash64(*[collapsed(text(f)) for f in ("code", "name", "quantity", "unit", "unit_price", "declared_total")])
    made = _complete(rows).select(*keys, sign.alias("sign"), "ord")
    groups = made.groupBy("k1", "k2", "k3", "k4").agg(F.count("*").alias("copies"), F.min("sign").alias("low"), F.max("sign").alias("high"), F.min("ord").alias("first"))
    return _numbered(groups).where("copies > 1 AND low <> high").select("ordinal", "copies", "first")


def components(collections: dict[str, DataFrame]) -> DataFrame:
    """(collection, record_id, status, missing) over the five component collections; a value that is no number is a finding."""
    out = None
    for name, names in COMPONENTS.items():
        if name not in collections:
            continue
        rows = collections[name]
        gone = missing(names)
        if "value" in names:
            gone = F.when((F.size(gone) == 0) & decimals.cleaned(F.col("value").cast("string")).isNull(), F.array(F.lit("numeric_value"))).otherwise(gone)
        identifier = names[0] if name != "totals" else "total_id"
        text = F.array_join(gone, ", ")
        status = F.when(text == "", "passed").when(F.coalesce(F.col("source_fields_verified_complete"), F.lit(False)) | (text == "numeric_value"), "finding").otherwise("needs_input")
        part = rows.select(F.lit(name).alias("collection"), F.col(identifier).cast("string").alias("record_id"), status.alias("status"), text.alias("missing"))
        out = part if out is None else out.unionByName(part)
    return out


def quotes(kacs: DataFrame) -> DataFrame:
    """(kac_id, status, missing) of price quotes: eleven tests of completeness; never a finding."""
    kacs = with_evidence(kacs)

    def has(name: str) -> Column:
        if name not in kacs.columns:
            return F.lit(False)
        c = F.col(name)
        return c.isNotNull() & (trimmed(c) != "") if dict(kacs.dtypes)[name] == "string" else c.isNotNull()

    either = lambda *names: F.greatest(*[has(n) for n in names]) if len(names) > 1 else has(names[0])
    raw = [F.when(has(n), F.col(n).cast("string")) for n in ("price", "unit_price") if n in kacs.columns]
    price = decimals.parse(F.coalesce(*raw))
    named = either("name_characteristics", "description") | (has("name") & has("characteristics"))
    flags = [n for n in ("comparability", "comparability_basis", "comparison_basis") if n in kacs.columns]
    same = F.greatest(F.lit(False), *[F.coalesce(F.col(n), F.lit(False)) if dict(kacs.dtypes)[n] == "boolean" else has(n) for n in flags])
    # fixed values: the names of the tests, and the fields that each of them accepts
    tests = [
        ("price", F.coalesce(price > 0, F.lit(False))), ("name_characteristics", named), ("unit", has("unit")),
        ("region_or_supply_terms", either("region", "region_or_price_zone", "supply_terms", "delivery_terms", "terms_of_supply")),
        ("currency", either("currency", "currency_code")), ("comparability", same),
        *[(n, has(n)) for n in ("source", "date", "vat_included", "delivery_included")], ("evidence", precise()),
    ]
    gone = F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in tests])), ", ")
    status = F.when(~reliable(), "limited").when(gone != "", "needs_input").otherwise("passed")
    return kacs.select("kac_id", status.alias("status"), gone.alias("missing"))


def exclusion(rows: DataFrame) -> DataFrame:
    """rows with `excluded`: why cost analytics leaves a row out; null if it counts."""
    rows = with_evidence(rows)
    category = folded(trimmed(F.coalesce(F.col("category"), F.lit(""))))
    reason = F.when(~reliable(), "unreliable").when(~precise(), "imprecise_evidence").when(F.col("declared_total").isNull(), "invalid_amount").when(category.isin("", "unclassified", "uncategorized"), "uncategorized")
    return rows.withColumn("excluded", reason)


def cost_structure(rows: DataFrame) -> DataFrame:
    """(kind, name, total, n): categories, the grand total, and excluded rows by reason, in one aggregation."""
    marked = exclusion(rows)
    grouped = marked.groupBy(F.when(F.col("excluded").isNull(), trimmed(F.col("category"))).alias("category"), "excluded").agg(F.sum("declared_total").alias("total"), F.count("*").alias("n"))
    kept = grouped.where("excluded IS NULL")
    total = kept.agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return (
        kept.select(F.lit("category").alias("kind"), F.col("category").alias("name"), "total", "n")
        .unionByName(total.select(F.lit("total").alias("kind"), F.lit("").alias("name"), "total", "n"))
        .unionByName(grouped.where("excluded IS NOT NULL").groupBy(F.col("excluded").alias("name")).agg(F.sum("n").alias("n")).select(F.lit("excluded").alias("kind"), "name", F.lit(None).cast(grouped.schema["total"].dataType).alias("total"), "n"))
    )


def vat(records: DataFrame) -> DataFrame:
    """(vat_id, status, expected, difference): (base - sum of exempt amounts) * rate against the declared amount."""
    exempt = F.aggregate("exempt_amounts", F.lit(0).cast("decimal(18,2)"), lambda a, x: (a + x).cast("decimal(18,2)"))
    expected = (F.col("base_before_exemptions") - exempt) * F.col("rate")
    lacking = F.col("base_before_exemptions").isNull() | F.col("rate").isNull() | F.col("declared_amount").isNull() | F.exists("exempt_amounts", lambda x: x.isNull())
    trusted = F.coalesce(F.col("source_fields_verified_complete"), F.lit(False))
    status = F.when(~trusted | lacking, "needs_input").when(F.col("declared_amount") == expected, "passed").otherwise("finding")
    open_ = status.isin("passed", "finding")
    return records.select("vat_id", status.alias("status"), F.when(open_, expected).alias("expected"), F.when(open_, F.col("declared_amount") - expected).alias("difference"))


def contracts(records: DataFrame) -> DataFrame:
    """(contract_id, finding, observed, expected) of two tests: original + changes = revised, and revised <= project."""
    sums = F.col("original") + F.col("changes")
    one = F.when(F.col("revised") != sums, F.struct(F.lit("revised_total").alias("finding"), F.col("revised").alias("observed"), sums.cast("decimal(18,2)").alias("expected")))
    two = F.when(F.col("revised") > F.col("project"), F.struct(F.lit("project_exceeded").alias("finding"), F.col("revised").alias("observed"), F.col("project").alias("expected")))
    return records.select("contract_id", F.explode(F.array_compact(F.array(one, two))).alias("f")).select("contract_id", "f.finding", "f.observed", "f.expected")
