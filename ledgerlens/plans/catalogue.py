"""Registered queries and the SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import coords, decimals, text
from ledgerlens.functions.evidence import precise, verified, with_evidence
from ledgerlens.operators import formulas, hierarchy, rollup, rows, tables
from ledgerlens.plans.views import duck, select

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = duck(sql)
        return f

    return add


_ARITH = """
SELECT row_id, CASE WHEN quantity IS NULL OR unit_price IS NULL OR declared_total IS NULL THEN 'needs_input'
    WHEN NOT basis_verified OR trim(basis_locator) = '' THEN 'limited'
    WHEN basis_formula LIKE '%index%' AND "index" IS NULL THEN 'needs_input'
    WHEN declared_total = quantity * unit_price * CASE WHEN basis_formula LIKE '%index%' THEN "index" ELSE 1.00 END * CASE WHEN basis_formula LIKE '%coefficient%' THEN coefficient ELSE 1.00 END THEN 'passed' ELSE 'finding' END AS status,
  declared_total AS observed, cast(quantity * unit_price * CASE WHEN basis_formula LIKE '%index%' THEN "index" ELSE 1.00 END * CASE WHEN basis_formula LIKE '%coefficient%' THEN coefficient ELSE 1.00 END AS decimal(38,8)) AS expected
FROM v_rows WHERE reliability = 'reliable'"""


@query(f"""
WITH a AS ({_ARITH})
SELECT row_id, status, observed, CASE WHEN status IN ('passed', 'finding') THEN expected END AS expected, CASE WHEN status IN ('passed', 'finding') THEN observed - expected END AS difference FROM a""")
def arith_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rows.arithmetic(select(spark, sf_dir, "SELECT * FROM v_rows"))
    return out.select("row_id", "status", F.col("observed").cast("decimal(24,8)").alias("observed"), F.col("expected").cast("decimal(38,8)").alias("expected"), F.col("difference").cast("decimal(38,8)").alias("difference"))


@query(f"""
WITH a AS ({_ARITH}), s AS (SELECT status, count(*) AS n FROM a GROUP BY status)
SELECT (SELECT status FROM s ORDER BY CASE status WHEN 'finding' THEN 0 WHEN 'needs_input' THEN 1 WHEN 'limited' THEN 2 ELSE 3 END LIMIT 1) AS status, (SELECT sum(n)::BIGINT FROM s) AS n""")
def arith_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.state(arith_rows(spark, sf_dir))


@query("""
WITH f AS (SELECT *, coalesce(reliability, 'reliable') <> 'reliable' AS bad, page <= 0 AS vague FROM v_formulas),
s AS (SELECT *, CASE WHEN bad OR vague THEN 'limited' WHEN computed_value IS NULL AND cached_value IS NULL THEN 'needs_input' WHEN computed_value IS NULL OR cached_value IS NULL THEN 'limited' WHEN computed_value = cached_value THEN 'passed' ELSE 'finding' END AS status FROM f)
SELECT formula_id, status, CASE WHEN bad THEN 'formula_extraction_not_reliable' WHEN vague THEN 'formula_evidence_not_precise' WHEN computed_value IS NULL AND cached_value IS NULL THEN 'formula_values_not_available'
  WHEN computed_value IS NULL OR cached_value IS NULL THEN 'formula_independent_recalculation_unavailable' WHEN computed_value <> cached_value THEN 'cached_value_mismatch' END AS reason,
  CASE WHEN status = 'finding' THEN (cached_value - computed_value)::DECIMAL(18,4) END AS difference FROM s""")
def formula_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rows.formulas(select(spark, sf_dir, "SELECT * FROM v_formulas"))
    return out.withColumn("difference", F.col("difference").cast("decimal(18,4)"))


@query("""
WITH m AS (SELECT row_id, source_fields_verified_complete AS v, concat_ws(', ', CASE WHEN coalesce(name, '') = '' THEN 'name' END, CASE WHEN quantity IS NULL THEN 'quantity' END, CASE WHEN coalesce(unit, '') = '' THEN 'unit' END,
  CASE WHEN unit_price IS NULL THEN 'unit_price' END, CASE WHEN declared_total IS NULL THEN 'declared_total' END) AS missing FROM v_rows WHERE reliability = 'reliable')
SELECT row_id, CASE WHEN v THEN 'finding' ELSE 'needs_input' END AS status, missing FROM m WHERE missing <> ''""")
def field_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.fields(select(spark, sf_dir, "SELECT * FROM v_rows"))


_PARTS = {
    "resources": "SELECT p_partkey AS resource_id, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_name END AS name, p_size AS quantity, 'pcs' AS unit, p_retailprice AS unit_price, CASE WHEN p_partkey % 14 = 0 THEN NULL ELSE p_retailprice END AS declared_total, p_partkey % 2 = 0 AS source_fields_verified_complete FROM part",
    "accruals": "SELECT s_suppkey AS accrual_id, s_name AS name, CASE WHEN s_suppkey % 8 = 0 THEN '' ELSE 'base' END AS basis, s_acctbal AS rate, s_acctbal AS declared_total, s_suppkey % 16 = 0 AS source_fields_verified_complete FROM supplier",
    "indices": "SELECT event_id AS index_id, CASE WHEN event_id % 6 = 0 THEN 'not-a-number' WHEN event_id % 7 = 0 THEN '1 234,5' WHEN event_id % 8 = 0 THEN '' ELSE '1.10' END AS value, event_id % 16 = 0 AS source_fields_verified_complete FROM events",
    "totals": "SELECT o_orderkey AS total_id, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END AS total_type, o_totalprice AS declared_total, o_orderkey % 20 = 0 AS source_fields_verified_complete FROM orders",
}


@query(f"""
WITH r AS ({_PARTS["resources"]}), a AS ({_PARTS["accruals"]}), i AS ({_PARTS["indices"]}), t AS ({_PARTS["totals"]}),
u AS (SELECT 'resources' AS collection, resource_id::VARCHAR AS record_id, source_fields_verified_complete AS v, concat_ws(', ', CASE WHEN name IS NULL THEN 'name' END, CASE WHEN declared_total IS NULL THEN 'declared_total' END) AS missing FROM r
UNION ALL SELECT 'accruals', accrual_id::VARCHAR, source_fields_verified_complete, CASE WHEN basis = '' THEN 'basis' ELSE '' END FROM a
UNION ALL SELECT 'indices', index_id::VARCHAR, source_fields_verified_complete, CASE value WHEN '' THEN 'value' WHEN 'not-a-number' THEN 'numeric_value' ELSE '' END FROM i
UNION ALL SELECT 'totals', total_id::VARCHAR, source_fields_verified_complete, CASE WHEN total_type IS NULL THEN 'total_type' ELSE '' END FROM t)
SELECT collection, record_id, CASE WHEN missing = '' THEN 'passed' WHEN v OR missing = 'numeric_value' THEN 'finding' ELSE 'needs_input' END AS status, missing FROM u""")
def component_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.components({n: select(spark, sf_dir, s) for n, s in _PARTS.items()})


_DOC_ROWS = "SELECT doc_id AS ord, lang AS estimate_id, '' AS code, text AS name, 1 AS quantity, source AS unit, 1 AS unit_price, n_chars AS declared_total, 'reliable' AS reliability FROM documents"


@query("""
WITH k AS (SELECT doc_id, lang, source, n_chars, regexp_replace(lower(regexp_replace(text, '^[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]+|[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]+$', '', 'g')), '[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]+', ' ', 'g') AS name FROM documents WHERE text <> '' AND source <> ''),
g AS (SELECT count(*) AS copies, min(doc_id) AS first FROM k GROUP BY lang, replace(name, 'ß', 'ss'), source, n_chars), n AS (SELECT *, row_number() OVER (ORDER BY first) AS ordinal FROM g)
SELECT ordinal, copies, first FROM n WHERE copies > 1""")
def dup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.exact_duplicates(select(spark, sf_dir, _DOC_ROWS))


@query("""
WITH g AS (SELECT count(*) AS copies, min(p_partkey) AS first, count(DISTINCT p_brand) AS kinds FROM part GROUP BY trim(regexp_replace(lower(p_name), '[^0-9a-zа-я]+', ' ', 'g')), p_size),
n AS (SELECT *, row_number() OVER (ORDER BY first) AS ordinal FROM g) SELECT ordinal, copies, first FROM n WHERE copies > 1 AND kinds > 1""")
def dup_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.semantic_duplicates(select(spark, sf_dir, "SELECT p_partkey AS ord, '' AS estimate_id, p_brand AS code, p_name AS name, p_size AS quantity, 'pcs' AS unit, 1 AS unit_price, 1 AS declared_total, 'reliable' AS reliability FROM part"))


_KIND = "CASE lower(trim(estimate_type)) WHEN 'lsr' THEN 'LSR' WHEN 'osr' THEN 'OSR' WHEN 'ssr' THEN 'SSR' WHEN 'object_or_summary_estimate' THEN 'OSR_OR_SSR' END"


@query(f"""
WITH e AS (SELECT *, {_KIND} AS kind, coalesce(reliability, 'reliable') = 'reliable' AS ok, xpath LIKE '/%' AS exact FROM v_estimates),
j AS (SELECT c.estimate_id AS child_id, c.parent_id, c.kind AS ck, p.kind AS pk, c.ok AND p.ok AS ok, c.exact AND p.exact AS exact, c.direct_allowed AS d, p.estimate_id IS NULL AS lost FROM e c LEFT JOIN e p ON p.estimate_id = c.parent_id WHERE c.parent_id IS NOT NULL)
SELECT child_id, parent_id, ck AS child_type, pk AS parent_type,
  CASE WHEN lost THEN 'needs_input' WHEN NOT ok OR NOT exact THEN 'limited' WHEN ck = 'LSR' AND pk = 'SSR' THEN CASE WHEN d THEN 'passed' WHEN NOT d THEN 'finding' ELSE 'needs_input' END
    WHEN (ck = 'LSR' AND pk = 'OSR') OR (ck = 'OSR' AND pk = 'SSR') THEN 'passed' WHEN ck IS NULL OR pk IS NULL OR 'OSR_OR_SSR' IN (ck, pk) THEN 'needs_input' ELSE 'finding' END AS status,
  CASE WHEN lost THEN 'parent_not_found' WHEN NOT ok THEN 'hierarchy_records_not_reliable' WHEN NOT exact THEN 'hierarchy_evidence_not_precise'
    WHEN ck = 'LSR' AND pk = 'SSR' THEN CASE WHEN d THEN 'trusted_direct_lsr_to_ssr_allowed' WHEN NOT d THEN 'trusted_direct_lsr_to_ssr_forbidden' ELSE 'direct_lsr_to_ssr_route_not_attested' END
    WHEN (ck = 'LSR' AND pk = 'OSR') OR (ck = 'OSR' AND pk = 'SSR') THEN 'expected_hierarchy_direction' WHEN ck IS NULL OR pk IS NULL OR 'OSR_OR_SSR' IN (ck, pk) THEN 'hierarchy_types_not_resolved' ELSE 'invalid_hierarchy_direction' END AS reason
FROM j""")
def hier_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.relations(select(spark, sf_dir, "SELECT * FROM v_estimates"))


@query("""
WITH e AS (SELECT *, coalesce(reliability, 'reliable') = 'reliable' AS ok, xpath LIKE '/%' AS exact FROM v_estimates),
c AS (SELECT parent_id, sum(declared_total) AS expected, count(*) - count(declared_total) AS unknown, bool_and(ok) AS ok, bool_and(exact) AS exact FROM e WHERE parent_id IS NOT NULL GROUP BY parent_id)
SELECT c.parent_id, CASE WHEN NOT (c.ok AND p.ok AND c.exact AND p.exact) THEN 'limited' WHEN p.declared_total IS NULL OR unknown > 0 THEN 'needs_input' WHEN p.declared_total <> expected THEN 'finding' ELSE 'passed' END AS status,
  CASE WHEN NOT (c.ok AND p.ok) THEN 'hierarchy_records_not_reliable' WHEN NOT (c.exact AND p.exact) THEN 'hierarchy_evidence_not_precise' WHEN p.declared_total IS NULL OR unknown > 0 THEN 'hierarchy_totals_not_available' WHEN p.declared_total <> expected THEN 'total_mismatch' ELSE 'totals_reconciled' END AS reason,
  p.declared_total::DECIMAL(20,2) AS observed, expected::DECIMAL(28,2) AS expected FROM c JOIN e p ON p.estimate_id = c.parent_id""")
def hier_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hierarchy.totals(select(spark, sf_dir, "SELECT * FROM v_estimates"))
    return out.withColumns({"observed": F.col("observed").cast("decimal(20,2)"), "expected": F.col("expected").cast("decimal(28,2)")})


@query("""
WITH RECURSIVE l AS (SELECT child, parent FROM v_links WHERE parent IN (SELECT child FROM v_links)),
w(s, x, path) AS (SELECT child, child, [child] FROM l UNION ALL SELECT w.s, l.parent, list_append(w.path, l.parent) FROM w JOIN l ON l.child = w.x WHERE NOT list_contains(w.path[:-2], w.x)),
z AS (SELECT s, x AS entry, path[list_position(path, x):-2] AS ring FROM w WHERE list_contains(path[:-2], x)),
r AS (SELECT min(s) AS s, list_min(ring) AS least FROM z GROUP BY list_min(ring))
SELECT z.entry, len(z.ring)::BIGINT AS length, r.least FROM r JOIN z ON z.s = r.s AND list_min(z.ring) = r.least""")
def hier_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.cycles(select(spark, sf_dir, "SELECT * FROM v_links"))


_VAT = """SELECT l_orderkey AS vat_id, sum(cast(l_extendedprice AS decimal(12,2))) AS base, sum(CASE WHEN l_tax = 0 THEN cast(l_extendedprice AS decimal(12,2)) ELSE cast(0 AS decimal(12,2)) END) AS exempt FROM lineitem GROUP BY l_orderkey"""
_VAT_DECLARED = "cast((base - exempt) * cast(0.22 AS decimal(3,2)) AS decimal(18,4)) + CASE WHEN vat_id % 6 = 0 THEN cast(0.01 AS decimal(18,4)) ELSE cast(0 AS decimal(18,4)) END"


@query(f"""
WITH t AS ({_VAT}), d AS (SELECT *, {_VAT_DECLARED} AS declared FROM t)
SELECT vat_id, CASE WHEN vat_id % 10 = 0 THEN 'needs_input' WHEN vat_id % 6 = 0 THEN 'finding' ELSE 'passed' END AS status, CASE WHEN vat_id % 10 <> 0 THEN ((base - exempt) * 0.22)::DECIMAL(18,4) END AS expected,
  CASE WHEN vat_id % 10 <> 0 THEN (declared - (base - exempt) * 0.22)::DECIMAL(18,4) END AS difference FROM d""")
def vat_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = select(spark, sf_dir, f"SELECT vat_id, cast(base AS decimal(16,2)) AS base_before_exemptions, cast(exempt AS decimal(16,2)) AS exempt, cast(0.22 AS decimal(3,2)) AS rate, {_VAT_DECLARED} AS declared_amount, vat_id % 10 <> 0 AS source_fields_verified_complete FROM ({_VAT}) t")
    out = rows.vat(sums.withColumn("exempt_amounts", F.array(F.col("exempt").cast("decimal(18,2)"))))
    return out.withColumns({c: F.col(c).cast("decimal(18,4)") for c in ("expected", "difference")})


_CONTRACT = """SELECT o_custkey AS contract_id, sum(cast(o_totalprice AS decimal(14,2))) AS original, sum(CASE WHEN o_orderstatus = 'O' THEN cast(100 AS decimal(14,2)) ELSE cast(-50 AS decimal(14,2)) END) AS changes FROM orders GROUP BY o_custkey"""
_CONTRACT_ROW = "contract_id, cast(original AS decimal(16,2)) AS original, cast(changes AS decimal(16,2)) AS changes, cast(original + changes + CASE WHEN contract_id % 4 = 0 THEN 10 ELSE 0 END AS decimal(18,2)) AS revised, cast(original AS decimal(18,2)) AS project"


@query(f"""
WITH c AS (SELECT {_CONTRACT_ROW} FROM ({_CONTRACT}) t)
SELECT contract_id, 'revised_total' AS finding, revised AS observed, (original + changes)::DECIMAL(18,2) AS expected FROM c WHERE revised <> original + changes
UNION ALL SELECT contract_id, 'project_exceeded', revised, project FROM c WHERE revised > project""")
def contract_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.contracts(select(spark, sf_dir, f"SELECT {_CONTRACT_ROW} FROM ({_CONTRACT}) t"))


_EXCLUDED = "CASE WHEN reliability <> 'reliable' THEN 'unreliable' WHEN trim(sheet) = '' THEN 'imprecise_evidence' WHEN declared_total IS NULL THEN 'invalid_amount' WHEN lower(trim(category)) IN ('', 'unclassified', 'uncategorized') THEN 'uncategorized' END"


@query(f"""
WITH r AS (SELECT *, {_EXCLUDED} AS excluded FROM v_rows)
SELECT 'category' AS kind, category AS name, sum(declared_total)::DECIMAL(38,8) AS total, count(*) AS n FROM r WHERE excluded IS NULL GROUP BY category
UNION ALL SELECT 'total', '', sum(declared_total)::DECIMAL(38,8), count(*) FROM r WHERE excluded IS NULL UNION ALL SELECT 'excluded', excluded, NULL, count(*) FROM r WHERE excluded IS NOT NULL GROUP BY excluded""")
def cost_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rows.cost_structure(select(spark, sf_dir, "SELECT * FROM v_rows"))
    return out.withColumn("total", F.col("total").cast("decimal(38,8)"))


@query(f"""
SELECT category, sum(declared_total)::DECIMAL(38,8) AS total, sum(quantity)::DECIMAL(20,2) AS quantity, CASE WHEN sum(quantity) > 0 THEN 'usable' ELSE 'unit_indicator_value_not_usable' END AS indicator
FROM v_rows WHERE {_EXCLUDED} IS NULL GROUP BY category""")
def cost_unit_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rows.exclusion(select(spark, sf_dir, "SELECT * FROM v_rows")).where("excluded IS NULL")
    out = kept.groupBy("category").agg(F.sum("declared_total").cast("decimal(38,8)").alias("total"), F.sum("quantity").cast("decimal(20,2)").alias("quantity"))
    return out.withColumn("indicator", F.when(F.col("quantity") > 0, "usable").otherwise("unit_indicator_value_not_usable"))


@query("""
WITH m AS (SELECT kac_id, reliability, concat_ws(', ', CASE WHEN price IN ('0', 'n/a') THEN 'price' END, CASE WHEN trim(characteristics) = '' THEN 'name_characteristics' END, CASE WHEN unit IS NULL THEN 'unit' END, CASE WHEN region_or_price_zone = '' THEN 'region_or_supply_terms' END,
  CASE WHEN NOT comparability AND comparability_basis IS NULL THEN 'comparability' END, CASE WHEN vat_included IS NULL THEN 'vat_included' END, CASE WHEN page < 0 THEN 'evidence' END) AS missing FROM v_kacs)
SELECT kac_id, CASE WHEN reliability = 'partial' THEN 'limited' WHEN missing <> '' THEN 'needs_input' ELSE 'passed' END AS status, missing FROM m""")
def kac_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.quotes(select(spark, sf_dir, "SELECT * FROM v_kacs"))


_PLACES = "SELECT page_id, url AS source_path, CASE WHEN page_id % 5 = 0 THEN '  ' ELSE 'l' END AS locator, CASE WHEN page_id % 3 = 0 THEN 'S' END AS sheet, CASE WHEN page_id % 6 = 0 THEN 'A1' END AS cell_range, cast(page_id % 4 - 1 AS int) AS page, CASE WHEN page_id % 7 = 0 THEN '/a/b' WHEN page_id % 7 = 1 THEN 'a' END AS xpath, page_id % 2 = 0 AS source_fields_verified_complete FROM pages"


@query(f"""
WITH p AS ({_PLACES}) SELECT page_id, e AS precise, e AND source_fields_verified_complete AS verified
FROM (SELECT *, url_ok AND trim(locator) <> '' AND ((sheet IS NOT NULL AND cell_range IS NOT NULL) OR page > 0 OR coalesce(xpath LIKE '/%', false)) AS e FROM (SELECT *, coalesce(trim(source_path) <> '', false) AS url_ok FROM p) q) r""")
def evidence_precise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_evidence(select(spark, sf_dir, _PLACES)).select("page_id", precise().alias("precise"), verified().alias("verified"))


_SOURCES = "SELECT page_id AS source_id, CASE WHEN page_id % 3 = 0 THEN 'internal' ELSE 'law' END AS class, CASE WHEN page_id % 4 = 0 THEN replace(replace(url, 'https:', 'ftp:'), 'http:', 'ftp:') ELSE url END AS official_url, page_id % 7 <> 0 AS current_verified, CASE WHEN page_id % 11 = 0 THEN ' ' ELSE 'e' END AS edition, 'p' AS pinpoint FROM pages"


@query(f"""
WITH s AS ({_SOURCES}), v AS (SELECT source_id FROM s WHERE current_verified AND trim(edition) <> '' AND (class = 'internal' OR official_url LIKE 'http://%' OR official_url LIKE 'https://%'))
SELECT doc_id AS id FROM documents WHERE doc_id % 97 IN (SELECT source_id FROM v) AND doc_id % 101 IN (SELECT source_id FROM v)""")
def source_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = select(spark, sf_dir, "SELECT doc_id AS id, array(doc_id % 97, doc_id % 101) AS source_ids FROM documents")
    return rollup.cited(findings, select(spark, sf_dir, _SOURCES)).select("id")


_CHECKS = "SELECT 'INV-01' AS id, 'passed' AS status UNION ALL SELECT 'HIER-01', 'not_applicable' UNION ALL SELECT 'ARITH-01', 'finding' UNION ALL SELECT 'KAC-01', 'needs_input' UNION ALL SELECT 'VAT-01', 'not_applicable' UNION ALL SELECT 'DUP-01', CASE WHEN count(*) > 10 THEN 'passed' ELSE 'finding' END FROM part UNION ALL SELECT 'ROUTE-PIR', 'not_applicable'"


@query(f"""
WITH c AS ({_CHECKS}), m(id, source, absent) AS (VALUES {", ".join(f"('{i}', {repr(rollup.ANSWERS[i][0]) if i in rollup.ANSWERS else 'NULL'}, {str(rollup.ANSWERS.get(i, (0, False))[1]).lower()})" for i in rollup.MATRIX)})
SELECT m.id, CASE WHEN m.id = 'CAP-01' THEN 'not_applicable' WHEN source IS NULL OR c.status IS NULL THEN 'limited' WHEN absent AND c.status = 'not_applicable' THEN 'limited' ELSE c.status END AS status, source FROM m LEFT JOIN c ON c.id = m.source""")
def matrix_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.matrix(select(spark, sf_dir, _CHECKS))


@query(f"WITH c AS ({_CHECKS}) SELECT id, CASE WHEN status = 'passed' AND (SELECT bool_or(status = 'needs_input') FROM c) THEN 'needs_input' ELSE status END AS status FROM c")
def status_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.demote(select(spark, sf_dir, _CHECKS))


_DIMENSIONS = ["arithmetic", "code", "evidence", "indices", "quantity", "resources", "unit"]
_FULL = "SELECT doc_id AS row_id, CASE WHEN doc_id % 5 = 0 THEN 'limited' WHEN doc_id % 7 = 0 THEN 'needs_input' ELSE 'passed' END AS arithmetic, doc_id % 11 = 0 AS fields_open FROM documents"


@query(f"""
WITH r AS ({_FULL}), l AS (SELECT doc_id, any_value(quality) AS quality FROM labels GROUP BY doc_id), j AS (SELECT r.*, l.quality FROM r LEFT JOIN l ON l.doc_id = r.row_id),
s AS (SELECT row_id, arithmetic IN ('passed', 'finding') AS checked, arithmetic, fields_open, CASE WHEN quality = 1 THEN '' WHEN quality = 0 THEN 'unit' ELSE '{",".join(_DIMENSIONS)}' END AS gone FROM j)
SELECT row_id, CASE WHEN checked AND NOT fields_open AND gone = '' THEN 'passed' WHEN NOT checked OR fields_open THEN CASE WHEN arithmetic = 'limited' AND NOT fields_open THEN 'limited' ELSE 'needs_input' END ELSE 'limited' END AS status,
  CASE WHEN checked AND NOT fields_open THEN gone ELSE concat_ws(',', CASE WHEN NOT checked THEN 'arithmetic' END, CASE WHEN fields_open THEN 'fields' END) END AS lacking FROM s""")
def full_row_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = select(spark, sf_dir, "SELECT doc_id AS row_id, max(quality) AS quality FROM labels GROUP BY doc_id")
    done = F.when(F.col("quality") == 1, F.array(*map(F.lit, _DIMENSIONS))).otherwise(F.array(*[F.lit(d) for d in _DIMENSIONS if d != "unit"]))
    return rollup.full_rows(select(spark, sf_dir, _FULL), told.select("row_id", done.alias("completed")), _DIMENSIONS)


@query(f"""
WITH a AS ({_ARITH}) SELECT count(*) AS extracted, count(DISTINCT row_id) AS checkable, count(DISTINCT CASE WHEN status IN ('passed', 'finding') THEN row_id END) AS checked, count(DISTINCT CASE WHEN status = 'needs_input' THEN row_id END) AS open FROM a""")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.coverage(arith_rows(spark, sf_dir).select("row_id", "status"))


@query("SELECT id, severity, ord FROM v_findings ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'material' THEN 1 ELSE 2 END, id, ord LIMIT 1000")
def findings_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.top_findings(select(spark, sf_dir, "SELECT * FROM v_findings"), 1000)


@query("""
WITH r AS (SELECT id, ord, row_number() OVER (PARTITION BY id ORDER BY ord) AS r FROM v_findings)
SELECT id, array_to_string(list(ord ORDER BY ord) FILTER (WHERE r <= 20), ',') AS kept, count(*) AS total, (count(*) - least(count(*), 20))::BIGINT AS omitted FROM r GROUP BY id""")
def bounded_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.bounded(select(spark, sf_dir, "SELECT id, ord FROM v_findings"), "id", [], "ord", 20)


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text)::BIGINT AS size_bytes, 'xml' AS extension FROM documents")
def inventory_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = select(spark, sf_dir, "SELECT doc_id, text FROM documents")
    return docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"), F.lit("xml").alias("extension"))


_FILES = "SELECT page_id, concat('f', page_id, CASE page_id % 8 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.XLSM' WHEN 2 THEN '.xls' WHEN 3 THEN '.pdf' WHEN 4 THEN '.gge' WHEN 5 THEN '.zip' WHEN 6 THEN '.docx' ELSE '' END) AS path FROM pages"


@query(f"""WITH f AS ({_FILES}), e AS (SELECT page_id, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS x FROM f)
SELECT page_id, CASE WHEN x IN ('xlsx', 'xlsm') THEN 'ooxml' WHEN x = 'xls' THEN 'xls' WHEN x = 'pdf' THEN 'pdf' WHEN x IN ('xml', 'gge', 'mge') THEN 'xml' WHEN x = 'zip' THEN 'zip' ELSE 'unsupported_or_not_yet_extracted' END AS reader FROM e""")
def dispatch_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.sources.inventory import reader

    return select(spark, sf_dir, _FILES).select("page_id", reader(F.col("path")).alias("reader"))


@query("SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS used, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) <= 50000 AS accepted FROM documents")
def archive_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.running_budget(select(spark, sf_dir, "SELECT doc_id, source, n_chars FROM documents"), "source", ["doc_id"], "n_chars", 50_000)
    return out.select("doc_id", "source", F.col("used").cast("long").alias("used"), "accepted")


@query("""
WITH RECURSIVE o AS (SELECT conv_id, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS i FROM conversations),
r(conv_id, i, used, accepted) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM o
  UNION ALL SELECT o.conv_id, o.i, CASE WHEN r.used + o.size <= 1500 THEN r.used + o.size ELSE r.used END, r.accepted + CASE WHEN r.used + o.size <= 1500 THEN 1 ELSE 0 END FROM r JOIN o ON o.conv_id = r.conv_id AND o.i = r.i + 1)
SELECT conv_id, arg_max(accepted, i) AS accepted, arg_max(used, i) AS used, max(i) AS n FROM r GROUP BY conv_id""")
def page_budget_nonmonotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.page_budget(select(spark, sf_dir, "SELECT conv_id, turn, length(text) AS size FROM conversations"), "conv_id", "turn", "size", 1500)


_NUMBERS = "SELECT event_id, CASE event_id % 9 WHEN 0 THEN cast(event_id AS string) WHEN 1 THEN concat(' ', event_id % 100, ',5 ') WHEN 2 THEN '1 234,50' WHEN 3 THEN 'n/a' WHEN 4 THEN '' WHEN 5 THEN '1,234.5' WHEN 6 THEN '-0.007' WHEN 7 THEN '12_000' ELSE NULL END AS raw FROM events"


@query(f"""
WITH n AS ({_NUMBERS}), c AS (SELECT *, replace(replace(raw, ' ', ''), ',', '.') AS p FROM n)
SELECT event_id, CASE WHEN regexp_full_match(p, '[+-]?[0-9]+(_[0-9]+)*(\\.[0-9]+)?') THEN replace(p, '_', '')::DECIMAL(18,4) END AS value, coalesce(regexp_full_match(raw, '[+-]?(([0-9]{{1,3}}( [0-9]{{3}})+)|[0-9]+)([.,][0-9]+)?'), false) AS written FROM c""")
def decimal_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, sf_dir, _NUMBERS).select("event_id", decimals.parse(F.col("raw"), 18, 4).alias("value"), decimals.written(F.col("raw")).alias("written"))


_HEADS = "SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN ' Наименование:' WHEN 1 THEN 'ОБЪЁМ' WHEN 2 THEN 'Ед.  изм.' WHEN 3 THEN 'Всего' WHEN 4 THEN 'итого;' WHEN 5 THEN 'расценка' WHEN 6 THEN 'Unit Price' WHEN 7 THEN ':qty:' WHEN 8 THEN p_type ELSE 'Код' END AS head FROM part"


def _alias_sql(table: dict[str, list[str]], c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} IN ({', '.join(repr(a) for a in names)}) THEN '{f}'" for f, names in table.items()) + " END"


@query(f"""
WITH h AS ({_HEADS}), k AS (SELECT p_partkey, regexp_replace(lower(trim(head)), '\\s+', ' ', 'g') AS c FROM h)
SELECT p_partkey, {_alias_sql(text.RECORD_HEADERS, "c")} AS record_field, {_alias_sql(text.SHEET_HEADERS, "trim(replace(c, 'ё', 'е'), ': ')")} AS sheet_field, {_alias_sql(text.SCAN_HEADERS, "trim(c, ':; ')")} AS scan_field FROM k""")
def header_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("head")
    return select(spark, sf_dir, _HEADS).select(
        "p_partkey", text.lookup(text.RECORD_HEADERS, text.collapsed(h)).alias("record_field"), text.lookup(text.SHEET_HEADERS, text.sheet_header(h)).alias("sheet_field"), text.lookup(text.SCAN_HEADERS, text.scan_header(h)).alias("scan_field")
    )


@query("""
SELECT event_id, (event_id % 16000 + 1)::BIGINT AS col, (event_id % 16000 + 1)::BIGINT AS back, 'A1:C' || (event_id % 50 + 2) AS spread FROM events""")
def cell_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = select(spark, sf_dir, "SELECT event_id, event_id % 16000 + 1 AS col, event_id % 50 + 2 AS row FROM events")
    refs = F.array(F.concat(F.lit("$C$"), F.col("row")), F.lit("a1"), F.lit("$B1"), F.lit("no cell"))
    return ev.select("event_id", "col", coords.column_number(coords.column_letters(F.col("col"))).cast("long").alias("back"), coords.cell_range(refs).alias("spread"))


@query("""
WITH c AS (SELECT DISTINCT event_type AS sheet, event_id AS row FROM events WHERE event_id % 7 <> 0), r AS (SELECT *, row - row_number() OVER (PARTITION BY sheet ORDER BY row) AS g FROM c)
SELECT sheet, min(row) AS first, max(row) AS last, count(*) AS n FROM r GROUP BY sheet, g""")
def table_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.islands(select(spark, sf_dir, "SELECT event_type AS sheet, event_id AS row FROM events WHERE event_id % 7 <> 0"))


_CELLS = "SELECT cast(l_orderkey % 500 AS string) AS sheet, l_orderkey AS row, CASE l_suppkey % 6 WHEN 0 THEN 'name' WHEN 1 THEN 'unit' WHEN 2 THEN 'quantity' WHEN 3 THEN 'unit_price' WHEN 4 THEN 'code' END AS field FROM lineitem"


@query(f"""
WITH c AS ({_CELLS}), p AS (SELECT sheet, row, count(DISTINCT field) AS n, bool_or(field IN ('quantity', 'unit_price')) AS a FROM c WHERE field IS NOT NULL GROUP BY sheet, row)
SELECT sheet, min(row) AS row, arg_min(n, row) AS fields FROM p WHERE n >= 3 AND a GROUP BY sheet""")
def header_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.header_rows(select(spark, sf_dir, _CELLS), ["quantity", "unit_price", "amount"])


@query("""
WITH l AS (SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS under, role FROM conversations)
SELECT conv_id, turn, under FROM l WHERE under IS NOT NULL AND role <> 'user'""")
def header_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = select(spark, sf_dir, "SELECT conv_id, turn, role = 'user' AS head FROM conversations")
    return tables.bodies(lines, "conv_id", "turn", "head").select("conv_id", "turn", "under")


_SHEETS = """
SELECT cast(l_orderkey AS string) AS sheet, concat('B', l_linenumber) AS ref, cast(min(cast(l_quantity AS decimal(12,2))) AS string) AS value, cast(NULL AS string) AS formula FROM lineitem GROUP BY l_orderkey, l_linenumber
UNION ALL SELECT cast(l_orderkey AS string), 'C1', NULL, concat('=SUM(B', min(l_linenumber), ':$B$', max(l_linenumber), ')') FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT cast(o_orderkey AS string), 'C2', NULL, CASE WHEN o_orderkey % 3 = 0 THEN '=C3' WHEN o_orderkey % 3 = 1 THEN '=ROUND(-(1+2)*2.5/3, 0)+MAX(1,2)' ELSE '=Z9*2' END FROM orders
UNION ALL SELECT cast(o_orderkey AS string), 'C3', NULL, '=C2' FROM orders"""


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, min(l_quantity::DECIMAL(12,2)) AS q FROM lineitem GROUP BY ALL), s AS (SELECT l_orderkey AS k, sum(q) AS total, count(*) = max(l_linenumber) - min(l_linenumber) + 1 AS whole FROM b GROUP BY l_orderkey)
SELECT k::VARCHAR AS sheet, 'C1' AS ref, CASE WHEN whole THEN total::DECIMAL(18,2) END AS value, CASE WHEN NOT whole THEN 'unsupported_formula' END AS error FROM s
UNION ALL SELECT o_orderkey::VARCHAR, r, CASE WHEN o_orderkey % 3 = 1 THEN (-1)::DECIMAL(18,2) END, CASE o_orderkey % 3 WHEN 0 THEN 'formula_cycle' WHEN 2 THEN 'unsupported_formula' END FROM orders, (VALUES ('C2'), ('C3')) v(r)""")
def formula_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formulas.evaluate(select(spark, sf_dir, _SHEETS)).withColumn("value", F.col("value").cast("decimal(18,2)"))


@query("""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'quantity * unit_price' WHEN 1 THEN 'quantity * unit_price * index * coefficient' WHEN 2 THEN 'quantity * unit_price * coefficient' END AS basis FROM events""")
def basis_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = select(spark, sf_dir, "SELECT event_id, event_id AS row, CASE event_id % 6 WHEN 0 THEN concat('=D', event_id, '*E', event_id) WHEN 1 THEN concat('=$E', event_id, ' * D', event_id, '*G', event_id, '*F', event_id) WHEN 2 THEN concat('=d', event_id, '*g', event_id, '*e', event_id) WHEN 3 THEN concat('=D', event_id, '*E', event_id + 1) WHEN 4 THEN concat('=D', event_id, '*D', event_id) ELSE concat('=D', event_id, '+E', event_id) END AS formula FROM events")
    fields = F.create_map(*[F.lit(x) for kv in {"D": "quantity", "E": "unit_price", "F": "index", "G": "coefficient"}.items() for x in kv])
    return formulas.product_basis(made.withColumn("fields", fields)).select("event_id", "basis")


_RELIABLE = 'conf >= 60 AND "left" >= 0 AND "left" + width <= image_width AND top >= 0 AND top + height <= image_height'


@query(f"""
SELECT page::BIGINT AS page, count(*) AS n, count_if({_RELIABLE})::BIGINT AS reliable, sum(conf)::BIGINT AS conf FROM v_words GROUP BY page""")
def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tables.ocr_words(select(spark, sf_dir, "SELECT * FROM v_words"))
    return words.groupBy("page").agg(F.count("*").alias("n"), F.count_if("reliable").alias("reliable"), F.sum("conf").cast("long").alias("conf"))


@query(f"""
SELECT page, block, par, line, string_agg(text, ' ' ORDER BY "left", word_num, text) AS text, min("left") AS x0, max("left" + width) AS x1, min(conf) AS least_conf, count(*) AS n FROM v_words WHERE {_RELIABLE} GROUP BY page, block, par, line""")
def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tables.ocr_words(select(spark, sf_dir, "SELECT * FROM v_words"))
    return tables.ocr_lines(words).select("page", "block", "par", "line", "text", "x0", "x1", "least_conf", "n")


@query("""
SELECT page, row_number() OVER (PARTITION BY page ORDER BY block, line) AS line_no, count(*) AS n FROM v_words GROUP BY page, block, line""")
def text_lines_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = select(spark, sf_dir, 'SELECT page, cast(top + (word_num % 3) * 0.9 AS double) AS top, cast(word_num AS double) AS x0, text FROM v_words')
    return tables.text_lines(words).select("page", "line_no", "n")


_COLUMNS = "SELECT page_id AS page, 1 AS \"table\", f.field, f.center, 700 AS image_width FROM pages p CROSS JOIN (SELECT 'name' AS field, 50.0 AS center UNION ALL SELECT 'unit', 200.0 UNION ALL SELECT 'quantity', 320.0 UNION ALL SELECT 'unit_price', 480.0 UNION ALL SELECT 'declared_total', 650.0) f"
_CENTERS = 'SELECT page, 1 AS "table", line, block, word_num, "left" + width / 2.0 AS center, conf FROM v_words'
_HELD = "CASE WHEN center < 0 OR center > 700 THEN NULL WHEN center < 125 THEN 'name' WHEN center < 260 THEN 'unit' WHEN center < 400 THEN 'quantity' WHEN center < 565 THEN 'unit_price' ELSE 'declared_total' END"


@query(f"WITH c AS ({_CENTERS}), h AS (SELECT *, {_HELD} AS field FROM c) SELECT page, field, count(*) AS n FROM h WHERE field IS NOT NULL AND page IN (SELECT page_id FROM pages) GROUP BY page, field")
def ocr_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = tables.column_bounds(select(spark, sf_dir, _COLUMNS))
    return tables.assign_columns(select(spark, sf_dir, _CENTERS), bounds).groupBy("page", "field").agg(F.count("*").alias("n"))


@query("""
SELECT conv_id % 50 AS page, 1 AS "table", conv_id * 10 + turn AS line, 5::BIGINT AS fields FROM conversations WHERE conv_id % 3 = 0 AND conv_id % 2 = 0""")
def ocr_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = ["name", "unit", "quantity", "unit_price", "declared_total"]
    lines = select(spark, sf_dir, 'SELECT conv_id % 50 AS page, 1 AS "table", conv_id * 10 + turn AS line, conv_id FROM conversations')
    cells = lines.select("*", F.explode(F.array(*map(F.lit, [*required, "name"]))).alias("field"), F.monotonically_increasing_id().alias("k"))
    cells = cells.withColumn("conf", F.when(F.col("conv_id") % 3 == 0, 95).otherwise(80))
    once = cells.groupBy("page", "table", "line", "field", "conf", "conv_id").agg(F.count("*").alias("times"))
    kept = once.select("*", F.explode(F.sequence(F.lit(1), F.when((F.col("field") == "name") & (F.col("conv_id") % 2 == 1), 2).otherwise(1))).alias("i"))
    return tables.row_candidates(kept, required)


@query("""
WITH c AS (SELECT source AS source_path, doc_id % 300 AS candidate_id, count(*) AS copies, min(n_chars) AS total FROM documents GROUP BY ALL),
a AS (SELECT d.source AS source_path, d.doc_id % 300 AS candidate_id, count(*) AS n, min(CASE WHEN l.quality = 1 THEN d.n_chars ELSE 0 END) AS total FROM labels l JOIN documents d USING (doc_id) GROUP BY ALL)
SELECT c.source_path, c.candidate_id, CASE WHEN copies > 1 THEN 'duplicate_candidate' WHEN n IS NULL THEN 'attestation_required' WHEN n > 1 THEN 'duplicate_attestation' WHEN a.total = c.total THEN 'promoted' ELSE 'mismatch' END AS outcome FROM c LEFT JOIN a USING (source_path, candidate_id)""")
def ocr_attestation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = select(spark, sf_dir, "SELECT source AS source_path, doc_id % 300 AS candidate_id, n_chars AS total FROM documents")
    told = select(spark, sf_dir, "SELECT d.source AS source_path, d.doc_id % 300 AS candidate_id, CASE WHEN l.quality = 1 THEN d.n_chars ELSE 0 END AS total FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
    return tables.attested(found, told, ["total"])


_WANTED = "SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 2 THEN concat('A', p_partkey - 1) WHEN p_partkey % 10 = 3 THEN concat('X', p_partkey) ELSE concat('A', p_partkey) END AS target, CASE WHEN p_partkey % 10 = 6 THEN 'disputed' ELSE 'confirmed' END AS status, CASE WHEN p_partkey % 10 = 4 THEN 'old' ELSE p_brand END AS expected_old, CASE WHEN p_partkey % 10 = 5 THEN ' =1+1' ELSE 'new' END AS replacement FROM part"


@query(f"""
WITH w AS ({_WANTED}), c AS (SELECT concat('A', p_partkey) AS target, p_brand AS value FROM part), n AS (SELECT target, count(*) AS n FROM w GROUP BY target)
SELECT id, CASE WHEN n.n > 1 THEN 'duplicate_target' WHEN c.target IS NULL THEN 'target_not_found' WHEN c.value <> expected_old THEN 'stale' WHEN replacement LIKE ' =%' THEN 'active_content' WHEN status = 'disputed' THEN 'comment' ELSE 'replace' END AS outcome FROM w JOIN n USING (target) LEFT JOIN c ON c.target = w.target""")
def corrections_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.corrections(select(spark, sf_dir, _WANTED), select(spark, sf_dir, "SELECT concat('A', p_partkey) AS target, p_brand AS value FROM part"))


_XML = """SELECT o_orderkey, concat('<Order id="', o_orderkey, '"><Date>', date_format(o_orderdate, 'yyyy-MM-dd'), '</Date><Status>', o_orderstatus, '</Status><Items>', concat_ws('', collect_list(concat('<Item num="', l_linenumber, '"><Qty>', cast(l_quantity AS int), '</Qty><Price>', cast(l_extendedprice AS decimal(12,2)), '</Price></Item>'))), '</Items></Order>') AS content
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate, o_orderstatus"""


def _xml(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...]) -> DataFrame:
    from ledgerlens.sources import xml

    return xml.values(select(spark, sf_dir, _XML).select(F.col("o_orderkey").cast("string").alias("path"), "content"), kinds)


@query("""
WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey), k AS (SELECT o_orderkey, n FROM orders JOIN n ON l_orderkey = o_orderkey)
SELECT '/Order/@id' AS xpath, 'text' AS type, count(*) AS n FROM k UNION ALL SELECT '/Order/Date', 'date', count(*) FROM k UNION ALL SELECT '/Order/Status', 'text', count(*) FROM k
UNION ALL SELECT '/Order/Items/Item/@num', 'integer', sum(n)::BIGINT FROM k UNION ALL SELECT '/Order/Items/Item/Qty', 'integer', sum(n)::BIGINT FROM k UNION ALL SELECT '/Order/Items/Item/Price', 'decimal', sum(n)::BIGINT FROM k""")
def xml_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.sources import xml

    found = _xml(spark, sf_dir, ("text", "attribute"))
    return found.groupBy(coords.plain_xpath(F.col("xpath")).alias("xpath"), xml.typed(F.col("local_name"), F.col("raw_value")).alias("type")).agg(F.count("*").alias("n"))


@query("""
SELECT 'item' AS rule, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'order', count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def xml_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.sources import xml

    rules = spark.createDataFrame([("item", "order.v1", "/Order/Items/Item"), ("order", "order.v1", "/[A-Za-z]+"), ("other", "order.v2", ".*")], "rule string, schema_id string, pattern string")
    return xml.anchors(_xml(spark, sf_dir, ("element",)).withColumn("schema_id", F.lit("order.v1")), rules).groupBy("rule").agg(F.count("*").alias("n"))


@query("""
SELECT l_orderkey::VARCHAR AS source_path, 'quantity' AS field, sum(l_quantity::INT)::DECIMAL(20,2) AS total, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey
UNION ALL SELECT l_orderkey::VARCHAR, 'unit_price', sum(l_extendedprice::DECIMAL(12,2))::DECIMAL(20,2), count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey""")
def xml_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.sources import xml

    found = _xml(spark, sf_dir, ("text", "attribute")).withColumn("schema_id", F.lit("order.v1"))
    rules = spark.createDataFrame([("item", "order.v1", "/Order/Items/Item")], "rule string, schema_id string, pattern string")
    mapping = spark.createDataFrame([("item", "Qty", "quantity", 1, "first"), ("item", "Amount", "quantity", 2, "first"), ("item", "Price", "unit_price", 1, "unique")], "rule string, local_name string, field string, ordinal int, mode string")
    got = xml.mapped(xml.owned_fields(found, rules), mapping)
    return got.groupBy("source_path", "field").agg(F.sum(F.col("value").cast("decimal(12,2)")).cast("decimal(20,2)").alias("total"), F.count("*").alias("n"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'minstroy.local_estimate.v1' WHEN 1 THEN 'minstroy.object_or_summary_estimate.v1' END AS schema_id, CASE p_partkey % 4 WHEN 0 THEN 'LSR' WHEN 1 THEN 'SSR' END AS document_type FROM part WHERE p_partkey % 4 < 2 AND p_partkey % 3 <> 2""")
def schema_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.sources import xml

    roots = select(spark, sf_dir, "SELECT p_partkey AS path, CASE p_partkey % 4 WHEN 0 THEN 'Construction' WHEN 1 THEN 'Summary' ELSE 'Other' END AS root, cast(NULL AS string) AS namespace, CASE p_partkey % 3 WHEN 0 THEN 'xml' WHEN 1 THEN 'gge' ELSE 'txt' END AS extension FROM part")
    registry = spark.createDataFrame([("minstroy.local_estimate.v1", "Construction", None, ["xml", "gge"]), ("minstroy.object_or_summary_estimate.v1", "Summary", None, ["xml", "gge"]), ("minstroy.market_analysis.v1", "Summary", "urn:x", ["xml"])], "schema_id string, root string, namespace string, extensions array<string>")
    return xml.matching_schemas(roots, registry).select(F.col("path").alias("p_partkey"), "schema_id", xml.document_type(F.col("schema_id")).alias("document_type"))


@query("""
SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'date' WHEN 1 THEN 'text' WHEN 2 THEN 'integer' WHEN 3 THEN 'decimal' WHEN 4 THEN 'text' WHEN 5 THEN 'datetime' WHEN 6 THEN 'text' ELSE 'text' END AS type FROM events""")
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.sources import xml

    tokens = select(spark, sf_dir, "SELECT event_id, CASE WHEN event_id % 8 = 4 THEN 'SourceCode' ELSE 'Value' END AS name, CASE event_id % 8 WHEN 0 THEN '2026-02-28' WHEN 1 THEN '2026-02-30' WHEN 2 THEN cast(event_id AS string) WHEN 3 THEN '-12.50' WHEN 4 THEN '17' WHEN 5 THEN '2026-02-28T10:00:00' WHEN 6 THEN '007' ELSE '1234567890123456' END AS raw FROM events")
    return tokens.select("event_id", xml.typed(F.col("name"), F.col("raw")).alias("type"))


_PATHS = "SELECT page_id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN concat('A/É', page_id, chr(92), 'b') WHEN 2 THEN '../x' WHEN 3 THEN 'C:/x' WHEN 4 THEN 'C:x//y' WHEN 5 THEN './a/./b/' WHEN 6 THEN concat('/r', page_id) ELSE './' END AS path FROM pages"


@query(f"""
WITH p AS ({_PATHS}), s AS (SELECT page_id, replace(path, chr(92), '/') AS path FROM p), c AS (SELECT page_id, path, [x FOR x IN string_split(path, '/') IF x <> '' AND x <> '.'] AS parts FROM s),
n AS (SELECT page_id, CASE WHEN path NOT LIKE '/%' AND NOT regexp_matches(path, '^[A-Za-z]:/') AND len(parts) > 0 AND NOT list_contains(parts, '..') THEN array_to_string(parts, '/') END AS name FROM c)
SELECT page_id, name, lower(nfc_normalize(name)) AS "key" FROM n""")
def path_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.sources.packages import collision_key, member_name

    @F.pandas_udf("name string, key string")
    def run(paths: pd.Series) -> pd.DataFrame:
        names = [member_name(p) for p in paths]
        return pd.DataFrame({"name": names, "key": [None if n is None else collision_key(n) for n in names]})

    return select(spark, sf_dir, _PATHS).select("page_id", run("path").alias("n")).select("page_id", "n.name", "n.key")


_PAGE = "SELECT event_id, 200.0D + event_id % 3000 AS width, 100.0D + (event_id * 7) % 9000 AS height, event_id % 4 * 90 AS rotation, CASE WHEN event_id % 10 = 0 THEN 0 ELSE 1000000 * (event_id % 40) END AS pixels_left, event_id % 8 AS words, event_id % 60 AS characters, cast(event_id % 1000 AS double) AS edge FROM events"


@query(f"""
WITH p AS ({_PAGE.replace("0D", "0::DOUBLE")}), t AS (SELECT *, CASE WHEN rotation % 180 <> 0 THEN height ELSE width END AS w, CASE WHEN rotation % 180 <> 0 THEN width ELSE height END AS h FROM p),
d AS (SELECT event_id, max(d.d) AS dpi FROM t, (SELECT unnest(range(72, 201)) AS d) d WHERE pixels_left > 0 AND ceil(w * d / 72.0) <= 10000 AND ceil(h * d / 72.0) <= 10000 AND ceil(w * d / 72.0)::BIGINT * ceil(h * d / 72.0)::BIGINT <= least(25000000, pixels_left) GROUP BY event_id)
SELECT t.event_id, d.dpi::INT AS dpi, (words <= 4 OR characters <= 24) AND least(1.0, greatest(0.0, least(width, edge * 2) - edge) * greatest(0.0, least(height, 5000.0) - 0.0) / greatest(width * height, 1.0)) >= 0.25 AS recognise FROM t LEFT JOIN d USING (event_id)""")
def render_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.functions import pages

    p = select(spark, sf_dir, _PAGE)
    c = F.col
    images = F.array(F.struct((c("edge") * 2).alias("x0"), c("edge").alias("x1"), F.lit(-1.0).alias("top"), F.lit(5000.0).alias("bottom")))
    coverage = pages.image_coverage(c("width"), c("height"), images)
    return p.select("event_id", pages.render_dpi(c("width"), c("height"), c("rotation"), c("pixels_left")).alias("dpi"), pages.needs_recognition(c("words"), c("characters"), coverage).alias("recognise"))


@query("SELECT page_id, array_to_string([x FOR x IN list_transform(string_split_regex(html, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]'), lambda y: regexp_replace(y, '^[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]+|[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]+$', '', 'g')) IF x <> ''], chr(10)) AS text FROM pages")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.functions import pages

    return select(spark, sf_dir, "SELECT page_id, html FROM pages").select("page_id", pages.page_text(F.col("html")).alias("text"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 'f' || o_orderkey || '.xml:s.v1:/a/b[' || o_orderkey || ']' END AS logical_id FROM orders""")
def logical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = select(spark, sf_dir, "SELECT o_orderkey, concat('f', o_orderkey, '.xml') AS source_path, 's.v1' AS schema_id, CASE WHEN o_orderkey % 5 = 0 THEN 'a' ELSE concat('/a/b[', o_orderkey, ']') END AS xpath FROM orders")
    return rows_.select("o_orderkey", coords.logical_id(F.col("source_path"), F.col("schema_id"), F.col("xpath")).alias("logical_id"))


_RECORDS = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ' Estimate_Row ' WHEN 1 THEN 'row' WHEN 2 THEN 'KAC' WHEN 3 THEN 'total' WHEN 4 THEN 'nothing' END AS entity, p_name AS name, cast(p_size AS string) AS size, CASE WHEN p_partkey % 5 = 0 THEN 'partial' END AS reliability FROM part"


@query(f"""
WITH r AS ({_RECORDS}), w AS (SELECT *, CASE lower(trim(entity)) WHEN 'estimate_row' THEN 'rows' WHEN 'row' THEN 'rows' WHEN 'kac' THEN 'kacs' WHEN 'total' THEN 'totals' END AS collection FROM r)
SELECT collection, p_partkey::VARCHAR AS id, CASE WHEN collection = 'rows' AND p_partkey % 4 = 0 THEN 'own' WHEN collection = 'rows' THEN size WHEN collection = 'totals' AND p_partkey % 4 = 0 THEN 'own' END AS total, coalesce(reliability, 'reliable') AS reliability FROM w WHERE collection IS NOT NULL
UNION ALL SELECT 'indices', p_partkey || ':index', size, coalesce(reliability, 'reliable') FROM w WHERE collection = 'rows' AND p_partkey % 3 = 0""")
def canonical_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.functions.evidence import FIELDS
    from ledgerlens.sources import canonical

    made = select(spark, sf_dir, _RECORDS)
    key = F.col("p_partkey").cast("string")
    fields = F.map_concat(
        F.create_map(F.lit("row_id"), key, F.lit("kac_id"), key, F.lit("total_id"), key, F.lit("amount"), F.col("size")), F.when(F.col("p_partkey") % 4 == 0, F.create_map(F.lit("declared_total"), F.lit("own"))).otherwise(F.create_map().cast("map<string,string>")),
        F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("index"), F.col("size"))).otherwise(F.create_map().cast("map<string,string>")),
    )
    place = canonical.evidence({}, F.lit("s"), key)
    model = canonical.routed(made.select("entity", fields.alias("fields"), "reliability", *[place[n].alias(n) for n in FIELDS]))
    parts = [("rows", "row_id", "declared_total"), ("kacs", "kac_id", None), ("totals", "total_id", "declared_total"), ("indices", "index_id", "value")]
    out = [model[n].select(F.lit(n).alias("collection"), F.col(i).alias("id"), (F.col(t) if t else F.lit(None)).cast("string").alias("total"), "reliability") for n, i, t in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


_LINES = "SELECT l_orderkey AS k, l_linenumber AS n, cast(cast(min(l_quantity) AS int) AS string) AS quantity, min(p_name) AS name FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey, l_linenumber"


@query(f"""
WITH l AS ({_LINES}), r AS (SELECT *, n - row_number() OVER (PARTITION BY k ORDER BY n) AS gap FROM l), b AS (SELECT k, min(n) AS blank FROM r WHERE gap = 0 AND k % 4 = 1 AND n % 5 = 3 GROUP BY k)
SELECT r.k::VARCHAR AS sheet, r.n::BIGINT AS line, name, quantity, CASE WHEN n % 2 = 0 THEN 'quantity * unit_price' END AS basis FROM r LEFT JOIN b USING (k) WHERE gap = 0 AND (blank IS NULL OR n < blank)""")
def sheet_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.sources import canonical

    heads = [("Наименование", 2), ("Кол-во", 9), ("Количество", 3), ("Unit price", 4), ("Сумма:", 5)]
    lines = select(spark, sf_dir, _LINES)
    blank = (F.col("k") % 4 == 1) & (F.col("n") % 5 == 3)
    cell = lambda c, value, formula=None: F.struct((F.col("n") + 1).cast("int").alias("row"), F.lit(c).alias("col"), value.cast("string").alias("value"), (formula if formula is not None else F.lit(None)).cast("string").alias("formula"))
    amount = F.when(F.col("n") % 2 == 0, F.concat(F.lit("=C"), F.col("n") + 1, F.lit("*$D$"), F.col("n") + 1))
    full = F.array(cell(2, F.when(~blank, F.col("name"))), cell(3, F.when(~blank, F.col("quantity"))), cell(4, F.when(~blank, F.lit("7"))), cell(5, F.when(~blank, F.lit("1")), F.when(~blank, amount)), cell(8, F.lit("note")))
    body = lines.select(F.col("k").cast("string").alias("sheet"), F.explode(full).alias("c")).select("sheet", "c.*").where("value IS NOT NULL OR formula IS NOT NULL")
    top = lines.select(F.col("k").cast("string").alias("sheet")).distinct().select("sheet", F.explode(F.array(*[F.struct(F.lit(1).alias("row"), F.lit(c).alias("col"), F.lit(h).alias("value"), F.lit(None).cast("string").alias("formula")) for h, c in heads])).alias("c")).select("sheet", "c.*")
    cells = top.unionByName(body).select(F.lit("b.xlsx").alias("path"), "sheet", F.concat(coords.column_letters(F.col("col").cast("long")), "row").alias("ref"), "row", "col", F.lit("text").alias("kind"), "value", "formula")
    got = canonical.sheet_rows(cells)
    return got.select("sheet", (F.col("row") - 1).cast("long").alias("line"), F.col("fields")["name"].alias("name"), F.col("fields")["quantity"].alias("quantity"), F.col("basis.formula").alias("basis"))


_SCAN = "SELECT s_suppkey AS k, s_name AS name, cast(s_nationkey AS string) AS land, s_suppkey % 7 = 0 AS spoilt, s_suppkey % 5 = 0 AS unsure, s_suppkey % 11 = 0 AS twice FROM supplier"


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recognised page for each supplier: a header line, and a row that may be spoilt, or unsure."""
    made = select(spark, sf_dir, _SCAN)
    line = lambda n, i, x, conf, word: F.concat_ws("\t", F.lit(f"5\t1\t1\t1\t{n}\t{i}\t{x}\t{n * 20}\t40\t10"), conf, word)
    sure, at = F.lit("97.5"), [10, 90, 170, 250, 330]
    heads = [line(1, i, x, sure, F.lit(h)) for i, (x, h) in enumerate(zip(at, ["Name", "Unit", "Quantity", "Price", "Total"], strict=True))]
    row = [line(2, 0, 10, sure, F.replace("name", F.lit(" "), F.lit("_"))), line(2, 1, 90, F.when(F.col("unsure"), "61").otherwise("95"), F.lit("pcs")), line(2, 2, 170, sure, F.when(F.col("spoilt"), "n/a").otherwise(F.col("land"))), line(2, 3, 250, sure, F.lit("1,5")), line(2, 4, 330, sure, F.lit("10 000"))]
    more = [line(3, i, 600 if i % 2 else 20, F.lit("99") if i % 3 else F.lit("12"), F.lit("fill")) for i in range(16)]
    again = F.when(F.col("twice"), line(1, 9, 360, sure, F.lit("Price")))
    text_ = F.concat_ws("\n", F.lit("header"), *heads, again, *row, *more)
    return made.select(F.concat(F.lit("p"), "k").alias("source_path"), F.lit(1).alias("page"), text_.alias("tsv"), F.lit(400).alias("image_width"), F.lit(100).alias("image_height"), F.lit(0).alias("rotation"))


@query(f"""
WITH s AS ({_SCAN}) SELECT 'p' || k AS source_path, r.reason, (CASE r.reason WHEN 'reliable' THEN 10 + 5 + CASE WHEN twice THEN 1 ELSE 0 END WHEN 'invalid_bbox' THEN 8 ELSE 3 END)::BIGINT AS n FROM s, (VALUES ('reliable'), ('invalid_bbox'), ('low_confidence')) r(reason)""")
def recognised_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.sources import recognition

    found = recognition.words(_scanned(spark, sf_dir))
    return found.groupBy("source_path", F.coalesce("reason", F.lit("reliable")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""
WITH s AS ({_SCAN}) SELECT 'p' || k AS source_path, 'page:1:ocr-table:1:row:1' AS candidate_id, replace(name, ' ', '_') AS name, land AS quantity, CASE WHEN k % 3 = 0 THEN 'geometry' END AS fault FROM s WHERE NOT spoilt AND NOT unsure AND NOT twice""")
def recognised_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.sources import recognition

    found = recognition.candidates(recognition.words(_scanned(spark, sf_dir)))
    moved = F.when(F.substring("source_path", 2, 20).cast("long") % 3 == 0, F.array(*map(F.lit, [5, 40, 370, 50]))).otherwise(F.col("bbox"))
    return recognition.validated(found.withColumn("bbox", moved)).select("source_path", "candidate_id", F.col("fields")["name"].alias("name"), F.col("fields")["quantity"].alias("quantity"), "fault")


@query("""
SELECT event_id, 's' || event_id AS source_path, CASE event_id % 4 WHEN 0 THEN 'own' WHEN 1 THEN 'xpath:/a/b;line:' || event_id WHEN 2 THEN 'page:' || event_id ELSE 'unresolved-evidence' END AS locator FROM events""")
def limitation_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.sources import canonical

    notes = select(spark, sf_dir, "SELECT event_id, concat('s', event_id) AS source_path, CASE event_id % 4 WHEN 0 THEN 'own' WHEN 1 THEN '' END AS locator, CASE WHEN event_id % 4 = 1 THEN '/a/b' END AS xpath, event_id AS line, CASE WHEN event_id % 4 = 2 THEN event_id END AS page FROM events")
    return canonical.located(notes).select("event_id", "source_path", "locator")


@query("""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'f' || page_id || '.xml' WHEN 1 THEN 'sub/a.zip!/' || page_id || '/x.xml' ELSE page_id || '.pdf' END AS shown FROM pages""")
def display_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.sources import canonical

    paths = select(spark, sf_dir, "SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('file:/root/in/f', page_id, '.xml') WHEN 1 THEN concat('/root/in/sub/a.zip!/', page_id, '/x.xml') ELSE concat('hdfs://h/other/', page_id, '.pdf') END AS path FROM pages")
    return paths.select("page_id", canonical.displayed(F.col("path"), "/root/in/").alias("shown"))


@query("""
SELECT o_orderkey AS k, 't' || o_orderkey || ':S:' || i AS row_id, CASE WHEN i = 1 THEN o_orderstatus ELSE o_orderpriority END AS name, (o_orderkey % 100 + i)::VARCHAR AS total FROM orders, (VALUES (1), (2)) v(i) WHERE o_orderkey % 3 <> 2""")
def generic_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.sources import canonical

    made = select(spark, sf_dir, "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
    k = F.col("o_orderkey")
    heads = F.when(k % 3 == 2, F.array(F.lit("name"), F.lit("remark"))).otherwise(F.array(F.lit(" Наименование "), F.lit("ИТОГО")))
    body = [F.array(F.col("o_orderstatus"), (k % 100 + 1).cast("string")), F.array(F.col("o_orderpriority"), (k % 100 + 2).cast("string"))]
    rows_ = F.when(k % 3 == 0, F.array(*body)).otherwise(F.array(heads, *body))
    tables_ = made.select(F.concat(F.lit("t"), k).alias("source_path"), F.lit("S").alias("sheet"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("range"), F.lit(None).cast("string").alias("estimate_id"), F.when(k % 3 == 0, heads).alias("headers"), rows_.alias("rows"))
    got = canonical.table_records(tables_)
    return got.select(F.substring("source_path", 2, 30).cast("long").alias("k"), F.col("fields")["row_id"].alias("row_id"), F.col("fields")["name"].alias("name"), F.col("fields")["declared_total"].alias("total"))


@query("""
SELECT c_custkey AS k, 'c:page:' || (c_custkey % 9 + 1) || ':table:' || c_custkey || ':row:' || i AS row_id, c_mktsegment AS name, (c_custkey + i)::VARCHAR AS quantity FROM customer, (VALUES (1), (2)) v(i) WHERE c_custkey % 5 <> 0 AND NOT (i = 2 AND c_custkey % 3 = 0)""")
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.sources import canonical

    made = select(spark, sf_dir, "SELECT c_custkey, c_mktsegment FROM customer")
    k = F.col("c_custkey")
    lines = [[F.when(k % 5 == 0, "remark").otherwise("Наименование"), F.lit("Количество"), F.lit("Всего")], *[[F.col("c_mktsegment"), (k + i).cast("string"), F.lit("1")] for i in (1, 2)]]
    flat = (k % 3 == 0).cast("int")
    cells = [F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), x.alias("text"), F.lit(c * 10.0).alias("x0"), F.lit(r * 10.0).alias("top"), (F.lit(c * 10.0) + F.when((flat == 1) & F.lit(r == 2 and c == 1), 0.0).otherwise(9.0)).alias("x1"), F.lit(r * 10.0 + 9).alias("bottom")) for r, line in enumerate(lines) for c, x in enumerate(line)]
    rows_ = made.select(F.lit("c").alias("source_path"), (k % 9 + 1).cast("int").alias("page"), k.alias("table"), F.explode(F.array(*cells)).alias("x")).select("source_path", "page", "table", "x.*")
    got = canonical.page_table_rows(rows_)
    return got.select(F.regexp_extract(F.col("fields")["row_id"], "table:([0-9]+)", 1).cast("long").alias("k"), F.col("fields")["row_id"].alias("row_id"), F.col("fields")["name"].alias("name"), F.col("fields")["quantity"].alias("quantity"))


_TOLD = "SELECT o_orderkey AS id, concat('check-', o_orderkey % 40) AS check_id, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS n FROM orders"


@query(f"""
WITH f AS ({_TOLD}), e AS (SELECT id, check_id, (id + i) % 90 AS s FROM f, (VALUES (0), (1)) v(i) WHERE i < n), b AS (SELECT DISTINCT id, check_id FROM e WHERE s % 4 = 0 OR s % 5 = 0),
l AS (SELECT check_id, count(*) = count(b.id) AS lost FROM f LEFT JOIN b USING (id, check_id) GROUP BY check_id)
SELECT check_id AS id, CASE WHEN lost THEN 'limited' ELSE 'finding' END AS status FROM l""")
def source_downgrades(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = select(spark, sf_dir, _TOLD)
    name = lambda i: F.concat(F.lit("S"), (F.col("id") + i) % 90)
    told = made.select("id", "check_id", F.when(F.col("n") == 2, F.array(name(0), name(1))).otherwise(F.array(name(0))).alias("source_ids"))
    k = F.col("id")
    sources = spark.range(90).select(F.concat(F.lit("S"), k).alias("source_id"), (k % 4 != 0).alias("current_verified"), F.when(k % 5 == 0, " ").otherwise("2026").alias("edition"), F.lit("p. 1").alias("pinpoint"), F.lit("https://example.org/x").alias("official_url"), F.lit("official").alias("class"))
    checks = told.select(F.col("check_id").alias("id")).distinct().withColumn("status", F.lit("finding"))
    return rollup.downgraded(checks, told, sources)


@query("""
SELECT row_id FROM (SELECT DISTINCT o_orderkey + 3 AS row_id FROM orders) a WHERE row_id NOT IN (SELECT o_orderkey FROM orders)""")
def unknown_attestations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.unknown_rows(select(spark, sf_dir, "SELECT o_orderkey AS row_id FROM orders"), select(spark, sf_dir, "SELECT o_orderkey + 3 AS row_id FROM orders"))


@query("""
WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS size, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS asked, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS i FROM conversations),
r(conv_id, i, size, asked, pages) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, '' FROM o
  UNION ALL SELECT o.conv_id, o.i, r.size + CASE WHEN fits THEN o.size ELSE 0 END, r.asked + CASE WHEN fits THEN o.asked ELSE 0 END, r.pages || CASE WHEN fits THEN ',' || o.turn ELSE '' END
  FROM r JOIN o ON o.conv_id = r.conv_id AND o.i = r.i + 1, LATERAL (SELECT r.size + o.size <= 2500 AND r.asked + o.asked <= 2 AS fits) f)
SELECT conv_id, arg_max(size, i) AS size, arg_max(asked, i) AS asked, ltrim(arg_max(pages, i), ',') AS pages FROM r GROUP BY conv_id""")
def page_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = select(spark, sf_dir, "SELECT conv_id, turn, length(text) AS size, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS asked FROM conversations")
    got = tables.page_budgets(pages, "conv_id", "turn", {"size": 2500, "asked": 2})
    return got.select("conv_id", F.col("used")["size"].alias("size"), F.col("used")["asked"].alias("asked"), F.array_join("pages", ",").alias("pages"))
