"""Views that the registered queries run over: the same SQL text in both engines, over the driver's tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations"]

VIEWS = {
    "v_rows": """
SELECT l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 AS row_id, cast(l_orderkey AS string) AS estimate_id, p_brand AS code, p_name AS name,
  CASE WHEN l_orderkey % 23 = 0 THEN NULL ELSE p_type END AS unit, cast(l_quantity AS decimal(6,2)) AS quantity,
  CASE WHEN l_orderkey % 29 = 0 THEN NULL ELSE cast(p_retailprice AS decimal(8,2)) END AS unit_price,
  CASE WHEN l_linenumber % 7 = 3 THEN NULL ELSE cast(1 - l_discount AS decimal(4,2)) END AS "index", cast(1 + l_tax AS decimal(4,2)) AS coefficient,
  CASE WHEN l_linenumber % 4 = 0 THEN 'quantity * unit_price * index * coefficient' WHEN l_linenumber % 4 = 1 THEN 'quantity * unit_price'
    WHEN l_linenumber % 4 = 2 THEN 'quantity * unit_price * index' ELSE 'quantity * unit_price * coefficient' END AS basis_formula,
  l_suppkey % 13 <> 0 AS basis_verified, CASE WHEN l_partkey % 17 = 0 THEN ' ' ELSE 'Sheet!A1' END AS basis_locator,
  CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN NULL ELSE cast(
    cast(l_quantity AS decimal(6,2)) * cast(p_retailprice AS decimal(8,2))
    * CASE WHEN l_linenumber % 4 IN (0, 2) THEN cast(1 - l_discount AS decimal(4,2)) ELSE cast(1 AS decimal(4,2)) END
    * CASE WHEN l_linenumber % 4 IN (0, 3) THEN cast(1 + l_tax AS decimal(4,2)) ELSE cast(1 AS decimal(4,2)) END
    + CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN cast(0.01 AS decimal(4,2)) ELSE cast(0 AS decimal(4,2)) END AS decimal(24,8)) END AS declared_total,
  CASE WHEN l_suppkey % 19 = 0 THEN 'partial' ELSE 'reliable' END AS reliability, l_linenumber % 2 = 0 AS source_fields_verified_complete,
  CASE WHEN l_returnflag = 'R' THEN 'Unclassified' ELSE l_returnflag END AS category, 'book.xlsx' AS source_path, 'Sheet!A' AS locator,
  CASE WHEN l_partkey % 31 = 0 THEN ' ' ELSE 'Sheet' END AS sheet, 'A1:H1' AS cell_range
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_formulas": """
SELECT event_id AS formula_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE cast(value AS decimal(18,4)) END AS computed_value,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN cast(value AS decimal(18,4)) + cast(0.5 AS decimal(18,4)) ELSE cast(value AS decimal(18,4)) END AS cached_value,
  CASE WHEN event_id % 17 = 0 THEN 'partial' END AS reliability, 'b.xlsx' AS source_path, 'S!A1' AS locator, CASE WHEN event_id % 19 = 0 THEN 0 ELSE 3 END AS page
FROM events""",
    "v_estimates": """
SELECT concat('R', r_regionkey) AS estimate_id, 'SSR' AS estimate_type, cast(NULL AS string) AS parent_id, cast(0 AS decimal(18,2)) AS declared_total, cast(NULL AS string) AS reliability, '/r' AS xpath, cast(NULL AS boolean) AS direct_allowed, 's.xml' AS source_path, 'l' AS locator FROM region
UNION ALL
SELECT concat('N', n_nationkey), CASE WHEN n_nationkey % 9 = 8 THEN 'object_or_summary_estimate' ELSE ' OSR ' END, concat('R', n_regionkey), t.total + CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END, CASE WHEN n_nationkey % 11 = 10 THEN 'partial' END, '/r/n', cast(NULL AS boolean), 's.xml', 'l'
FROM nation LEFT JOIN (SELECT c_nationkey, cast(sum(cast(c_acctbal AS decimal(14,2))) AS decimal(17,2)) AS total FROM customer GROUP BY c_nationkey) t ON c_nationkey = n_nationkey
UNION ALL
SELECT concat('C', c_custkey), CASE WHEN c_custkey % 37 = 0 THEN 'ssr' WHEN c_custkey % 41 = 0 THEN 'other' ELSE 'LSR' END,
  CASE WHEN c_custkey % 43 = 0 THEN 'nowhere' WHEN c_custkey % 47 = 0 THEN concat('R', c_nationkey % 5) ELSE concat('N', c_nationkey) END, cast(c_acctbal AS decimal(18,2)), CASE WHEN c_custkey % 53 = 0 THEN 'partial' END, CASE WHEN c_custkey % 59 = 0 THEN 'x' ELSE '/r/c' END,
  CASE WHEN c_custkey % 3 = 0 THEN true WHEN c_custkey % 3 = 1 THEN false END, 's.xml', 'l'
FROM customer""",
    "v_links": "SELECT s_suppkey AS child, (s_suppkey * 7 + 3) % 61 + CASE WHEN s_suppkey % 5 = 0 THEN 40 ELSE 0 END AS parent FROM supplier WHERE s_suppkey % 11 <> 0",
    "v_findings": "SELECT concat('F', row_id % 997) AS id, CASE WHEN row_id % 3 = 0 THEN 'material' WHEN row_id % 3 = 1 THEN 'recommendation' ELSE 'critical' END AS severity, row_id AS ord FROM v_rows",
    "v_kacs": """
SELECT p_partkey AS kac_id, CASE WHEN p_partkey % 7 = 0 THEN '0' WHEN p_partkey % 11 = 0 THEN 'n/a' ELSE '12,50' END AS price, p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN '  ' ELSE p_type END AS characteristics,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 'pcs' END AS unit, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE '67' END AS region_or_price_zone, 'RUB' AS currency_code, p_partkey % 3 = 0 AS comparability, CASE WHEN p_partkey % 2 = 0 THEN 'same' END AS comparability_basis,
  p_brand AS source, '2026-08-01' AS "date", CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE false END AS vat_included, true AS delivery_included, CASE WHEN p_partkey % 23 = 0 THEN 'partial' END AS reliability,
  'q.pdf' AS source_path, 'page:1' AS locator, CASE WHEN p_partkey % 29 = 0 THEN -1 ELSE 1 END AS page
FROM part""",
    "v_words": """
SELECT conv_id AS page, turn AS block, 1 AS par, conv_id * 1000 + w.rank AS line, w.i AS word_num, w.word AS text, ((w.i - 1) % 12 + 1) * 60 - CASE WHEN (conv_id + w.i) % 31 = 0 THEN 100 ELSE 0 END AS "left", turn * 100000 + w.rank * 20 AS top, 50 AS width, 12 AS height,
  (conv_id * 7 + turn * 3 + w.i * 13) % 100 AS conf, 740 AS image_width, 10000000 AS image_height
FROM (SELECT conv_id, turn, split(regexp_replace(text, '[^A-Za-z]+', ' '@G), ' ') AS ws FROM conversations) c, @UNNEST(ws) w WHERE w.word <> ''""",
}


def _expand(sql: str) -> str:
    """sql with the views it names as common table expressions, in order."""
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    seen: list[str] = []
    while names:
        n = names.pop()
        seen = [n, *[s for s in seen if s != n]]
        names += [m for m in VIEWS if m != n and re.search(rf"\b{m}\b", VIEWS[n])]
    return ",\n".join(f"{n} AS ({VIEWS[n]})" for n in seen)


def _spark(sql: str) -> str:
    sql = re.sub(r"@UNNEST\((\w+)\) w", r"LATERAL (SELECT pos + 1 AS i, cast(floor(pos / 12) AS bigint) AS rank, col AS word FROM posexplode(\1)) w", sql).replace("@G", "")
    return re.sub(r'"(\w+)"', r"`\1`", sql)


def _duck(sql: str) -> str:
    return re.sub(r"@UNNEST\((\w+)\) w", r"LATERAL (SELECT unnest(range(1, len(\1) + 1)) AS i, unnest(range(0, len(\1))) // 12 AS rank, unnest(\1) AS word) w", sql).replace("@G", ", 'g'")


def configure(spark: SparkSession) -> None:
    """Products of decimals keep their scale."""
    spark.conf.set("spark.sql.decimalOperations.allowPrecisionLoss", "false")


def select(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql over the tables and views, in Spark."""
    configure(spark)
    ctes = _expand(sql)
    whole = _spark(f"WITH {ctes} {sql}" if ctes else sql)
    used = [t for t in TABLES if re.search(rf"\b{t}\b", whole)]
    whole = re.sub(r"\b(" + "|".join(used) + r")\b", r"{\1}", whole) if used else whole
    return spark.sql(whole, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def duck(sql: str) -> str:
    """sql over the tables and views, for DuckDB; sql may begin with further expressions: `WITH a AS (...) SELECT`."""
    ctes = _expand(sql)
    if not ctes:
        return _duck(sql)
    if m := re.match(r"\s*WITH (RECURSIVE )?", sql):
        return _duck(f"WITH {m[1] or ''}{ctes},\n{sql[m.end() :]}")
    return _duck(f"WITH {ctes}\n{sql}")
