"""Roll-ups: one status per control, the control matrix, demotion, coverage, and bounded results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Strongest first; controls differ.
USUAL = ["finding", "needs_input", "limited", "passed"]
INPUT_FIRST = ["needs_input", "finding", "limited", "passed"]
SEVERITIES = ["critical", "material", "recommendation"]

# The ids of the control matrix, and the checks that answer for some of them.
MATRIX = [
    "PKG-01", "PKG-02", "PKG-03", "PKG-04", "QTY-01", "QTY-02", "RATE-01", "RATE-02", "RATE-03", "RES-01", "RES-02", "KAC-01", "KAC-02", "SUM-01",
    "SUM-02", "SUM-03", "SUM-04", "SUM-05", "SUM-06", "PIR-01", "SUR-01", "CAP-01", "OCH-01", "CONTRACT-01", "ANA-01", "ANA-02", "ANA-03", "ANA-04",
]
ANSWERS = {
    "PKG-01": ("INV-01", False),
    "PKG-03": ("HIER-01", True),
    "QTY-02": ("ARITH-01", False),
    "KAC-01": ("KAC-01", True),
    "SUM-06": ("VAT-01", True),
    "ANA-01": ("DUP-01", True),
    "ANA-03": ("ANALYTICS-01", True),
    "PIR-01": ("ROUTE-PIR", False),
    "SUR-01": ("ROUTE-SURVEY", False),
    "OCH-01": ("ROUTE-OKN", False),
    "CONTRACT-01": ("ROUTE-CONTRACT", False),
}
# Work types of capital repair and of demolition.
CAPITAL = ["capital_repair", "капремонт", "капитальный ремонт"]
DEMOLITION = ["demolition", "снос"]


def ranked(status: Column, order: list[str]) -> Column:
    """0 for the strongest status; unknown ones count as limited."""
    out = F.lit(order.index("limited"))
    for i, s in enumerate(order):
        out = F.when(status == s, i).otherwise(out)
    return out


def state(states: DataFrame, *by: str, order: list[str] = USUAL) -> DataFrame:
    """The strongest status of states per group; without groups one row, not_applicable if there are no states."""
    top = F.min(ranked(F.col("status"), order))
    named = F.coalesce(F.try_element_at(F.array(*map(F.lit, order)), F.col("r") + 1), F.lit("not_applicable"))
    return states.groupBy(*by).agg(top.alias("r"), F.count("*").alias("n")).select(*by, named.alias("status"), "n")


def matrix(checks: DataFrame, work_type: str = "") -> DataFrame:
    """(id, status, source) of the 28 matrix controls from checks (id, status)."""
    spark: SparkSession = checks.sparkSession
    kind = work_type.strip().casefold()
    rows = []
    for i in MATRIX:
        source, absent = ANSWERS.get(i, (None, False))
        fixed = None if source else "limited"
        if i == "CAP-01":
            source, fixed = ("ROUTE-DEMOLITION", None) if kind in DEMOLITION else (None, "limited" if kind in CAPITAL else "not_applicable")
        rows.append((i, source, absent, fixed))
    dim = spark.createDataFrame(rows, "id string, source string, absent boolean, fixed string")
    got = dim.join(checks.select(F.col("id").alias("source"), F.col("status").alias("got")), "source", "left")
    status = F.coalesce("fixed", F.when(F.col("absent") & (F.col("got") == "not_applicable"), "limited").otherwise(F.col("got")), F.lit("limited"))
    return got.select("id", status.alias("status"), "source")


def demote(checks: DataFrame) -> DataFrame:
    """checks with passed as needs_input if any check needs input."""
    flag = checks.agg(F.coalesce(F.bool_or(F.col("status") == "needs_input"), F.lit(False)).alias("open"))
    status = F.when(F.col("open") & (F.col("status") == "passed"), "needs_input").otherwise(F.col("status"))
    return checks.crossJoin(F.broadcast(flag)).withColumn("status", status).drop("open")  # one row of one flag


def full_rows(rows: DataFrame, attested: DataFrame, dimensions: list[str]) -> DataFrame:
    """(row_id, status, lacking): rows (row_id, arithmetic status, fields_open) under attestations (row_id, completed array)."""
    done = F.coalesce(F.col("completed"), F.array().cast("array<string>"))
    lacking = F.array_sort(F.array_except(F.array(*map(F.lit, dimensions)), done))
    checked = F.col("arithmetic").isin("passed", "finding")
    open_ = F.col("fields_open")
    status = F.when(checked & ~open_ & (F.size(lacking) == 0), "passed").when(~checked | open_, F.when((F.col("arithmetic") == "limited") & ~open_, "limited").otherwise("needs_input")).otherwise("limited")
    parts = F.when(checked & ~open_, lacking).otherwise(F.array_compact(F.array(F.when(~checked, F.lit("arithmetic")), F.when(open_, F.lit("fields")))))
    return rows.join(attested, "row_id", "left").select("row_id", status.alias("status"), F.array_join(parts, ",").alias("lacking"))


def unknown_rows(rows: DataFrame, attested: DataFrame) -> DataFrame:
    """(row_id) of attestations of rows that aren't there: they cover nothing, and are reported."""
    return attested.select("row_id").distinct().join(rows.select("row_id"), "row_id", "left_anti")


def coverage(states: DataFrame) -> DataFrame:
    """One row of counts of states (row_id, status): extracted rows, and how many different ids are checkable, checked, and open."""
    ids = states.groupBy("row_id").agg(F.count("*").alias("n"), F.bool_or(F.col("status").isin("passed", "finding")).alias("c"), F.bool_or(F.col("status") == "needs_input").alias("o"))
    return ids.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("extracted"), F.count("*").alias("checkable"), F.count_if("c").alias("checked"), F.count_if("o").alias("open"))


def top_findings(findings: DataFrame, k: int = 1000) -> DataFrame:
    """The k findings of highest severity, then by id and order; each task sends k at most."""
    return findings.orderBy(ranked_severity(F.col("severity")), "id", "ord").limit(k)


def ranked_severity(severity: Column) -> Column:
    out = F.lit(len(SEVERITIES))
    for i, s in enumerate(SEVERITIES):
        out = F.when(severity == s, i).otherwise(out)
    return out


def bounded(rows: DataFrame, key: str, order: list[str], value: str, k: int) -> DataFrame:
    """(key, kept, total, omitted): the first k values per key in order, and how many there are.

    Ranks are taken per key and bucket first, so that a frequent key sends k rows per bucket to its last task.
    """
    salted = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order, value), F.lit(64)))
    first = salted.withColumn("_r", F.row_number().over(W.partitionBy(key, "_bucket").orderBy(*order, value))).where(F.col("_r") <= k)
    last = first.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order, value))).where(F.col("_r") <= k)
    kept = last.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", value))), lambda s: s[value]).alias("kept"))
    totals = rows.groupBy(key).agg(F.count("*").alias("total"))
    return kept.join(totals, key).select(key, F.array_join("kept", ",").alias("kept"), "total", (F.col("total") - F.size("kept")).alias("omitted"))


def cited(findings: DataFrame, sources: DataFrame) -> DataFrame:
    """findings (id, source_ids) all of whose sources are verified; others become limitations."""
    each = findings.select("id", F.explode("source_ids").alias("source_id"))
    bad = each.join(verified_sources(sources).select("source_id").distinct(), "source_id", "left_anti").select("id").distinct()
    return findings.join(bad, "id", "left_anti")


def uncited(findings: DataFrame, sources: DataFrame) -> DataFrame:
    """(code, finding_id, check_id, source_ids) of limitations: findings (id, check_id, source_ids) that `cited` leaves out, with the sources that failed."""
    each = findings.select("id", "check_id", F.explode("source_ids").alias("source_id"))
    bad = each.join(verified_sources(sources).select("source_id").distinct(), "source_id", "left_anti")
    return bad.groupBy(F.lit("finding_source_not_verified").alias("code"), F.col("id").alias("finding_id"), "check_id").agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"))


def downgraded(checks: DataFrame, findings: DataFrame, sources: DataFrame) -> DataFrame:
    """checks (id, status) with a finding as limited where every finding (id, check_id, source_ids) of it fell out for its sources."""
    lost = uncited(findings, sources).select(F.col("finding_id").alias("id"), F.lit(True).alias("lost")).distinct()
    left = findings.join(lost, "id", "left").groupBy(F.col("check_id").alias("id")).agg(F.bool_and(F.coalesce("lost", F.lit(False))).alias("all_lost"))
    status = F.when(F.coalesce("all_lost", F.lit(False)) & (F.col("status") == "finding"), "limited").otherwise(F.col("status"))
    return checks.join(left, "id", "left").withColumn("status", status).drop("all_lost")


def verified_sources(sources: DataFrame) -> DataFrame:
    """Sources that are current, with an edition and a pinpoint, and an http address unless internal."""
    has = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    web = F.coalesce(F.try_parse_url("official_url", F.lit("PROTOCOL")).isin("http", "https") & F.try_parse_url("official_url", F.lit("HOST")).isNotNull(), F.lit(False))
    return sources.where(F.coalesce(F.col("current_verified"), F.lit(False)) & has("edition") & has("pinpoint") & ((F.col("class") == "internal") | web))
