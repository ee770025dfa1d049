"""Estimate hierarchy: relations of children to parents, totals, and cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.evidence import precise, reliable, with_evidence
from ledgerlens.functions.text import blank, estimate_type
from ledgerlens.operators.ranges import cut


def _typed(estimates: DataFrame) -> DataFrame:
    rows = with_evidence(estimates)
    return rows.select("*", estimate_type(F.col("estimate_type")).alias("kind"), reliable().alias("trusted"), precise().alias("exact"))


def relations(estimates: DataFrame) -> DataFrame:
    """(child_id, parent_id, child_type, parent_type, status, reason) of each estimate that names a parent.

    Parents are reduced to one row per id with their number, so a repeated id multiplies nothing. A direct step
    from local to summary estimate needs a verified attestation (direct_allowed, true or false).
    """
    rows = _typed(estimates)
    parents = rows.where(~blank(F.col("estimate_id"))).groupBy(F.col("estimate_id").alias("parent_id")).agg(F.count("*").alias("n"), F.min("kind").alias("parent_kind"), F.bool_and("trusted").alias("parent_trusted"), F.bool_and("exact").alias("parent_exact"))
    children = rows.where(~blank(F.col("parent_id")))
    if "direct_allowed" not in children.columns:
        children = children.withColumn("direct_allowed", F.lit(None).cast("boolean"))
    j = children.join(parents, "parent_id", "left")
    c, p = F.col("kind"), F.col("parent_kind")
    direct = (c == "LSR") & (p == "SSR")
    fits = ((c == "LSR") & (p == "OSR")) | ((c == "OSR") & (p == "SSR"))
    vague = c.isNull() | p.isNull() | (c == "OSR_OR_SSR") | (p == "OSR_OR_SSR")
    cases = [
        (F.col("n").isNull(), "needs_input", "parent_not_found"), (F.col("n") > 1, "needs_input", "parent_id_not_unique"),
        (~(F.col("trusted") & F.col("parent_trusted")), "limited", "hierarchy_records_not_reliable"), (~(F.col("exact") & F.col("parent_exact")), "limited", "hierarchy_evidence_not_precise"),
        (direct & F.col("direct_allowed"), "passed", "trusted_direct_lsr_to_ssr_allowed"), (direct & ~F.col("direct_allowed"), "finding", "trusted_direct_lsr_to_ssr_forbidden"), (direct, "needs_input", "direct_lsr_to_ssr_route_not_attested"),
        (fits, "passed", "expected_hierarchy_direction"), (vague, "needs_input", "hierarchy_types_not_resolved"),
    ]
    status, reason = F.lit("finding"), F.lit("invalid_hierarchy_direction")
    for test, s, r in reversed(cases):
        status, reason = F.when(test, s).otherwise(status), F.when(test, r).otherwise(reason)
    return j.select(F.col("estimate_id").alias("child_id"), "parent_id", c.alias("child_type"), F.when(F.col("n") == 1, p).alias("parent_type"), status.alias("status"), reason.alias("reason"))


def totals(estimates: DataFrame) -> DataFrame:
    """(parent_id, status, reason, observed, expected): each single parent's total against the sum of its children's."""
    rows = _typed(estimates)
    parents = rows.where(~blank(F.col("estimate_id"))).groupBy("estimate_id").agg(F.count("*").alias("n"), F.min("declared_total").alias("observed"), F.bool_and("trusted").alias("pt"), F.bool_and("exact").alias("pe"))
    sums = rows.where(~blank(F.col("parent_id"))).groupBy("parent_id").agg(F.sum("declared_total").alias("expected"), F.count_if(F.col("declared_total").isNull()).alias("unknown"), F.bool_and("trusted").alias("ct"), F.bool_and("exact").alias("ce"))
    j = sums.join(parents.where("n = 1"), F.col("parent_id") == F.col("estimate_id"))
    cases = [
        (~(F.col("pt") & F.col("ct")), "limited", "hierarchy_records_not_reliable"), (~(F.col("pe") & F.col("ce")), "limited", "hierarchy_evidence_not_precise"),
        (F.col("observed").isNull() | (F.col("unknown") > 0), "needs_input", "hierarchy_totals_not_available"), (F.col("observed") != F.col("expected"), "finding", "total_mismatch"),
    ]
    status, reason = F.lit("passed"), F.lit("totals_reconciled")
    for test, s, r in reversed(cases):
        status, reason = F.when(test, s).otherwise(status), F.when(test, r).otherwise(reason)
    return j.select("parent_id", status.alias("status"), reason.alias("reason"), "observed", "expected")


def cycles(links: DataFrame) -> DataFrame:
    """(entry, length, least) of each cycle of links (child, parent), at most one parent per child.

    A walk that starts from the smallest id of those that lead to a cycle enters it at `entry`. Pointers are
    doubled, so a chain of n links takes log n joins, and each loop ends when a round changes nothing.
    """
    step = links.groupBy("child").agg(F.min("parent").alias("parent"))
    step = step.join(step.select(F.col("child").alias("parent")), "parent", "left_semi").select("child", "parent")
    far = cut(step.select(F.col("child").alias("x"), F.col("parent").alias("y")))
    first, ends = far, -1
    while (now := far.select("y").distinct().count()) != ends:  # once as many ends remain, all of them are on cycles
        ends = now
        far = cut(far.join(far.select(F.col("x").alias("y"), F.col("y").alias("z")), "y").select("x", F.col("z").alias("y")))
    on = cut(far.select(F.col("y").alias("x")).distinct())
    ring = on.join(first, "x")
    # the smallest node of each ring and its length, by doubling with minima, until no minimum falls
    low = cut(ring.select("x", "y", F.least("x", "y").alias("m"), F.lit(True).alias("fell")))
    while not low.where("fell").isEmpty():
        ahead = low.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("m").alias("m2"))
        low = cut(low.join(ahead, "y").select("x", F.col("z").alias("y"), F.least("m", "m2").alias("m"), (F.col("m2") < F.col("m")).alias("fell")))
    rings = low.select("x", F.col("m").alias("least"))
    # where walks from outside enter: jump until the target is on a ring
    marked = on.withColumn("on", F.lit(True))
    walk = cut(first.join(far.select("x"), "x").join(marked, "x", "left").select("x", F.when(F.col("on"), F.col("x")).otherwise(F.col("y")).alias("y"), F.lit(True).alias("moved")))
    while not walk.where("moved").isEmpty():
        ahead = walk.select(F.col("x").alias("y"), F.col("y").alias("z"))
        walk = cut(walk.join(ahead, "y").select("x", F.col("z").alias("y"), (F.col("z") != F.col("y")).alias("moved")))
    entered = walk.join(rings.select(F.col("x").alias("y"), "least"), "y").groupBy("least").agg(F.min_by("y", "x").alias("entry"))
    sizes = rings.groupBy("least").agg(F.count("*").alias("length"))
    return entered.join(sizes, "least").select("entry", "length", "least")
