"""From a package of files to its result: inventory, archives, workbooks and XML, canonical collections, audit, bounded document."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import rollup, rows
from ledgerlens.operators.ranges import cut
from ledgerlens.plans import context as told
from ledgerlens.plans import contract
from ledgerlens.plans.audit import audit, missing_passport
from ledgerlens.sources import canonical, inventory, packages, workbooks, xls, xml, xml_rules

# The checks of a result without a passport, how many entries of each list are published, and the codes of what is not read.
BLOCKED = ["INV-01", "HIER-01", "ARITH-01", "FORMULA-01", "DUP-01", "FIELD-01", "COMPONENT-01", "KAC-01", "VAT-01", "ANALYTICS-01", "ROUTE-PIR", "ROUTE-SURVEY", "ROUTE-OKN", "ROUTE-DEMOLITION", "ROUTE-CONTRACT", "FULL-ROW-01"]
KEPT = {"findings": 1_000, "limitations": 999, "input_inventory": 2_000, "estimate_hierarchy": 2_000, "gaps": 500}
ENTITIES = ["documents", "estimates", "rows", "resources", "accruals", "kacs", "totals", "formulas"]
UNREAD = ("pdf", inventory.UNSUPPORTED)


def question(missing: list[str]) -> dict:
    """The one question of a run, for all that is missing."""
    return {"id": "Q-PASSPORT-01", "prompt": "Одним ответом уточни: " + "; ".join(missing) + ".", "missing_fields": missing, "blocking": True, "grouped": True}


def verdict(questions: bool, items: int, unusable: bool, entities: int, rows_: int, material: bool, limited: bool) -> tuple[str, str, str]:
    """(execution status, overall status, recommended action); the first that applies counts."""
    done = "completed_with_limits" if limited else "completed"
    cases = [
        (questions, "needs_input", "needs_clarification", "answer_the_question"), (not items or (unusable and not entities), "failed", "verification_impossible", "provide_a_readable_package"),
        (material, done, "material_nonconformities", "remove_the_nonconformities"), (not rows_, "completed_with_limits", "verification_impossible", "provide_estimate_rows"),
        (not entities, done, "verification_impossible", "provide_estimate_data"), (limited, done, "verified_in_checked_scope", "mind_the_limitations"),
    ]
    return next((c[1:] for c in cases if c[0]), (done, "verified_in_checked_scope", "keep_the_report"))


def extract(spark: SparkSession, files: DataFrame, registry: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(inventory, records, limitations, gaps) of files (path, size_bytes, sha256, extension, reader, content).

    Members of archives are files as well. XML is read only where the registry (schema_id, root, namespace,
    extensions) knows its root, and the rules know the schema; other XML is a limitation, like files without a reader.
    """
    members = cut(packages.expand(files.where("reader = 'zip'").select("path", "content")))
    inner = members.where("code IS NULL AND content IS NOT NULL").select("path", "size_bytes", F.sha2("content", 256).alias("sha256"), inventory.extension(F.col("path")).alias("extension"), inventory.reader(F.col("path")).alias("reader"), "content")
    every = files.unionByName(inner)
    books = every.where("reader = 'ooxml'").select("path", "content")
    cells = cut(workbooks.read(books).unionByName(xls.read(every.where("reader = 'xls'").select("path", "content"))))
    parts = cut(workbooks.read_structure(books))
    refused = cells.where("kind = 'refused'").select("path", "code")
    partial = cells.where("kind <> 'refused' AND code IS NOT NULL").select("path", "code").distinct()
    good = cells.where("kind <> 'refused'")
    tables = workbooks.declared_tables(parts)
    records = canonical.sheet_records(good, tables)
    gaps = canonical.unclassified(good, canonical.sheet_rows(good, tables))
    found = cut(xml.values(every.where("reader = 'xml'").select("path", "content")))
    broken = found.where("kind = 'error'").select(F.col("source_path").alias("path"), "code")
    roots = found.where("kind = 'element' AND owner = ''").select(F.col("source_path").alias("path"), F.col("local_name").alias("root"), F.lit(None).cast("string").alias("namespace"), inventory.extension(F.col("source_path")).alias("extension"))
    if registry is None:
        registry = spark.createDataFrame([], "schema_id string, root string, namespace string, extensions array<string>")
    known = xml.matching_schemas(roots, registry).withColumnRenamed("path", "source_path")
    rules, paths = xml_rules.tables(spark)
    anchored = cut(xml.anchors(found.join(known, "source_path"), rules))
    values = xml.mapped_paths(anchored, found, paths).groupBy("source_path", "anchor", "rule").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("found"))
    kept = anchored.select("source_path", F.col("xpath").alias("anchor"), "rule", "entity", "schema_id", "line").join(values, ["source_path", "anchor", "rule"], "left")
    identity = F.concat_ws(":", "source_path", "schema_id", "anchor")
    ids = reduce(lambda rest, c: F.when(F.lower("entity") == c[0], F.create_map(F.lit(c[1]), identity)).otherwise(rest), [(e, canonical.COLUMNS[c][0]) for e, c in canonical.COLLECTIONS.items()], F.create_map(F.lit("id"), identity))
    made = F.map_concat(F.coalesce("found", F.create_map().cast("map<string,string>")), ids)
    place = canonical.evidence({"xpath": F.col("anchor"), "line": F.col("line")}, F.col("source_path"), F.col("anchor"))
    records = records.unionByName(kept.select(F.lower("entity").alias("entity"), made.alias("fields"), F.lit("reliable").alias("reliability"), *[c.alias(n) for n, c in place.items()]))
    unknown = roots.join(known.select(F.col("source_path").alias("path")), "path", "left_anti").select("path", F.lit("xml_schema_unknown").alias("code"))
    unread = every.where(F.col("reader").isin(*UNREAD)).select("path", F.lit(inventory.UNSUPPORTED).alias("code"))
    outer = members.where("code IS NOT NULL").select("path", "code")
    faults = refused.unionByName(partial).unionByName(broken).unionByName(unknown).unionByName(unread).unionByName(outer)
    state = F.when(F.col("code").isNull(), "reliable").when(F.col("code").isin(inventory.UNSUPPORTED, "xml_schema_unknown"), "not_inspected").when(F.col("code").like("legacy%"), "partial").when(F.col("code").like("zip%") | F.col("code").like("%limit%") | F.col("code").like("%forbidden"), "rejected").otherwise("failed")
    items = every.select("path", "size_bytes", "sha256", "extension", inventory.media_type(F.col("extension")).alias("media_type")).join(faults.groupBy("path").agg(F.min("code").alias("code")), "path", "left").select("path", "size_bytes", "sha256", "extension", "media_type", state.alias("extraction_status"))
    items = items.join(canonical.details(cells, parts), "path", "left")
    notes = faults.select("code", F.col("path").alias("source_path"), F.col("path").alias("locator"))
    return items, records, notes, gaps


def _some(df: DataFrame, order: list[str], k: int) -> tuple[list[dict], int]:
    total = df.count()
    return [r.asDict(recursive=True) for r in df.orderBy(*order).limit(k).collect()], total


def inspect(spark: SparkSession, root: str, mode: str = "full", purpose: str | None = None, context: dict | None = None, trusted: dict | None = None, coverage: dict | None = None, registry: DataFrame | None = None, records: DataFrame | None = None) -> dict:
    """The result document of the package at root (a folder or a file).

    Lists are cut to KEPT entries with what was left out told, which takes back claims of whole coverage. Trusted
    callers may add records, a registry of XML schemas, domain context and attestations of rows.
    """
    own = told.public(mode, purpose, context)
    attested = told.attestations(coverage)
    limitations: list[dict] = []
    missing = (["purpose"] if not (purpose or "").strip() else []) + missing_passport(own)
    try:
        inventory.preflight(root)
        files = cut(inventory.scan(spark, root))
    except inventory.Rejected as error:
        limitations.append({"code": str(error), "source_path": error.locator, "locator": error.locator})
        files = spark.createDataFrame([], inventory.SCHEMA)
    shown = files.withColumn("path", canonical.displayed(F.col("path"), root))
    items, found, notes, gaps = extract(spark, shown, registry)
    found = found if records is None else found.unionByName(records)
    model = {n: cut(df) for n, df in canonical.routed(found).items()}
    items, notes = cut(items), cut(notes)
    kept_items, n_items = _some(items, ["path"], KEPT["input_inventory"])
    kept_notes, n_notes = _some(canonical.located(notes.withColumns({"xpath": F.lit(None).cast("string"), "line": F.lit(None).cast("int"), "page": F.lit(None).cast("int")})).select("code", "source_path", "locator"), ["code", "source_path"], KEPT["limitations"])
    kept_gaps, n_gaps = _some(gaps, ["source_path", "sheet"], KEPT["gaps"])
    limitations += kept_notes
    sizes = {n: df.count() for n, df in model.items()}
    entities = sum(sizes[n] for n in ENTITIES)
    present = {n: df for n, df in model.items() if sizes[n]}
    checkable = checked = 0
    if missing:
        checks = [{"id": i, "status": "needs_input", "parameters": {"reason": "missing_passport"}} for i in BLOCKED]
        findings, n_findings = [], 0
    else:
        run = audit(spark, present, own | told.trusted(trusted), mode, inventory=(n_items, n_notes + len(limitations) - len(kept_notes)))
        result = run.result(KEPT["findings"])
        checks, findings, n_findings = result["checks"], result["findings"], result["findings_total"]
        state = "not_applicable"
        if "rows" in present:
            states = rows.arithmetic(present["rows"]).groupBy("row_id").agg(F.min_by("status", rollup.ranked(F.col("status"), rollup.INPUT_FIRST)).alias("arithmetic"))
            open_ = rows.fields(present["rows"]).where("status = 'needs_input'").select("row_id", F.lit(True).alias("open")).distinct()
            done = spark.createDataFrame(list(attested.items()), "row_id string, completed array<string>")
            full = rollup.full_rows(states.join(open_, "row_id", "left").select("row_id", "arithmetic", F.coalesce("open", F.lit(False)).alias("fields_open")), done, told.DIMENSIONS)
            counts = {r["status"]: r["n"] for r in full.groupBy("status").agg(F.count("*").alias("n")).collect()}
            checkable, checked = sum(counts.values()), counts.get("passed", 0) if mode == "full" else 0
            state = "not_applicable" if not checkable else "limited" if mode == "light" else "passed" if checked == checkable else "needs_input" if counts.get("needs_input") else "limited"
            if mode == "full" and checked < checkable:
                limitations.append({"code": "full_row_controls_incomplete", "rows": checkable - checked, "source_path": "unknown", "locator": "unresolved-evidence"})
        checks.append({"id": "FULL-ROW-01", "status": state})
        missing = [f"check:{c['id']}" for c in checks if c["status"] == "needs_input" and c["id"] in BLOCKED]
        if missing:
            checks = [c | {"status": "needs_input"} if c["status"] == "passed" else c for c in checks]
        if n_items and not sizes["rows"]:
            limitations.append({"code": "no_estimate_rows_available", "source_path": kept_items[0]["path"], "locator": kept_items[0]["path"]})
        incomplete = [c["id"] for c in checks if c["id"] in rollup.MATRIX and c["status"] in ("limited", "needs_input")]
        if incomplete:  # the first item stands for the package as evidence
            first = kept_items[0]["path"] if kept_items else "unknown"
            limitations.append({"code": "light_macro_controls_incomplete" if mode == "light" else "full_control_matrix_incomplete", "control_ids": incomplete, "source_path": first, "locator": first})
    if n_gaps:
        limitations.append({"code": "unclassified_candidate_ranges", "source_path": kept_gaps[0]["source_path"], "locator": kept_gaps[0]["locator"]})
    hierarchy, n_hierarchy = _some(model["estimates"].select("estimate_id", "estimate_type", "parent_id", "declared_total", "source_path", "locator"), ["source_path", "locator", "estimate_id"], KEPT["estimate_hierarchy"])
    omitted = {n: total - kept for n, total, kept in (("findings", n_findings, len(findings)), ("limitations", n_notes, len(kept_notes)), ("input_inventory", n_items, len(kept_items)), ("estimate_hierarchy", n_hierarchy, len(hierarchy)), ("gaps", n_gaps, len(kept_gaps))) if total > kept}
    if omitted:
        limitations = [*limitations[: KEPT["limitations"]], {"code": "public_result_truncated", "omitted": omitted, "source_path": "unknown", "locator": "unresolved-evidence"}]
    unusable = bool(kept_items) and not items.where("extraction_status IN ('reliable', 'partial')").count()
    execution, overall, action = verdict(bool(missing), n_items, unusable, entities, sizes["rows"], any(f["severity"] in ("critical", "material") for f in findings), bool(limitations))
    out = {
        "schema_version": "ledgerlens.result.v1", "run_id": str(uuid.uuid4()), "mode": mode, "purpose": purpose, "execution_status": execution, "context": own, "input_inventory": kept_items,
        "coverage": {
            "row_level_checked": mode == "full" and checkable > 0 and checked == checkable and not n_gaps and not omitted, "sampling_strategy": "none", "extracted_records": sizes["rows"], "checkable_records": checkable, "checked_records": checked,
            "extracted_entities": entities, "unreadable_items": sum(i["extraction_status"] in ("failed", "rejected") for i in kept_items), "unclassified_candidate_ranges": kept_gaps,
        },
        "estimate_hierarchy": hierarchy, "checks": checks, "findings": findings, "questions": [question(missing)] if missing else [], "limitations": limitations, "normative_sources": [], "overall_status": overall, "recommended_action": action,
    }
    contract.validate(out)
    return out
