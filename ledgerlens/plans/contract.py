"""The contract of a result document: a small schema language, the schema of results, and rules across fields."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

TYPES: dict[str, Callable[[object], bool]] = {
    "object": lambda x: isinstance(x, dict),
    "array": lambda x: isinstance(x, list),
    "string": lambda x: isinstance(x, str),
    "boolean": lambda x: isinstance(x, bool),
    "null": lambda x: x is None,
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x),
}
#: Faults that an error tells of.
TOLD = 20


class Invalid(ValueError):
    """The document breaks the contract."""


def _uri(x: str) -> bool:
    parts = urlsplit(x)
    return bool(parts.scheme) and (parts.scheme not in ("http", "https") or bool(parts.netloc))


#: By keyword: for what values it holds, and whether one fits.
SIMPLE: dict[str, tuple[str, Callable[[object, object], bool]]] = {
    "minLength": ("string", lambda x, n: len(x) >= n),
    "maxLength": ("string", lambda x, n: len(x) <= n),
    "pattern": ("string", lambda x, p: re.search(p, x) is not None),
    "format": ("string", lambda x, f: f != "uri" or _uri(x)),
    "minimum": ("number", lambda x, n: x >= n),
    "minItems": ("array", lambda x, n: len(x) >= n),
    "maxItems": ("array", lambda x, n: len(x) <= n),
    "required": ("object", lambda x, names: all(n in x for n in names)),
}


def faults(value: object, schema: dict, root: dict | None = None, at: str = "$") -> Iterator[str]:
    """What of value breaks the schema, as `path: keyword`. Documents and schemas may nest as deep as they like."""
    root = root or schema
    todo = [(value, schema, at)]
    while todo:
        x, rule, where = todo.pop()
        while "$ref" in rule:
            if not rule["$ref"].startswith("#/"):
                raise Invalid("a reference leads out of the schema")
            found: object = root
            for step in rule["$ref"][2:].split("/"):
                found = found[step.replace("~1", "/").replace("~0", "~")]
            rule = found
        kinds = rule.get("type", [])
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if kinds and not any(TYPES[k](x) for k in kinds):
            yield f"{where}: type"
            continue
        if "const" in rule and (x != rule["const"] or isinstance(x, bool) != isinstance(rule["const"], bool)):
            yield f"{where}: const"
        if "enum" in rule and x not in rule["enum"]:
            yield f"{where}: enum"
        for word, (kind, fits) in SIMPLE.items():
            if word in rule and TYPES[kind](x) and not fits(x, rule[word]):
                yield f"{where}: {word}"
        if isinstance(x, dict):
            known = rule.get("properties", {})
            if rule.get("additionalProperties") is False and x.keys() - known.keys():
                yield f"{where}: additionalProperties"
            todo += [(x[n], known[n], f"{where}.{n}") for n in x if n in known]
        elif isinstance(x, list) and "items" in rule:
            todo += [(y, rule["items"], f"{where}[{i}]") for i, y in enumerate(x)]
        for branch in rule.get("allOf", []):
            if "if" not in branch:
                todo.append((x, branch, where))
            else:
                todo.append((x, branch.get("then" if fits_schema(x, branch["if"], root) else "else", {}), where))
        if "oneOf" in rule and sum(fits_schema(x, r, root) for r in rule["oneOf"]) != 1:
            yield f"{where}: oneOf"


def fits_schema(value: object, schema: dict, root: dict | None = None) -> bool:
    return next(faults(value, schema, root), None) is None


# The states, severities and modes that a result may have, and the parts of one.
STATUSES = ["passed", "finding", "not_applicable", "needs_input", "limited"]
EXECUTIONS = ["completed", "completed_with_limits", "needs_input", "failed"]
VERDICTS = ["verified_in_checked_scope", "needs_clarification", "material_nonconformities", "verification_impossible"]
EXTRACTIONS = ["reliable", "partial", "failed", "rejected", "not_inspected"]
SEVERITIES = ["critical", "material", "recommendation"]

_TEXT, _COUNT, _LIST = {"type": "string", "minLength": 1}, {"type": "integer", "minimum": 0}, {"type": "array"}
RESULT = {
    "type": "object",
    "required": ["schema_version", "run_id", "mode", "purpose", "execution_status", "context", "input_inventory", "coverage", "checks", "findings", "questions", "limitations", "overall_status", "recommended_action"],
    "properties": {
        "schema_version": _TEXT, "run_id": _TEXT, "mode": {"enum": ["light", "full"]}, "purpose": {"type": ["string", "null"]}, "execution_status": {"enum": EXECUTIONS}, "context": {"type": "object"},
        "input_inventory": {"type": "array", "maxItems": 2001, "items": {"type": "object", "required": ["path", "size_bytes", "sha256", "extraction_status"], "properties": {"path": _TEXT, "size_bytes": _COUNT, "sha256": {"type": ["string", "null"], "pattern": "^[0-9a-f]{64}$"}, "extraction_status": {"enum": EXTRACTIONS}}}},
        "coverage": {"type": "object", "required": ["row_level_checked", "checkable_records", "checked_records"], "properties": {"row_level_checked": {"type": "boolean"}, "checkable_records": _COUNT, "checked_records": _COUNT, "unclassified_candidate_ranges": _LIST}},
        "checks": {"type": "array", "items": {"$ref": "#/definitions/check"}}, "findings": {"type": "array", "maxItems": 1000, "items": {"$ref": "#/definitions/finding"}},
        "questions": {"type": "array", "maxItems": 1, "items": {"type": "object", "required": ["id", "missing_fields"], "properties": {"missing_fields": {"type": "array", "minItems": 1, "items": _TEXT}}}},
        "limitations": {"type": "array", "maxItems": 1000, "items": {"type": "object", "required": ["code"], "properties": {"code": _TEXT}}},
        "overall_status": {"enum": VERDICTS}, "recommended_action": _TEXT,
    },
    "allOf": [{"if": {"properties": {"execution_status": {"const": "needs_input"}}}, "then": {"properties": {"overall_status": {"const": "needs_clarification"}, "questions": {"minItems": 1}}}}],
    "definitions": {
        "check": {"type": "object", "required": ["id", "status"], "properties": {"id": _TEXT, "status": {"enum": STATUSES}}},
        "finding": {"type": "object", "required": ["id", "severity"], "properties": {"id": _TEXT, "severity": {"enum": SEVERITIES}, "source_ids": {"type": "array", "items": _TEXT}}},
    },
}


def _numbers(value: object) -> Iterator[str]:
    todo = [(value, "$")]
    while todo:
        x, at = todo.pop()
        if isinstance(x, float) and not math.isfinite(x):
            yield f"{at}: number"
        todo += [(y, f"{at}.{k}") for k, y in x.items()] if isinstance(x, dict) else [(y, f"{at}[{i}]") for i, y in enumerate(x)] if isinstance(x, list) else []


def _across(result: dict) -> Iterator[str]:
    """Rules that hold between the parts of a result."""
    c, checks = result["coverage"], result["checks"]
    if c["checked_records"] > c["checkable_records"] or (result["mode"] == "light" and c["checked_records"]):
        yield "$.coverage.checked_records"
    if c["row_level_checked"] and (result["mode"] != "full" or not c["checkable_records"] or c["checked_records"] != c["checkable_records"] or c.get("unclassified_candidate_ranges")):
        yield "$.coverage.row_level_checked"
    if result["execution_status"] == "needs_input" and any(x["status"] == "passed" for x in checks):
        yield "$.checks: passed beside a question"
    sources = [s for s in result.get("normative_sources", []) if isinstance(s, dict)]
    by_id = {str(s.get("id")): s for s in sources}
    if len(by_id) != len(sources):
        yield "$.normative_sources: repeated id"
    for s in sources:
        web = isinstance(s.get("official_url"), str) and s["official_url"].startswith(("http://", "https://")) and _uri(s["official_url"])
        if not str(s.get("edition") or "").strip() or not str(s.get("pinpoint") or "").strip() or not (web or s.get("class") == "internal"):
            yield f"$.normative_sources: {s.get('id')}"
    for f in result["findings"]:
        ids = [str(i) for i in f.get("source_ids", [])]
        cites = f.get("source_citations", [])
        if len(set(ids)) != len(ids) or not set(ids) <= by_id.keys() or [str(x.get("source_id")) for x in cites] != ids:
            yield f"$.findings: sources of {f['id']}"
        elif any(x.get(k) != by_id[str(x["source_id"])].get(k) for x in cites for k in ("edition", "pinpoint", "official_url")):
            yield f"$.findings: citations of {f['id']}"
    if any("INT-01" in f.get("source_ids", []) for f in result["findings"]) and (by_id.get("INT-01", {}).get("class"), by_id.get("INT-01", {}).get("normativity")) != ("internal", "non_normative"):
        yield "$.normative_sources: INT-01"


def validate(result: dict) -> None:
    """Raises Invalid, with the first TOLD faults, unless the result keeps the contract."""
    found = [*_numbers(result), *faults(result, RESULT)]
    found = found or list(_across(result))
    if found:
        raise Invalid("; ".join(found[:TOLD]))
