"""What a caller tells of a run: mode, purpose and context, with the limits that untrusted input must keep."""

from __future__ import annotations

import json
import math
import os
import stat

# Fields that a caller may not set, what trusted callers may add, the controls that complete a row, and limits.
RESERVED = {"xml_schema_registry", "semantic_records", "canonical_records", "full_row_coverage"}
TRUSTED = {"vat", "contract_change", "normative_sources_verified"}
DIMENSIONS = ["arithmetic", "fields", "indices_coefficients", "interdocument", "rate_norm", "resources", "volume_source"]
TEXT_FIELDS = ["object", "work_type", "funding_source", "region_or_price_zone", "price_level_date", "calculation_method", "stage"]
PURPOSE, BYTES, DEPTH, NODES, TEXT = 256, 1 << 20, 32, 20_000, 200_000


class Refused(ValueError):
    """The input can't be used; the message says why."""


def check_json(value: object) -> None:
    """Raises Refused unless value is plain JSON of bounded depth, size and text length."""
    todo, nodes = [(value, 0)], 0
    while todo:
        x, depth = todo.pop()
        nodes += 1
        if nodes > NODES or depth > DEPTH:
            raise Refused("the context is too large")
        if isinstance(x, dict):
            if not all(isinstance(k, str) and len(k) <= TEXT for k in x):
                raise Refused("a key is no text, or too long")
            todo += [(y, depth + 1) for y in x.values()]
        elif isinstance(x, list):
            todo += [(y, depth + 1) for y in x]
        elif isinstance(x, str):
            if len(x) > TEXT:
                raise Refused("a text is too long")
        elif not (x is None or isinstance(x, (bool, int)) or (isinstance(x, float) and math.isfinite(x))):
            raise Refused("a value is no JSON")


def read(path: str) -> dict:
    """The context in a file: a regular file of limited size, no link, that holds one JSON object."""
    before = os.lstat(path)
    if not stat.S_ISREG(before.st_mode):
        raise Refused("the context must be a regular file")
    with open(os.open(path, os.O_RDONLY | os.O_NOFOLLOW), "rb") as f:
        now = os.fstat(f.fileno())
        if (now.st_dev, now.st_ino) != (before.st_dev, before.st_ino):
            raise Refused("the context was replaced")
        data = f.read(BYTES + 1)
    if len(data) > BYTES:
        raise Refused("the context is too large")
    try:
        value = json.loads(data)
    except ValueError as error:
        raise Refused("the context is no JSON") from error
    if not isinstance(value, dict):
        raise Refused("the context must be an object")
    return value


def merged(context: dict, flags: dict) -> dict:
    """context, with what was given as flags in its place."""
    return context | {k: v for k, v in flags.items() if v is not None}


def public(mode: str, purpose: str | None, context: dict | None) -> dict:
    """The context of a run, checked."""
    if mode not in ("light", "full"):
        raise Refused("the mode must be light or full")
    if purpose is not None and (not isinstance(purpose, str) or len(purpose) > PURPOSE or any(ord(c) < 32 for c in purpose)):
        raise Refused("the purpose is invalid")
    own = {} if context is None else context
    if not isinstance(own, dict) or RESERVED & own.keys() or any(str(k).startswith("_trusted") for k in own):
        raise Refused("the context has reserved fields")
    check_json(own)
    if len(json.dumps(own, ensure_ascii=False).encode()) > BYTES:
        raise Refused("the context is too large")
    documents = own.get("document_set")
    if not (documents is None or isinstance(documents, str) or (isinstance(documents, list) and all(isinstance(d, str) and d for d in documents))):
        raise Refused("document_set must be a text or a list of texts")
    if wrong := [k for k in TEXT_FIELDS if own.get(k) is not None and not isinstance(own[k], str)]:
        raise Refused(f"{wrong[0]} must be a text")
    return dict(own)


def trusted(added: dict | None) -> dict:
    """What only a trusted caller adds to the context."""
    own = {} if added is None else added
    if not isinstance(own, dict) or not own.keys() <= TRUSTED:
        raise Refused("trusted fields are unknown")
    check_json(own)
    return dict(own)


def attestations(coverage: dict | None) -> dict[str, list[str]]:
    """Completed dimensions by row id: each attestation needs known dimensions and evidence with a source and a locator."""
    out = {}
    check_json({} if coverage is None else coverage)
    for row, told in (coverage or {}).items():
        done = told.get("completed_dimensions") if isinstance(told, dict) else None
        shown = told.get("evidence") if isinstance(told, dict) else None
        placed = isinstance(shown, list) and shown and all(isinstance(e, dict) and all(isinstance(e.get(k), str) and e[k].strip() for k in ("source_path", "locator")) for e in shown)
        if not row or not placed or not isinstance(done, list) or not set(map(str, done)) <= set(DIMENSIONS):
            raise Refused("an attestation is incomplete")
        out[row] = sorted(set(done))
    return out
