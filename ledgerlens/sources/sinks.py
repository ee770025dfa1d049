"""Sinks of the control plane: result documents, correction sidecars, corrected copies of workbooks."""

from __future__ import annotations

import hashlib
import io
import json
import os
import posixpath
import re
import zipfile
from decimal import Decimal, InvalidOperation
from xml.etree import ElementTree as ET

from ledgerlens.operators.formulas import split_cell
from ledgerlens.sources.workbooks import MAIN, REL, preflight

RESULT_BYTES, CORRECTIONS = 2_000_000, 1_000
# The contract of a correction request.
ID = re.compile(r"[A-Za-z0-9_.:-]{1,100}")
CELL = re.compile(r"[A-Za-z]{1,3}[1-9][0-9]{0,6}")
FIELDS = {"id", "status", "target", "expected_old", "replacement", "reason"}


class Rejected(ValueError):
    """The request, or one of its corrections, can't be applied; nothing is written."""


def create(path: str, data: bytes) -> None:
    """Writes a new file, readable by its owner only; never replaces one, and leaves nothing half-written."""
    part = f"{path}.{os.getpid()}.part"
    handle = os.open(part, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.link(part, path)
    finally:
        os.unlink(part)


def create_pair(first: tuple[str, bytes], second: tuple[str, bytes]) -> None:
    """Both files, or neither."""
    create(*first)
    try:
        create(*second)
    except BaseException:
        os.unlink(first[0])
        raise


def dump(value: dict) -> bytes:
    return (json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2, allow_nan=False) + "\n").encode()


def write_result(result: dict, path: str) -> None:
    data = dump(result)
    if len(data) > RESULT_BYTES:
        raise ValueError("the result is too large")
    create(path, data)


def _no_twins(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise Rejected("a key is repeated")
    return out


def _no_constant(name: str) -> None:
    raise Rejected(f"{name} is no number")


def parse_request(text: str) -> dict:
    """A valid request: source_sha256 and up to 1,000 corrections with distinct ids and targets of one kind."""
    try:
        spec = json.loads(text, object_pairs_hook=_no_twins, parse_constant=_no_constant)
    except json.JSONDecodeError as error:
        raise Rejected("the request is no JSON") from error
    if not isinstance(spec, dict) or set(spec) != {"schema_version", "source_sha256", "corrections"} or not re.fullmatch("[0-9a-f]{64}", str(spec["source_sha256"])):
        raise Rejected("the request's fields are wrong")
    items = spec["corrections"]
    if not isinstance(items, list) or not 1 <= len(items) <= CORRECTIONS:
        raise Rejected("the number of corrections is wrong")
    for c in items:
        if not isinstance(c, dict) or set(c) != FIELDS or not ID.fullmatch(str(c["id"])) or c["status"] not in ("confirmed", "disputed"):
            raise Rejected("a correction's fields are wrong")
        if not isinstance(c["reason"], str) or not 1 <= len(c["reason"]) <= 2000 or any(isinstance(c[k], (list, dict)) for k in ("expected_old", "replacement")):
            raise Rejected(f"{c['id']}: the values are wrong")
        t = c["target"]
        cell = isinstance(t, dict) and set(t) == {"sheet", "cell"} and 1 <= len(str(t["sheet"])) <= 31 and CELL.fullmatch(str(t["cell"]))
        if not cell and not (isinstance(t, dict) and set(t) == {"locator"} and 1 <= len(str(t["locator"])) <= 1024):
            raise Rejected(f"{c['id']}: the target is wrong")
        if isinstance(c["replacement"], str) and re.match(r"\s*[=+\-@]", c["replacement"]):
            raise Rejected(f"{c['id']}: the replacement is active content")
    for key in (lambda c: c["id"], lambda c: json.dumps(c["target"], sort_keys=True).casefold()):
        if len({key(c) for c in items}) != len(items):
            raise Rejected("an id or a target is repeated")
    return spec


def sidecar(content: bytes, spec: dict) -> bytes:
    """Proposals beside a source that isn't edited."""
    digest = hashlib.sha256(content).hexdigest()
    if digest != spec["source_sha256"]:
        raise Rejected("the source has changed")
    if any("locator" not in c["target"] for c in spec["corrections"]):
        raise Rejected("a target has no locator")
    return dump({"source_sha256": digest, "proposals": [c | {"applied": False} for c in spec["corrections"]], "limitations": [{"code": "source_format_not_modified_sidecar_only"}]})


def _equal(old: object, cell: ET.Element | None, shared: list[str]) -> bool:
    v = None if cell is None else cell.find(f"{MAIN}v")
    kind = "n" if cell is None else cell.get("t", "n")
    raw = "".join(t.text or "" for t in cell.iter(f"{MAIN}t")) if kind == "inlineStr" else None if v is None else v.text
    if raw is None:
        return old is None
    if kind == "s":
        return old == shared[int(raw)]
    if kind == "b":
        return isinstance(old, bool) and old == (raw == "1")
    if kind in ("str", "inlineStr"):
        return old == raw
    if not isinstance(old, (int, float)) or isinstance(old, bool):
        return False
    try:
        return Decimal(raw) == Decimal(str(old))
    except InvalidOperation:
        return False


_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
#: Elements of a sheet that come after its drawings.
_LATER = {"legacyDrawingHF", "picture", "oleObjects", "controls", "webPublishItems", "tableParts", "extLst"}
_SHAPE = '<v:shape id="{id}" type="#_x0000_t202" style="position:absolute;visibility:hidden" fillcolor="#ffffe1"><v:textbox/><x:ClientData ObjectType="Note"><x:Anchor>{col},0,{row},0,{right},0,{low},0</x:Anchor><x:Row>{row}</x:Row><x:Column>{col}</x:Column></x:ClientData></v:shape>'
_VML = '<xml xmlns:v="urn:schemas-microsoft-com:vml" xmlns:o="urn:schemas-microsoft-com:office:office" xmlns:x="urn:schemas-microsoft-com:office:excel"><v:shapetype id="_x0000_t202" coordsize="21600,21600" path="m,l,21600r21600,l21600,xe"/>'


def _commented(z: zipfile.ZipFile, part: str, root: ET.Element, notes: list[tuple[str, str]], number: int) -> dict[str, bytes]:
    """New parts of the workbook for notes (cell, text) on a sheet; the sheet's own root gets the drawing that shows them.

    A sheet that has comments already keeps them: the notes come after.
    """
    folder, _, leaf = part.rpartition("/")
    rels_name = f"{folder}/_rels/{leaf}.rels"
    rels = ET.fromstring(z.read(rels_name)) if rels_name in z.namelist() else ET.Element(f"{{{_RELS}}}Relationships")
    where = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(f"{folder}/{t}")
    has = {r.get("Type", "").rpartition("/")[2]: where(r.get("Target", "")) for r in rels}
    comments_name, vml_name = has.get("comments", f"xl/comments_notes{number}.xml"), has.get("vmlDrawing", f"xl/drawings/vmlDrawing_notes{number}.vml")
    comments = ET.fromstring(z.read(comments_name)) if "comments" in has else ET.Element(f"{MAIN}comments")
    authors = comments.find(f"{MAIN}authors")
    if authors is None:
        authors = ET.SubElement(comments, f"{MAIN}authors")
    ET.SubElement(authors, f"{MAIN}author").text = "ledgerlens"
    listed = comments.find(f"{MAIN}commentList")
    if listed is None:
        listed = ET.SubElement(comments, f"{MAIN}commentList")
    shapes = []
    for i, (cell, text) in enumerate(notes):
        note = ET.SubElement(listed, f"{MAIN}comment", {"ref": cell, "authorId": str(len(authors) - 1)})
        ET.SubElement(ET.SubElement(ET.SubElement(note, f"{MAIN}text"), f"{MAIN}r"), f"{MAIN}t").text = text
        row, col = split_cell(cell)
        shapes.append(_SHAPE.format(id=f"note{number}_{i}", row=row - 1, col=col - 1, right=col + 2, low=row + 3))
    old = z.read(vml_name).decode("utf-8") if "vmlDrawing" in has else f"{_VML}</xml>"
    cut = old.rindex("</xml>")
    for kind, name in (("comments", comments_name), ("vmlDrawing", vml_name)):
        if kind not in has:
            ET.SubElement(rels, f"{{{_RELS}}}Relationship", {"Id": f"rIdNotes{kind}", "Type": f"{_OFFICE}/{kind}", "Target": f"/{name}"})
    if "vmlDrawing" not in has:
        at = next((i for i, e in enumerate(root) if e.tag.removeprefix(MAIN) in _LATER), len(root))
        root.insert(at, ET.Element(f"{MAIN}legacyDrawing", {f"{REL}id": "rIdNotesvmlDrawing"}))
    write = lambda e: ET.tostring(e, encoding="UTF-8", xml_declaration=True)
    return {rels_name: write(rels), comments_name: write(comments), vml_name: (old[:cut] + "".join(shapes) + old[cut:]).encode()}


def _typed(z: zipfile.ZipFile, names: list[str]) -> bytes:
    """[Content_Types].xml with the types of new parts."""
    name = "[Content_Types].xml"
    types = ET.fromstring(z.read(name)) if name in z.namelist() else ET.Element(f"{{{_TYPES}}}Types")
    known = {e.get("Extension", "").lower() for e in types} | {e.get("PartName") for e in types}
    if "vml" not in known:
        types.insert(0, ET.Element(f"{{{_TYPES}}}Default", {"Extension": "vml", "ContentType": "application/vnd.openxmlformats-officedocument.vmlDrawing"}))
    for n in names:
        if n.endswith(".xml") and "/comments" in n and f"/{n}" not in known:
            ET.SubElement(types, f"{{{_TYPES}}}Override", {"PartName": f"/{n}", "ContentType": "application/vnd.openxmlformats-officedocument.spreadsheetml.comments+xml"})
    return ET.tostring(types, encoding="UTF-8", xml_declaration=True)


def corrected_workbook(content: bytes, spec: dict) -> tuple[bytes, dict]:
    """A copy with confirmed replacements, and its change log. Any stale value, missing sheet or formula cell rejects all.

    Only the sheets' cells are patched; every other part is copied as it is. Disputed corrections become comments on their cells.
    """
    if hashlib.sha256(content).hexdigest() != spec["source_sha256"]:
        raise Rejected("the source has changed")
    z = preflight(content)
    book, rels = ET.fromstring(z.read("xl/workbook.xml")), ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    targets = {r.get("Id"): r.get("Target", "") for r in rels}
    parts = {s.get("name"): (t.lstrip("/") if (t := targets.get(s.get(f"{REL}id"), "")).startswith("/") else f"xl/{t}") for s in book.iter(f"{MAIN}sheet")}
    shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    roots: dict[str, ET.Element] = {}
    notes: dict[str, list[tuple[str, str]]] = {}
    log = []
    for c in spec["corrections"]:
        t = c["target"]
        if t.get("sheet") not in parts:
            raise Rejected(f"{c['id']}: no such sheet")
        part = parts[t["sheet"]]
        root = roots.setdefault(part, ET.fromstring(z.read(part)))
        cell = next((x for x in root.iter(f"{MAIN}c") if x.get("r") == t["cell"].upper()), None)
        if cell is None or cell.find(f"{MAIN}f") is not None or not _equal(c["expected_old"], cell, shared):
            raise Rejected(f"{c['id']}: the cell isn't as expected")
        if c["status"] == "confirmed":
            for child in list(cell):
                cell.remove(child)
            new = c["replacement"]
            cell.attrib.pop("t", None)
            if isinstance(new, str):
                cell.set("t", "inlineStr")
                ET.SubElement(ET.SubElement(cell, f"{MAIN}is"), f"{MAIN}t").text = new
            elif new is not None:
                if isinstance(new, bool):
                    cell.set("t", "b")
                ET.SubElement(cell, f"{MAIN}v").text = str(int(new)) if isinstance(new, bool) else repr(new)
        else:
            notes.setdefault(part, []).append((t["cell"].upper(), f"{c['id']}: {c['reason']} -> {c['replacement']}"))
        log.append({"id": c["id"], "action": "replaced" if c["status"] == "confirmed" else "commented", "target": t, "old_value": c["expected_old"], "new_value": c["replacement"], "reason": c["reason"]})
    made: dict[str, bytes] = {}
    for number, (part, own) in enumerate(notes.items(), 1):
        made |= _commented(z, part, roots[part], own, number)
    if made:
        made["[Content_Types].xml"] = _typed(z, list(made))
    made |= {n: ET.tostring(r, encoding="UTF-8", xml_declaration=True) for n, r in roots.items()}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        for name in dict.fromkeys([*z.namelist(), *made]):
            w.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), made[name] if name in made else z.read(name), zipfile.ZIP_DEFLATED)
    data = out.getvalue()
    return data, {"source_sha256_before": spec["source_sha256"], "output_sha256": hashlib.sha256(data).hexdigest(), "changes": log}
