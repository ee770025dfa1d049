"""XML documents as rows: elements and values with XPaths, and semantic records by path rules."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterator
from functools import reduce
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.coords import plain_xpath

MAX_BYTES, MAX_DEPTH, MAX_NODES, MAX_TEXT = 20 << 20, 128, 200_000, 2_000_000
KINDS = ("element", "text", "attribute")
SCHEMA = "source_path string, kind string, xpath string, owner string, local_name string, line int, raw_value string, code string"
_FORBIDDEN = re.compile(rb"<!\s*(DOCTYPE|ENTITY)", re.IGNORECASE)


class Refused(ValueError):
    """The document isn't read; the message is a code."""


def parse(content: bytes, kinds: Collection[str] = KINDS) -> list[tuple]:
    """Elements, leaf texts and attributes as (kind, xpath, owner, local_name, line, raw_value), those of `kinds`, in the document's order.

    An XPath has a position only where a tag repeats among siblings. Document types and entities are refused
    before parsing, and limits hold while parsing.
    """
    if len(content) > MAX_BYTES:
        raise Refused("xml_limit_exceeded")
    if _FORBIDDEN.search(content):
        raise Refused("xml_dtd_forbidden")
    parser = expat.ParserCreate()
    parser.buffer_text, parser.ordered_attributes = True, True
    stack: list[list] = []
    root: list[list] = []
    nodes = length = 0

    def start(tag: str, attributes: list[str]) -> None:
        nonlocal nodes
        nodes += 1
        if nodes > MAX_NODES or len(stack) >= MAX_DEPTH:
            raise Refused("xml_limit_exceeded")
        node = [tag, parser.CurrentLineNumber, attributes, [], []]  # the last two are texts and children
        (stack[-1][4] if stack else root).append(node)
        stack.append(node)

    def text(data: str) -> None:
        nonlocal length
        length += len(data)
        if length > MAX_TEXT:
            raise Refused("xml_limit_exceeded")
        stack[-1][3].append(data)

    parser.StartElementHandler, parser.CharacterDataHandler = start, text
    parser.EndElementHandler = lambda tag: stack.pop()
    try:
        parser.Parse(content, True)
    except expat.ExpatError as error:
        raise Refused("xml_parse_error") from error
    elements, texts, attributed = (k in kinds for k in ("element", "text", "attribute"))
    out: list[tuple] = []
    todo = [(root[0], f"/{root[0][0]}", "")]
    while todo:
        (tag, line, attributes, said, children), path, owner = todo.pop()
        if attributes and attributed:
            for name, value in zip(attributes[::2], attributes[1::2], strict=True):
                if name != "xmlns" and not name.startswith("xmlns:"):
                    out.append(("attribute", f"{path}/@{name}", path, name.rpartition(":")[2], line, value))
        local = tag.rpartition(":")[2]
        if texts and said and not children and (value := "".join(said).strip()):
            out.append(("text", path, owner, local, line, value))
        if elements:
            out.append(("element", path, owner, local, line, None))
        if children:
            same = Counter([c[0] for c in children])
            if len(same) == len(children):
                todo += [(c, f"{path}/{c[0]}", path) for c in reversed(children)]
            else:
                seen = dict.fromkeys(same, 0)
                placed = []
                for c in children:
                    seen[c[0]] += 1
                    placed.append((c, f"{path}/{c[0]}[{seen[c[0]]}]" if same[c[0]] > 1 else f"{path}/{c[0]}", path))
                todo += reversed(placed)
    return out


# Values that may stand for one another: whole text up to the next tag, and attributes in double quotes, without references, line ends and other control characters.
_VALUE = re.compile("((?<=>)[^<&>\x00-\x1f\ufffe-\U0010ffff]+(?=<)|(?<==\")[^\"<&\x00-\x1f\ufffe-\U0010ffff]*(?=\"))")
_PROLOG = re.compile(r"""\ufeff?<\?xml version="1\.0"(?: encoding="(?:UTF-8|utf-8)")?(?: standalone="(?:yes|no)")?\s*\?>""")
_MARK = "\ue000"
#: Layouts a worker keeps, and the size of documents up to which they are; others are parsed.
LAYOUTS, LAYOUT_BYTES = 2048, 16 << 10


def _layout(head: str, parts: list[str], kinds: Collection[str]) -> tuple | None:
    """What parse gives for any document that differs in its values only: its columns, and for each row the value's place in parts.

    None if that can't be said: the layout has comments, sections, instructions or single quotes, a value is only part of a text, or
    there is an error. The layout is parsed with marks in the places of its values, so its tags are checked by the parser.
    """
    fixed = "".join(parts[::2])
    if (head and not _PROLOG.fullmatch(head)) or any(c in fixed for c in ("<!", "<?", "'", "\x00", _MARK)):
        return None
    marked = [f"{_MARK}{i}{_MARK}" if i % 2 else part for i, part in enumerate(parts)]
    try:
        rows = parse((head + "".join(marked)).encode(), kinds)
    except Refused:
        return None
    places, texts = [], []
    for n, row in enumerate(rows):
        m = re.fullmatch(f"{_MARK}([0-9]+){_MARK}", row[5] or "")
        if m is None and row[5] is not None:
            return None
        places.append(int(m[1]) if m else -1)
        if m and row[0] == "text":
            texts.append(n)
    return ([list(c) for c in zip(*rows, strict=True)][:5] or [[]] * 5), places, texts


class Reader:
    """Columns of many documents; those of a layout met before take its paths and names from there."""

    def __init__(self, kinds: Collection[str] = KINDS):
        self.kinds, self.layouts = kinds, {}

    def columns(self, content: bytes) -> tuple[list[list], list]:
        """(kind, xpath, owner, local_name, line) and raw_value, as parse has them."""
        if len(content) <= LAYOUT_BYTES:
            try:
                text = content.decode()
            except UnicodeDecodeError:
                text = ""
            at = text.find("?>") + 2 if text[:6].removeprefix("\ufeff").startswith("<?xml") else 0
            head, parts = text[:at], _VALUE.split(text[at:])
            key = (head, *parts[::2])
            if key in self.layouts:
                known = self.layouts[key]
            else:
                known = None
                if len(self.layouts) < LAYOUTS:
                    known = self.layouts[key] = _layout(head, parts, self.kinds)
            if known:
                fixed, places, texts = known
                parts.append(None)  # at -1, for rows without a value
                values = [parts[i] for i in places]
                for n in texts:
                    values[n] = values[n].strip()
                if all(values[n] for n in texts):
                    return fixed, values
        rows = [list(c) for c in zip(*parse(content, self.kinds), strict=True)] or [[]] * 6
        return rows[:5], rows[5]


def values(files: DataFrame, kinds: Collection[str] = KINDS) -> DataFrame:
    """Rows as SCHEMA for each element, leaf text and attribute of files (path, content), those of `kinds`; refused files give one row with a code."""
    columns = [("kind", pa.string()), ("xpath", pa.string()), ("owner", pa.string()), ("local_name", pa.string()), ("line", pa.int32()), ("raw_value", pa.string())]
    kind = pa.schema([("source_path", pa.string()), *columns, ("code", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(kinds)
        paths: list[str | None] = []
        rows: list[list] = [[] for _ in columns]
        refused: list[dict] = []

        def packed() -> Iterator[pa.RecordBatch]:
            if paths:
                made = [pa.array(c, k) for c, (_, k) in zip(rows, columns, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *made, pa.nulls(len(paths), pa.string())], schema=kind)
            if refused:
                yield pa.RecordBatch.from_pylist(refused, kind)
            for held in (paths, refused, *rows):
                held.clear()

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    fixed, found = reader.columns(content or b"")
                except Refused as error:
                    refused.append({"source_path": path, "kind": "error", "code": str(error)})
                else:
                    for held, more in zip(rows, (*fixed, found), strict=True):
                        held += more
                    paths += [path] * len(found)
                if len(paths) + len(refused) >= 8192:
                    yield from packed()
        yield from packed()

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, SCHEMA)


def typed(local_name: Column, raw: Column) -> Column:
    """date, datetime, integer, decimal or text, from the lexical form; names of identifiers stay text."""
    identifier = F.lower(local_name).rlike("id|code|version|guid|uuid|cipher")
    few = (F.length(raw) <= 15) | (F.length(F.regexp_replace(F.regexp_replace(raw, "[^0-9]", ""), "^0+", "")) <= 15)
    number = raw.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$") & few
    date = raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & raw.try_cast("date").isNotNull()
    moment = raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T") & raw.try_cast("timestamp").isNotNull()
    return F.when(date, "date").when(moment, "datetime").when(identifier | ~number, "text").when(raw.contains("."), "decimal").otherwise("integer")


#: Rows of a caller's rules, mapping or registry up to which they are broadcast; more are joined by shuffle.
BROADCAST_RULES = 100_000


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else rows


#: Rules up to which patterns are compiled once; a pattern that comes with a row is compiled for each.
LITERAL_RULES = 256


def _fitting(found: DataFrame, path: Column, rules: DataFrame) -> DataFrame:
    """found once for each rule of its schema whose pattern fits path without positions, with the rule's other columns."""
    found = found.withColumn("plain", plain_xpath(path))
    few = rules.limit(LITERAL_RULES + 1).collect()
    if not 0 < len(few) <= LITERAL_RULES or not all(r["schema_id"] and r["pattern"] for r in few):
        return found.join(_small(rules), "schema_id").where(F.expr("plain rlike concat('^(?:', pattern, ')$')")).drop("plain", "pattern")
    others = [f for f in rules.schema if f.name not in ("schema_id", "pattern")]
    by_schema: dict[str, list[Column]] = {}
    for r in few:
        made = F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in others])
        by_schema.setdefault(r["schema_id"], []).append(F.when(F.col("plain").rlike(f"^(?:{r['pattern']})$"), made))
    fit = reduce(lambda rest, kv: F.when(F.col("schema_id") == kv[0], F.array(*kv[1])).otherwise(rest), by_schema.items(), F.lit(None))
    return found.select("*", F.explode(F.array_compact(fit)).alias("plain_fit")).select(*found.drop("plain").columns, *[F.col("plain_fit")[f.name].alias(f.name) for f in others])


def anchors(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Elements of found that a rule matches: rules (rule, schema_id, pattern) on found (schema_id, xpath, ...).

    The schema must be equal, and the path without positions fit the pattern.
    """
    return _fitting(found.where("kind = 'element'"), F.col("xpath"), rules)


def direct_fields(anchored: DataFrame, found: DataFrame) -> DataFrame:
    """Values of each anchor: its own text and attributes, and its children's texts. An equality join on the owner's path."""
    leaves = found.where("kind <> 'element' AND code IS NULL").select("source_path", F.col("owner").alias("anchor"), "kind", "local_name", F.col("xpath").alias("value_xpath"), "raw_value")
    return anchored.select("source_path", F.col("xpath").alias("anchor"), "rule").join(leaves, ["source_path", "anchor"])


def owned_fields(found: DataFrame, rules: DataFrame) -> DataFrame:
    """What direct_fields gives for the anchors of the rules, in one pass: a value's owner is an anchor if its path fits a rule."""
    fit = _fitting(found.where("kind <> 'element' AND code IS NULL"), F.col("owner"), rules)
    return fit.select("source_path", F.col("owner").alias("anchor"), "rule", "kind", "local_name", F.col("xpath").alias("value_xpath"), "raw_value")


def mapped(fields: DataFrame, mapping: DataFrame) -> DataFrame:
    """(source_path, anchor, field, value): of several candidates, mode `first` takes the least ordinal that isn't blank, `unique` only a single one.

    mapping (rule, local_name, field, ordinal, mode) has a few dozen rows.
    """
    joined = fields.join(_small(mapping), ["rule", "local_name"]).where("raw_value IS NOT NULL AND trim(raw_value) <> ''")
    joined = joined.repartition("source_path")  # groups hold a value or two, so counting them ahead of the shuffle saves nothing
    per = joined.groupBy("source_path", "anchor", "field").agg(F.min_by("raw_value", "ordinal").alias("value"), F.count("*").alias("n"), F.max("mode").alias("mode"))
    return per.where("mode = 'first' OR n = 1").select("source_path", "anchor", "field", "value")


def matching_schemas(roots: DataFrame, registry: DataFrame) -> DataFrame:
    """Roots (path, root, namespace, extension) with the schemas of registry (schema_id, root, namespace, extensions) that fit."""
    return roots.join(_small(registry), (roots["root"] == registry["root"]) & roots["namespace"].eqNullSafe(registry["namespace"])).where(F.array_contains("extensions", F.col("extension"))).select("path", "schema_id")


# Document types by part of the schema id; the first that fits counts.
DOCUMENT_TYPES = {
    "local_estimate": "LSR",
    "object_estimate": "OSR",
    "summary_estimate": "SSR",
    "object_or_summary_estimate": "OSR_OR_SSR",
    "costs_summary": "COSTS_SUMMARY",
    "quantity_takeoff": "VOR",
    "market_analysis": "KAC",
    "contract_estimate": "CONTRACT_ESTIMATE",
    "explanatory_note": "EXPLANATORY_NOTE",
}


def document_type(schema_id: Column) -> Column:
    out = F.lit(None).cast("string")
    for part, kind in reversed(DOCUMENT_TYPES.items()):
        out = F.when(schema_id.contains(part), kind).otherwise(out)
    return out


def mapped_paths(anchored: DataFrame, found: DataFrame, mapping: DataFrame) -> DataFrame:
    """(source_path, anchor, rule, field, value): like `mapped`, for values at paths below the anchor.

    mapping (rule, path, field, ordinal, mode): a path is relative, `.` the anchor itself, `@x` its attribute.
    Wanted paths are computed per anchor, then met with the values by equality.
    """
    at = F.when(F.col("path") == ".", F.col("xpath")).otherwise(F.concat_ws("/", "xpath", "path"))
    wanted = anchored.join(_small(mapping), "rule").select("source_path", F.col("xpath").alias("anchor"), "rule", "field", "ordinal", "mode", at.alias("value_xpath"))
    leaves = found.where("kind <> 'element' AND trim(raw_value) <> ''").select("source_path", F.col("xpath").alias("value_xpath"), "raw_value")
    per = wanted.join(leaves, ["source_path", "value_xpath"]).groupBy("source_path", "anchor", "rule", "field").agg(F.min_by("raw_value", "ordinal").alias("value"), F.count("*").alias("n"), F.max("mode").alias("mode"))
    return per.where("mode = 'first' OR n = 1").select("source_path", "anchor", "rule", "field", "value")
