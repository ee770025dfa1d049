"""Personal data: base patterns, and identifiers that bootstrapped contexts discover. DataFrame functions only.

Base spans seed the discovery. The words around each seed make lexical patterns; a pattern-instance graph of
distinct values is scored in rounds: a pattern's confidence is the share of its values that are known to be of
one kind, an unknown value's score is the chance that not all its patterns are wrong, and values of high score
join the known ones. Only runs of tokens with digits can be discovered.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import free, lower_ascii, saved, table

KINDS = ("email", "ip", "card", "phone")
# Each finds what the plain pattern finds, leftmost and non-overlapping, but in linear time and without
# recursion: runs are possessive, and a match starts at the start of its run or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Only runs of 12 to 19 digits: others would be dropped. A run that is longer has no match within it.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?"  # zeros alone are a part, too
CANDIDATE = r"(?<!\S)[^\s0-9]*+[0-9]\S*+(?:\x20[^\s0-9]*+[0-9]\S*+)*+"
#: Code points of context on each side; part of the patterns' definition.
AROUND = 48
SUPPORT, CONFIDENCE, ACCEPTED = 3, 0.8, 0.95
SPAN, ITEM = "struct<start:int,kind:int,end:int>", "struct<gap:string,hit:string>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    digits = F.transform(F.split(F.reverse(_digits(m)), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    return F.aggregate(F.transform(digits, lambda d, i: F.when(i % 2 == 1, twice(d)).otherwise(d)), F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: int, m: Column) -> Column:
    n = F.length(_digits(m))
    return [F.lit(True), m.rlike(rf"^(?:{PART}\.){{3}}{PART}$"), n.between(12, 19) & _luhn(m), n.between(9, 15)][kind]


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def in_order(items: Column, kind: str, start: Column, step) -> Column:
    """The spans that step(state, item) -> (state, span or null) keeps of items of that kind, from the left.

    A fold that appends to one array copies it each time; here a block of items is folded into an array of its own,
    as many blocks as a block has items, so n items cost n times the root of n at most.
    """
    size = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(items))).cast("int"))
    blocks = F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), ((F.size(items) - 1) / size).cast("int")), lambda b: F.slice(items, b * size + 1, size))).otherwise(F.array().cast(f"array<array<{kind}>>"))
    none = F.array().cast(f"array<{SPAN}>")

    def one(a: Column, x: Column) -> Column:
        return _bound(step(a["state"], x), lambda r: F.struct(r["state"].alias("state"), F.when(r["kept"].isNotNull(), F.array_append(a["out"], r["kept"])).otherwise(a["out"]).alias("out")))

    def some(a: Column, block: Column) -> Column:
        return _bound(F.aggregate(block, F.struct(a["state"].alias("state"), none.alias("out")), one), lambda r: F.struct(r["state"].alias("state"), F.array_append(a["out"], r["out"]).alias("out")))

    return F.flatten(F.aggregate(blocks, F.struct(start.alias("state"), F.array().cast(f"array<array<{SPAN}>>").alias("out")), some)["out"])


def matches(text: Column, pattern: str, kind: int, valid: bool = True) -> Column:
    """Spans (start, kind, end) in code points of the pattern's valid matches, in order."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def step(at: Column, x: Column) -> Column:
        start = at + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        good = x["hit"].isNotNull() & (_valid(kind, x["hit"]) if valid else F.lit(True))
        return F.struct(end.alias("state"), F.when(good, F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))).alias("kept"))

    return _bound(both, lambda b: in_order(b, ITEM, F.lit(0), step))


def base_spans(text: Column) -> Column:
    """Base spans of all kinds by start, then kind. Texts without @, + or digits are not searched."""
    none = F.array().cast(f"array<{SPAN}>")
    gates = [text.contains("@"), text.rlike(r"[0-9]\.[0-9]"), text.rlike(CARD), text.contains("+")]
    found = [F.when(g, matches(text, p, k)).otherwise(none) for k, (g, p) in enumerate(zip(gates, (EMAIL, IP, CARD, PHONE), strict=True))]
    return F.array_sort(F.concat(*found))


def _words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), r"\s+"), lambda w: w != "")


def patterns(text: Column, start: Column, end: Column) -> Column:
    """Lexical patterns around a span: the word before, two before, one on each side, two after.

    Words count that lie whole within AROUND code points. One more is read: unless it is white space, what touches it is cut off.
    """
    first = F.greatest(start - AROUND - 1, F.lit(0))
    ahead, behind = F.substring(text, first + 1, start - first), F.substring(text, end + 1, F.lit(AROUND + 1))
    before = _words(F.when(first > 0, F.regexp_replace(ahead, r"^\S+", "")).otherwise(ahead))
    after = _words(F.when(F.length(behind) > AROUND, F.regexp_replace(behind, r"\S+$", "")).otherwise(behind))
    l1, l2 = F.try_element_at(before, F.lit(-1)), F.try_element_at(before, F.lit(-2))
    r1, r2 = F.try_element_at(after, F.lit(1)), F.try_element_at(after, F.lit(2))
    made = [F.concat(F.lit("L "), l1), F.concat(F.lit("LL "), l2, F.lit(" "), l1), F.concat(F.lit("LR "), l1, F.lit(" "), r1), F.concat(F.lit("RR "), r1, F.lit(" "), r2)]
    return F.array_compact(F.array(*made))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("th"))


def instances(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Seeds (kind 0 to 3) and candidates (null kind) with value and patterns, one row per occurrence.

    A candidate that overlaps a base span is none.
    """
    rows = _rows(docs, doc_id, text).where(F.col("text").rlike("[0-9@]")).withColumn("base", base_spans(F.col("text")))
    free = F.filter(matches(F.col("text"), CANDIDATE, -1, False), lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    rows = rows.select("doc_id", "th", "text", F.explode(F.concat("base", free)).alias("s")).select("doc_id", "th", "text", "s.start", "s.end", "s.kind")
    value = lower_ascii(F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")))
    return rows.select("doc_id", "th", "start", "end", F.when(F.col("kind") >= 0, F.col("kind")).alias("kind"), value.alias("value"), patterns(F.col("text"), F.col("start"), F.col("end")).alias("patterns"))


def bootstrap(found: DataFrame, rounds: int | None = None, support: int = SUPPORT, confidence: float = CONFIDENCE, accepted: float = ACCEPTED) -> DataFrame:
    """(value, kind) of discovered values of found (value, kind, patterns).

    Both sides of the graph are aggregated before they are joined, so a value or a pattern that a third of
    all rows have is one value or pattern. The loop ends when a round discovers nothing, which comes as values
    are finite, or after `rounds` rounds where that is given.
    """
    edges = saved(found.select("value", F.explode("patterns").alias("p")).distinct())
    known = saved(found.where("kind IS NOT NULL").groupBy("value").agg(F.min("kind").alias("kind")))
    seeds = known
    for _ in count() if rounds is None else range(rounds):
        labelled = edges.join(known, "value", "left")
        each = labelled.groupBy("p").agg(F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(f"k{k}") for k in range(4)])
        most = F.greatest(*[F.col(f"k{k}") for k in range(4)])
        kind = reduce(lambda rest, k: F.when(F.col(f"k{k}") == most, k).otherwise(rest), reversed(range(4)), F.lit(None).cast("int"))
        good = each.select("p", kind.alias("kind"), most.alias("hits"), (most / (F.col("n") + 1)).alias("conf")).where((F.col("hits") >= support) & (F.col("hits") >= confidence * F.col("n")))
        unknown = edges.join(known, "value", "left_anti").join(good, "p")
        score = 1 - F.exp(F.sum(F.log(1 - F.col("conf"))))
        scored = unknown.groupBy("value", "kind").agg(F.round(score, 9).alias("score")).where(F.col("score") >= accepted)
        new = saved(scored.groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind")))
        if new.isEmpty():
            break
        known = saved(known.unionByName(new))
    return known.join(seeds.select("value"), "value", "left_anti")


def discovered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame | None:
    """(doc_id, th, more): discovered spans of each text that has any; None if nothing was discovered."""
    found = saved(instances(docs, doc_id, text))
    values = saved(bootstrap(found, **params))
    if values.isEmpty():
        return None
    hits = found.where("kind IS NULL").drop("kind").join(values, "value")
    return hits.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("more"))


def _with_spans(rows: DataFrame, more: DataFrame | None, doc_id: str, th: str, base: str, spans: str) -> DataFrame:
    """rows with `spans`: base and discovered ones in order; the names are those of rows' columns, and a new one."""
    if more is None:
        return rows.withColumn(spans, F.col(base))
    own, key, found = free([*rows.columns, spans], "doc_id", "th", "more")
    more = more.select(F.col("doc_id").alias(own), F.col("th").alias(key), F.col("more").alias(found))
    rows = rows.join(more, F.col(doc_id).eqNullSafe(F.col(own)) & (F.col(th) == F.col(key)), "left").drop(own, key)
    return rows.withColumn(spans, F.array_sort(F.concat(base, F.coalesce(F.col(found), F.array().cast(f"array<{SPAN}>"))))).drop(found)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """(doc_id, base, spans) per row of docs; a span is (start, kind, end) in code points, kind an index of KINDS.

    Null texts count as empty. Repeated rows get equal results; rows that share a doc_id but not the text get
    each their own. Other columns are not read.
    """
    more = discovered(docs, doc_id, text, **params)
    rows = _rows(docs, doc_id, text).select("doc_id", "th", base_spans(F.col("text")).alias("base"))
    return _with_spans(rows, more, "doc_id", "th", "base", "spans").select("doc_id", "base", "spans")


def joined(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """docs with each span of `text` replaced by its kind in brackets; of overlapping spans the first names them.

    Texts without spans, and null ones, are unchanged; n_chars, where docs has it, follows the text. Other
    columns stay as they are, whatever their names.
    """
    more = discovered(docs, doc_id, text, **params)
    th, base, spans, kept, new = free(docs.columns, "th", "base", "spans", "kept", "new")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = _with_spans(docs.select("*", F.xxhash64(t).alias(th), base_spans(t).alias(base)), more, doc_id, th, base, spans)
    name = lambda s: F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1))

    def step(a: Column, s: Column) -> Column:
        apart = s["start"] >= a["end"]
        longer = F.struct(a["start"].alias("start"), a["kind"].alias("kind"), F.greatest(a["end"], s["end"]).alias("end"))
        return F.struct(F.when(apart, s).otherwise(longer).alias("state"), F.when(apart & (a["kind"] >= 0), a).alias("kept"))

    # spans that overlap become one, which is kept once the next one starts beyond it; a last one ends them all
    point = lambda at: F.struct(F.lit(at).alias("start"), F.lit(-1).alias("kind"), F.lit(at).alias("end"))
    rows = rows.withColumn(kept, in_order(F.array_append(F.col(spans), point((1 << 31) - 1)), SPAN, point(0), step))
    ahead = lambda i: F.coalesce(F.get(kept, i - 1)["end"], F.lit(0))
    piece = lambda s, i: F.concat(F.substring(t, ahead(i) + 1, s["start"] - ahead(i)), F.lit("["), name(s), F.lit("]"))
    whole = F.concat(F.array_join(F.transform(kept, piece), ""), F.substring(t, ahead(F.size(kept)) + 1, F.length(t)))
    changed = F.size(spans) > 0
    out = rows.withColumn(new, F.when(changed, whole))
    lengths = {c: F.length(new).cast(k) for c, k in docs.dtypes if c == "n_chars"}
    return out.select(*[F.when(changed, F.col(new)).otherwise(F.col(c)).alias(c) if c == text else F.when(changed, lengths[c]).otherwise(F.col(c)).alias(c) if c in lengths else F.col(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    kinds = F.col("base")["kind"]
    counts = [F.size(F.filter(kinds, F.lit(k).eqNullSafe)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]  # a default in a lambda would be the position
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
