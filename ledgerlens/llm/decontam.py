"""Benchmark decontamination: a hash set of benchmark windows joined to every window of the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import LOWER, UPPER, lower_ascii, saved, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 8
CONTAMINATED = 2
#: Distinct benchmark windows up to which their set is broadcast (about 100 bytes each); beyond it, it is shuffled.
BROADCAST_WINDOWS = 1_000_000


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; none for null."""
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _starts(n: Column, length: int) -> Column:
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def _key(w: Column, i: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(w, i + F.lit(k)) for k in range(length)])


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: (len, h, win, items). An item of fewer than n words is one window."""
    w = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w"))
    w = w.where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(n)))
    each = w.select("item", "w", "len", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("i"))
    each = each.select("item", "len", F.slice("w", F.col("i"), F.col("len")).alias("win"))
    return each.groupBy("len", "win").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, wins: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Verified occurrences (doc_id, th, at, len, items): `at` is the first word, th the hash of the text.

    Every window of every document is hashed in one code-generated pass and looked up; only windows whose
    words are equal remain. Distinct window lengths are at most n.
    """
    wins = saved(wins)
    sizes = {r["len"]: r["n"] for r in wins.groupBy("len").agg(F.count("*").alias("n")).collect()}
    small = sum(sizes.values()) <= BROADCAST_WINDOWS
    read = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), words(F.col(text)).alias("w"))
    found = None
    for length in sorted(sizes) or [WINDOW]:
        some = wins.where(F.col("len") == length).select("win", "items", _key(F.col("win"), F.lit(0), length).alias("h"))
        at = read.select("doc_id", "th", "w", F.explode(_starts(F.size("w"), length)).alias("at"))
        at = at.withColumn("h", _key(F.col("w"), F.col("at"), length))
        if not small:  # then only the window itself travels, not the document
            at = at.select("doc_id", "th", "at", "h", F.slice("w", F.col("at") + 1, length).alias("own"))
        else:
            at = at.withColumn("own", F.col("w"))
        met = at.join(F.broadcast(some) if small else some, "h")
        same = F.slice("own", F.col("at") + 1, length) if small else F.col("own")
        met = met.where(same == F.col("win")).select("doc_id", "th", "at", F.lit(length).alias("len"), "items")
        found = met if found is None else found.unionByName(met)
    return found


def scan(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, th, n_words, n_hit, items (sorted), spans (at, len).

    Null and empty texts have no words and no hits. Rows that repeat doc_id and text get equal results;
    rows that share a doc_id but not the text get each their own. Items without an id mark words but are
    not listed. An empty benchmark hits nothing. Other columns are not read.
    """
    met = hits(docs, windows(benchmark, item_id, item_text, n), doc_id, text)
    per = met.groupBy("doc_id", "th").agg(
        F.array_sort(F.collect_set(F.struct("at", "len"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["at"] + s["len"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["at"] + s["len"] - F.greatest(a["end"], s["at"]))).alias("n"),
        ),
    )["n"]
    per = per.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "items", "spans", covered.cast("long").alias("n_hit"))
    read = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.size(words(F.col(text))).cast("long").alias("n_words"))
    out = read.join(per, read["doc_id"].eqNullSafe(per["_id"]) & (read["th"] == per["_th"]), "left")
    return out.select("doc_id", "th", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = CONTAMINATED) -> DataFrame:
    """docs without those that hold windows of `least` items or more; kept rows are unchanged."""
    found = hits(docs, windows(benchmark), doc_id, text).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.explode("items").alias("item"))
    bad = found.groupBy("_id", "_th").agg(F.count_distinct("item").alias("n")).where(F.col("n") >= least)
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["_id"]) & (F.xxhash64(docs[text]) == bad["_th"]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, words): the words of each document outside any hit window."""
    found = scan(docs, benchmark, doc_id, text).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "spans").dropDuplicates(["_id", "_th"])
    read = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), words(F.col(text)).alias("w"))
    out = read.join(found, read["doc_id"].eqNullSafe(found["_id"]) & (read["th"] == found["_th"]), "left")
    gone = F.coalesce(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1)))), F.array().cast("array<int>"))
    kept = F.transform(F.array_except(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1)).otherwise(F.array().cast("array<int>")), gone), lambda i: F.get("w", i))
    return out.select("doc_id", "th", kept.alias("words"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n >= CONTAMINATED).alias("contaminated"))


SQL = rf"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
s AS (SELECT item_id, w, least({WINDOW}, len(w)) AS l FROM b WHERE len(w) > 0),
e AS (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM s),
g AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS win FROM e),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}'), []) AS w FROM documents),
x AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM g) q),
h AS (SELECT x.doc_id, x.i, g.l, g.item_id FROM x JOIN g ON g.l = x.l AND g.win = array_to_string(x.w[x.i:x.i + x.l - 1], ' ')),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM h) t GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n_hit, 0)::BIGINT AS n_hit, coalesce(m.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(m.n_items, 0) >= {CONTAMINATED} AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)
"""
