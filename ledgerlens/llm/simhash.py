"""SimHash near-duplicates: pigeonhole blocks over 64-bit fingerprints, verified by Hamming distance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import attach, components, forget, free, saved, small_batches, table

SEED = 42
#: A stage's near copies share this part of the distinct runs of so many words.
STAGE_WORDS, SIMILAR = 5, 0.8
#: One document in SAMPLED tells which runs are frequent; at most FREQUENT of them are put last. This decides speed only.
SAMPLED, FREQUENT = 16, 50_000
#: Buckets of more fingerprints than this are linked through shared one-bit variants, not by pairs.
PAIRED = 32
#: Hashes of one document that are unpacked to bits at once, and hashes of documents that a worker sends at once.
CHUNK, SENT = 1 << 15, 1 << 19


def _line(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, words: int) -> np.ndarray:
    """A 64-bit hash of each run of `words` words; a shorter text is one run, one without words has none."""
    parts = _line(text)
    if not parts:
        return np.empty(0, "<u8")
    line = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[i:j], SEED) for i, j in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype="<u8")


def fingerprint(text: str | None, words: int = 3) -> int:
    """The fingerprint of one text as a signed 64-bit number; 0 if it has no words."""
    return majority(shingles(text, words))


def majority(values: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit number; 0 for none."""
    if not len(values):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), CHUNK):
        part = values[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", words: int = 3) -> DataFrame:
    """docs with the fingerprint of `text` as a signed long in `out`."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return docs.withColumn(out, prints(F.col(text)))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def masks(distance: int, blocks: int) -> list[int]:
    """One mask per choice of `blocks - distance` whole blocks: two fingerprints within the distance agree on one."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    return [sum(block[i] for i in kept) for kept in combinations(range(blocks), blocks - distance)]


def links(prints: DataFrame, distance: int = 2, blocks: int = 4, paired: int = PAIRED) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of `prints` (fp), with the same components as all links have.

    Each fingerprint goes to one bucket for each choice of agreeing blocks (with the defaults 6 buckets on
    32 bits). Buckets of up to `paired` fingerprints are joined with themselves and verified by Hamming
    distance. In a larger bucket, fingerprints meet at each value one bit away from them: two are within
    distance 2 if and only if they share such a value (or one is the other's), no value is near more than
    65 fingerprints, and the rows grow in proportion to the bucket.
    """
    if distance != 2:
        raise ValueError("the exact way for large buckets holds for two bits")
    chosen = masks(distance, blocks)
    rows = prints.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(chosen)])).alias("x")
    ).select("fp", "x.t", "x.key")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = saved(rows.join(sizes, ["t", "key"]))
    few = rows.where(F.col("n") <= paired)
    other = few.select("t", "key", F.col("fp").alias("fp2"))
    near = few.join(other, ["t", "key"]).where(f"fp < fp2 AND bit_count(fp ^ fp2) <= {distance}").select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    around = rows.where(F.col("n") > paired).select("fp").distinct()
    variants = around.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)])).alias("v"))
    met = variants.groupBy("v").agg(F.collect_set("fp").alias("s")).where(F.size("s") > 1)
    star = met.select(F.array_min("s").alias("a"), F.explode("s").alias("b")).where(f"a <> b AND bit_count(a ^ b) <= {distance}")
    return near.unionByName(star).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per row of docs.

    component_id is the smallest doc_id that links reach. Equal texts share a fingerprint and collapse
    before any linking. Null or wordless texts have fingerprint zero and link like any other. Rows without
    a doc_id get a component but lend it no id (null if it has no other rows); repeated rows stay.
    Further columns of docs, whatever their names, are not read.
    """
    own = saved(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words=words).select("doc_id", "fp"))
    classes = saved(own.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies")))
    joined = components(links(classes.select("fp"), distance)).withColumnRenamed("node", "fp")
    linked = saved(classes.join(joined, "fp"))
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = linked.join(least, "root").select("fp", "component_id")
    classes = classes.join(linked, "fp", "left").select("fp", "copies", F.coalesce("component_id", "least_id").alias("component_id"))
    found = attach(own, saved(classes), "fp", "copies")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def frequent_runs(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs that recur in a sample of rows (_id, _text, _th), sorted, and in how many of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.record_batch({"r": pa.array(np.unique(shingles(t, words)).view(np.int64))})

    sample = rows.where(F.pmod("_th", F.lit(SAMPLED)) == 0).select("_text").distinct()
    found = sample.mapInArrow(run, "r long").groupBy("r").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "r").limit(FREQUENT).collect()
    runs, counts = np.array([r["r"] for r in found], np.int64).view(np.uint64), np.array([r["n"] for r in found], np.int64)
    order = np.argsort(runs)
    return runs[order], counts[order]


def prefixes(rows: DataFrame, words: int, similar: float) -> DataFrame:
    """(_id, _th, c, fp, size, hot, first, often) per row of rows: its class of equal words, its fingerprint, its
    numbers of distinct runs and of frequent ones, and its first runs, the frequent ones of them apart.

    Runs are in one order for all texts, frequent ones last. Two sets of similarity `similar` or more share
    one of their first size - ceil(similar * size) + 1 runs in any such order, so none is missed.
    """
    sent = rows.sparkSession.sparkContext.broadcast(frequent_runs(rows, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, counts = sent.value
        for b in batches:
            out: dict[str, list] = {n: [] for n in ("c", "fp", "size", "hot", "first", "often")}
            for t in b.column(1).to_pylist():
                every = shingles(t, words)
                own = np.unique(every)
                known = np.zeros(len(own), np.int64)
                if len(runs):
                    at = np.minimum(np.searchsorted(runs, own), len(runs) - 1)
                    known = np.where(runs[at] == own, counts[at], 0)
                    own = own[np.argsort(known, kind="stable")]
                hot = int((known > 0).sum())
                first = own[: max(0, len(own) - math.ceil(similar * len(own) - 1e-9) + 1)].view(np.int64)
                for n, x in zip(out, (xxhash.xxh64_intdigest(b" ".join(_line(t)), SEED) - (1 << 63), majority(every), len(own), hot, first[: len(own) - hot], first[len(own) - hot :]), strict=True):
                    out[n].append(x)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.record_batch({"_id": b.column(0), "_th": b.column(2)} | {n: pa.array(x, k) for (n, x), k in zip(out.items(), kinds, strict=True)})

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.select("_id", "_text", "_th").mapInArrow(run, f"_id {kind}, _th long, c long, fp long, size int, hot int, first array<bigint>, often array<bigint>")


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = STAGE_WORDS, similar: float = SIMILAR) -> DataFrame:
    """(_id, _th, group) per row of docs: groups of texts that links of similarity `similar` or more reach.

    Similarity is that of the sets of runs of `words` words (Jaccard), computed for each candidate pair. The
    first candidates are fingerprints that pigeonhole blocks put within two bits. Such fingerprints belong to few of the
    pairs of that similarity, so two further rounds find the rest without fail:

    - each text meets one text for each of its first runs: of those that share the run the one with the least
      part of runs that aren't frequent, which in a group of copies is its pattern or nearest to it;
    - then those meet that share a first run and aren't in one group yet; of a run's largest group the texts
      meet only those outside it. Two texts that share frequent runs alone have at most the lesser of both
      numbers of frequent runs in common, so edited copies that lie too far from their pattern don't meet.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"), F.xxhash64(text).alias("_th"))
    own = saved(prefixes(rows, words, similar))
    classes = saved(own.groupBy("c").agg(F.min("_th").alias("_th"), *[F.first(n).alias(n) for n in ("fp", "size", "hot", "first", "often")]))
    told = classes.select("c", F.struct("c", "size", "hot", F.size("often").alias("kept")).alias("t"))
    # A run that isn't frequent has few rows, so one exchange of them counts and keeps those that recur.
    few = classes.select(F.explode("first").alias("run"), "c").withColumn("n", F.count("*").over(W.partitionBy("run"))).where("n > 1").select("run", F.lit(False).alias("frequent"), "c")
    many = classes.where(F.col("hot") >= similar * F.col("size") - 1e-9).select(F.explode("often").alias("run"), F.lit(True).alias("frequent"), "c")
    each = saved(few.unionByName(many).join(told, "c").select("run", "frequent", "t"))
    rarity = (F.col("t.size") - F.col("t.hot")) / F.greatest(F.col("t.size"), F.lit(1))
    met = each.groupBy("run").agg(F.count("*").alias("n"), F.min_by("t", F.struct(rarity, F.col("t.c"))).alias("u")).where("n > 1").select("run", "u")
    shared = saved(each.join(met, "run"))
    forget(each)
    part = similar / (1 + similar)

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append((c, np.unique(shingles(t, words)).view(np.int64)))
                size += len(held[-1][1])
                if size > SENT:
                    yield pa.record_batch({"c": pa.array([c for c, _ in held], pa.int64()), "runs": pa.array([r for _, r in held], pa.list_(pa.int64()))})
                    held, size = [], 0
            yield pa.record_batch({"c": pa.array([c for c, _ in held], pa.int64()), "runs": pa.array([r for _, r in held], pa.list_(pa.int64()))})

    least_of = classes.select("c", "_th")
    once = rows.groupBy("_th").agg(F.first("_text").alias("_text"))  # copies meet before they are sent

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(least_of, "c")
        sets = saved(once.join(wanted, "_th").select("c", "_text").mapInArrow(runs_of, "c long, runs array<bigint>"))
        left, right = sets.select(F.col("c").alias("a"), F.col("runs").alias("p")), sets.select(F.col("c").alias("b"), F.col("runs").alias("q"))
        both = F.size(F.array_intersect("p", "q"))  # in the JVM: sets of long texts don't pile up in batches
        out = saved(pairs.join(left, "a").join(right, "b").where(both >= similar * (F.size("p") + F.size("q") - both) - 1e-9).select("a", "b"))
        forget(sets)
        return out

    # Two texts that share frequent runs alone have min(hot) runs in common at most. Where that is too few, only
    # other runs are counted, and any of the frequent first runs may be common beside them.
    total = (F.col("t.size") + F.col("u.size")) * part
    by_often = F.least("t.hot", "u.hot") >= total - 1e-6
    fits = (F.least("t.size", "u.size") >= similar * F.greatest("t.size", "u.size") - 1e-9) & (~F.col("frequent") | by_often)

    def possible(met: DataFrame) -> DataFrame:
        # Of two similar texts the one whose first runs end sooner shares those of them that it shares at all with
        # the other's first runs, and has ceil(similar * size) - 1 further ones.
        first = F.col("t.c") < F.col("u.c")
        pair = met.where(fits).groupBy(F.when(first, F.col("t")).otherwise(F.col("u")).alias("t"), F.when(first, F.col("u")).otherwise(F.col("t")).alias("u")).agg(F.count("*").alias("m"))
        more = F.when(by_often, 0).otherwise(F.least("t.kept", "u.kept")) + F.ceil(similar * F.greatest("t.size", "u.size") - 1e-9) - 1
        return saved(pair.where(F.col("m") + more >= total - 1e-6).select(F.col("t.c").alias("a"), F.col("u.c").alias("b")))

    patterns = saved(classes.groupBy("fp").agg(F.min("c").alias("least")))
    near = links(patterns.select("fp")).join(patterns.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(patterns.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    same = classes.join(patterns, "fp").where("c <> least").select(F.col("c").alias("x"), F.col("least").alias("y"))
    blocked = near.select("x", "y").unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    tried = saved(possible(shared.where("t.c <> u.c")).unionByName(blocked).distinct())
    found = verified(tried)
    joined = components(found).select(F.col("node").alias("c"), "root")
    rooted = shared.select("run", "frequent", "t", F.col("t.c").alias("c")).join(joined, "c", "left").select("run", "frequent", "t", F.coalesce("root", "c").alias("root"))
    sizes = rooted.groupBy("run", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("run").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main")).where("roots > 1").select("run", "main")
    apart = saved(rooted.join(mixed, "run"))
    outside = apart.where("root <> main")
    other = apart.select("run", F.col("t").alias("u"), F.col("root").alias("root2"))
    meet = outside.join(other, "run").where((F.col("root") != F.col("root2")) & ((F.col("root2") == F.col("main")) | (F.col("t.c") < F.col("u.c"))) & fits)
    links_ = found.unionByName(verified(possible(meet).join(tried, ["a", "b"], "left_anti")))
    joined = saved(components(links_).select(F.col("node").alias("c"), "root"))
    forget(shared, apart, classes, patterns, tried)
    # texts that have a copy in no other class keep their own; the joined classes are few against the rows
    return own.select("_id", "_th", "c").join(joined, "c", "left").select("_id", "_th", F.coalesce("root", "c").alias("group"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = STAGE_WORDS, similar: float = SIMILAR) -> DataFrame:
    """docs with one row of each near-duplicate group (similar_groups): that with the smallest doc_id, all columns kept.

    Of a group's rows that share that doc_id one text stays, the least by hash, and of rows that repeat both, one. A
    doc_id may stay with several texts if they are in different groups. Rows without a doc_id go if their
    group has one; else one row of each group stays.
    """
    found = saved(similar_groups(docs, doc_id, text, words, similar))
    rank = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_th").alias("th"))
    least = saved(found.groupBy("group").agg(F.min(rank).alias("least"), F.count("*").alias("copies")))
    groups = attach(found, least, "group", "copies")
    is_least = F.col("_id").eqNullSafe(F.col("least.id")) & (F.col("_th") == F.col("least.th"))
    gone = groups.where(~is_least).select("_id", "_th").distinct()
    id_, th, pick = free(docs.columns, "_id", "_th", "_pick")
    held = docs.withColumn(th, F.xxhash64(text))

    def keyed(keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("_id").alias(id_), F.col("_th").alias(f"{th}_"))
        return held.join(keys, held[doc_id].eqNullSafe(keys[id_]) & (held[th] == keys[f"{th}_"]), how)

    kept = keyed(gone, "left_anti")
    twice = saved(groups.where(is_least).groupBy("_id", "_th").count().where("count > 1").select("_id", "_th"))
    if twice.isEmpty():
        return kept.select(docs.columns)
    order = F.xxhash64(*[F.col(c) for c, k in docs.dtypes if "map<" not in k])
    several = keyed(twice, "left_semi").groupBy(F.col(doc_id).alias(id_), th).agg(F.min_by(F.struct(*docs.columns), order).alias(pick)).select(f"{pick}.*")
    return keyed(gone.unionByName(twice), "left_anti").select(docs.columns).unionByName(several)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
