"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A bounded sample of labelled rows is the set of examples (the bound is a parameter). The vector space has every
word of the examples, of either label. A term weighs its idf times the share of its
association with the label that is beyond chance, chi2 / (chi2 + SHRINK), whichever label it speaks for; so
words that all texts share count little, and nothing is left out of a norm. The index lies in the shared folder:
long lists by blocks of examples with the largest weight of each term in a block, short lists as they are, and
whole vectors. Short lists are added up in full; the long lists of a block are read only if the block's largest
weights let one of its examples reach the nearest found. Single precision only chooses, under a proven bound of
its error; the cosines are then computed in double precision. The votes of the nearest, weighted by cosine, are
calibrated on the examples themselves, each without its own vote.
"""

from __future__ import annotations

import hashlib
import io
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import saved, scratch, small_batches, table
from ledgerlens.llm.files import local, read_from, write_to

#: Labelled rows that the fit uses at most: those whose id hashes lowest.
EXAMPLES = 15_000
NEIGHBOURS = 15
#: Examples of a block; texts that are scored together; texts of an Arrow batch, whose terms are looked up together.
BLOCK, TOGETHER, SCORED = 128, 128, 1024
#: Chi-square at which a term has half its idf.
SHRINK = 25.0
#: A list is long if so large a part of the examples is on it.
LONG = 1 / 24
#: Terms of least weight that hold this part of the examples' squared norms are looked up only for the chosen.
TAIL = 5e-3
REJECTED = 0.7

#: What separates words.
APART = r"[^\pL\pM\pN]+"


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Terms, and for each occurrence of one its text and its number among the terms, for a batch of texts. Terms are words in lower case."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts.fill_null("")), APART)
    row = pc.list_parent_indices(lists).to_numpy()
    flat = pc.list_flatten(lists).dictionary_encode()
    words, at = flat.dictionary, flat.indices.to_numpy()
    kept = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)[at] if len(at) else np.empty(0, bool)
    return words, row[kept].astype(np.int64), at[kept].astype(np.int64)


@dataclass
class Index:
    """Arrays of a fitted model as they lie in the shared folder; files of this machine are mapped, not read."""

    terms: pa.Array
    weights: np.ndarray
    place: np.ndarray  # row of each term among the long lists, -1 for a short list, -2 for the tail
    starts: np.ndarray  # vectors: first entry of each distinct vector, in the order of the blocks
    ids: np.ndarray
    units: np.ndarray  # weight of each entry in its vector of norm 1
    tails: np.ndarray  # norm of each vector's part in the tail
    long: np.ndarray  # (blocks, long lists, BLOCK) weights
    best: np.ndarray  # (long lists, blocks) largest weight
    short_starts: np.ndarray  # short lists: first entry of each term
    short_at: np.ndarray
    short_weights: np.ndarray
    member_starts: np.ndarray  # examples that share a vector
    members: np.ndarray
    labels: np.ndarray
    scratchpad: np.ndarray | None = field(default=None, repr=False)

    def save(self, to: str) -> None:
        with write_to(f"{to}/terms.arrow") as f, pa.ipc.new_file(f, pa.schema([("t", pa.string())])) as made:
            made.write_batch(pa.record_batch({"t": self.terms}))
        for name in ARRAYS:
            raw = io.BytesIO()
            np.save(raw, getattr(self, name))
            with write_to(f"{to}/{name}.npy") as f:
                f.write(raw.getbuffer())

    @staticmethod
    def load(at: str) -> Index:
        def one(name: str) -> np.ndarray:
            uri = f"{at}/{name}.npy"
            if path := local(uri):
                return np.asarray(np.load(path, mmap_mode="r"))
            with read_from(uri) as f:
                return np.load(io.BytesIO(f.read()))

        with read_from(f"{at}/terms.arrow") as f:
            terms = pa.ipc.open_file(f.read()).read_all()["t"].combine_chunks()
        return Index(terms, *map(one, ARRAYS))


ARRAYS = [n for n in Index.__dataclass_fields__ if n not in ("terms", "scratchpad")]
#: The index this worker has open, by its path.
_OPEN: dict[str, Index] = {}


def opened(at: str) -> Index:
    if at not in _OPEN:
        _OPEN.clear()
        _OPEN[at] = Index.load(at)
    return _OPEN[at]


def vectors(index: Index, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, counts) of the index's terms in each text, by id."""
    terms, row, at = terms_of(texts)
    ids = pc.index_in(terms, value_set=index.terms).fill_null(-1).to_numpy().astype(np.int64)[at]
    size = max(1, len(index.terms))
    found, counts = np.unique((row * size + ids)[ids >= 0], return_counts=True)
    cuts = np.searchsorted(found, np.arange(len(texts) + 1) * size)
    return [(found[a:b] - i * size, counts[a:b]) for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))]


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers from starts to ends of each pair, one after the other."""
    sizes = ends - starts
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if total else np.empty(0, np.int64)


def _raw(index: Index, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return (1 + np.log(counts)) * index.weights[ids]


def nearest(index: Index, queries: list[tuple[np.ndarray, np.ndarray]], but: list[int] | None = None) -> list[list[tuple[float, int]]]:
    """For each query (ids, counts) the NEIGHBOURS examples of highest cosine over 0: (cosine, example), the earlier of equals first.

    `but` names an example per query that is left out.
    """
    out: list[list[tuple[float, int]]] = []
    for i in range(0, len(queries), TOGETHER):
        out += _nearest(index, queries[i : i + TOGETHER], but[i : i + TOGETHER] if but else [-1] * len(queries[i : i + TOGETHER]))
    return out


def _nearest(index: Index, queries: list[tuple[np.ndarray, np.ndarray]], but: list[int]) -> list[list[tuple[float, int]]]:
    n, q, wanted = len(index.tails), len(queries), NEIGHBOURS + 1
    blocks, lists = index.long.shape[0], index.long.shape[1]
    if not n:
        return [[] for _ in queries]
    if index.scratchpad is None:
        index.scratchpad = np.zeros(len(index.terms))
    dense = np.zeros((q, lists), np.float32)
    added = np.zeros((q, blocks * BLOCK), np.float32)
    units, tails = [], np.zeros(q)
    for i, (ids, counts) in enumerate(queries):
        raw = _raw(index, ids, counts)
        norm = math.sqrt(float(raw @ raw))
        unit = raw / norm if norm else raw
        units.append(unit)
        place = index.place[ids]
        dense[i, place[place >= 0]] = unit[place >= 0]
        tails[i] = math.sqrt(float((unit[place == -2] ** 2).sum()))
        short = ids[place == -1]
        first, last = index.short_starts[short], index.short_starts[short + 1]
        spans = list(zip(first.tolist(), last.tolist(), strict=True))
        if spans:
            weight = np.concatenate([index.short_weights[a:b] for a, b in spans])
            weight *= np.repeat(unit[place == -1].astype(np.float32), last - first)
            added[i] = np.bincount(np.concatenate([index.short_at[a:b] for a, b in spans]), weight, blocks * BLOCK)
    # rounding of stored weights, of each product and of sums of nonnegative numbers up to 1, in single precision
    error = (lists + 16) * 2.0**-23
    bound = dense @ index.best + added.reshape(q, blocks, BLOCK).max(axis=2)
    slack = tails[:, None] * index.tails[None, :] + error
    score = np.full((q, blocks * BLOCK), -1.0, np.float32)
    loose = slack.max(axis=1) + error if n else error
    seen = np.zeros((q, blocks), bool)

    def visit(b: int, rows: np.ndarray) -> None:
        here = slice(b * BLOCK, (b + 1) * BLOCK)
        score[rows, here] = dense[rows] @ index.long[b] + added[rows, here]
        seen[rows, b] = True

    first = np.argsort(-bound, axis=1, kind="stable")[:, :4]
    for b in np.unique(first).tolist():
        visit(b, np.flatnonzero((first == b).any(axis=1)))
    some = score.reshape(q, blocks, BLOCK)[np.arange(q)[:, None], first].reshape(q, -1)
    # a score that NEIGHBOURS examples other than the one left out have at least, whatever the tail adds
    floor = np.partition(some, some.shape[1] - wanted, axis=1)[:, some.shape[1] - wanted].astype(float) - error
    for b in np.argsort(-bound.max(axis=0), kind="stable").tolist():
        rows = np.flatnonzero(~seen[:, b] & (bound[:, b] + loose >= floor) & (bound[:, b] + loose > error))
        if len(rows):
            visit(b, rows)
    score = score[:, :n]
    out = []
    for i, (ids, _) in enumerate(queries):
        high = score[i][score[i] >= max(floor[i], 0.0)]
        floor[i] = max(0.0, np.partition(high, len(high) - wanted)[len(high) - wanted] - error) if len(high) >= wanted else 0.0
        chosen = np.flatnonzero((score[i] >= 0) & (score[i] + slack[i] >= floor[i]) & (score[i] + slack[i] > error)) if len(ids) else np.empty(0, np.int64)
        if tails[i]:  # a text that meets an example only in the tail may be near as well
            chosen = chosen if floor[i] > 0 else np.arange(n)
        pad = index.scratchpad
        pad[ids] = units[i]
        first_, last_ = index.starts[chosen], index.starts[chosen + 1]
        at = _ranges(first_, last_)
        got = pad[index.ids[at]] * index.units[at]
        sums = np.add.reduceat(got, np.concatenate([[0], np.cumsum(last_ - first_)[:-1]])) if len(got) else np.zeros(len(chosen))
        pad[ids] = 0
        cosine = np.minimum(sums, 1.0)
        top = chosen[np.lexsort((index.members[index.member_starts[chosen]], -np.round(cosine, 12)))[:wanted]]
        value = dict(zip(chosen.tolist(), cosine.tolist(), strict=True))
        lasts = np.minimum(index.member_starts[top + 1], index.member_starts[top] + wanted)
        each = index.members[_ranges(index.member_starts[top], lasts)].tolist()
        of = np.repeat(top, lasts - index.member_starts[top]).tolist()
        found = [(value[c], e) for c, e in zip(of, each, strict=True) if e != but[i] and value[c] > 0]
        out.append(sorted(found, key=lambda x: (-round(x[0], 12), x[1]))[:NEIGHBOURS])
    return out


@dataclass
class Model:
    """Where the index lies, the examples' ids and labels, and the calibration: all bounded by EXAMPLES."""

    at: str
    ids: list
    labels: np.ndarray
    prior: float
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of label 1 among the nearest by cosine, the prior counting as one of cosine 0.1."""
        weight = sum(s for s, _ in near)
        return (sum(s for s, e in near if self.labels[e]) + 0.1 * self.prior) / (weight + 0.1)

    def calibrate(self, votes: list[tuple[float, int]]) -> None:
        """The nearest rising function from votes to labels, by pooling adjacent violators."""
        pools: list[list[float]] = []
        for x, y in sorted(votes):
            pools.append([x, x, y, 1])
            while len(pools) > 1 and (pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3] or pools[-2][1] == pools[-1][0]):
                last = pools.pop()
                pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
        if pools:
            xs = np.array([x for p in pools for x in (p[0], p[1])])
            ys = np.array([y for p in pools for y in [(p[2] + self.prior) / (p[3] + 1)] * 2])
            self.steps = xs, np.maximum.accumulate(ys)

    def score(self, near: list[tuple[float, int]]) -> float:
        """From 0 to 1. A text near no example, an empty one too, gets the examples' share of label 1."""
        if not near:
            return self.prior
        value = self.vote(near)
        return min(1.0, max(0.0, float(np.interp(value, *self.steps)) if self.steps else value))

    def scores(self, texts: pa.Array) -> list[tuple[float, list[tuple[float, int]]]]:
        """Score and nearest examples of each text; equal texts are compared once."""
        index, coded = opened(self.at), texts.fill_null("").dictionary_encode()
        near = [(self.score(x), x) for x in nearest(index, vectors(index, coded.dictionary))]
        return [near[i] for i in coded.indices.to_pylist()]


def learnable(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def _ordered(dense: np.ndarray, rounds: int = 4, centers: int = 64) -> np.ndarray:
    """An order of the rows that puts like ones side by side: clusters by cosine, so that blocks have low bounds."""
    at = dense[np.linspace(0, len(dense) - 1, min(centers, len(dense))).astype(int)]
    for _ in range(rounds):
        own = (dense @ at.T).argmax(axis=1)
        at = np.stack([dense[own == c].sum(axis=0) if (own == c).any() else at[c] for c in range(len(at))])
        at /= np.maximum(np.sqrt((at * at).sum(axis=1, keepdims=True)), 1e-12)
    return np.argsort((dense @ at.T).argmax(axis=1), kind="stable")


def build(terms: pa.Array, weights: np.ndarray, entries: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Index:
    """The index of the examples' (ids, counts); examples of equal vectors share one."""
    groups: dict[bytes, list[int]] = {}
    for e, (ids, counts) in enumerate(entries):
        if len(ids):
            groups.setdefault(hashlib.sha256(ids.tobytes() + counts.tobytes()).digest(), []).append(e)
    members = list(groups.values())
    kept = [entries[v[0]] for v in members]
    n = len(kept)
    sizes = np.array([len(ids) for ids, _ in kept], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    ids = np.concatenate([i for i, _ in kept], dtype=np.int32) if n else np.empty(0, np.int32)
    unit = np.empty(len(ids))
    for (i, c), first in zip(kept, starts.tolist(), strict=False):
        raw = (1 + np.log(c)) * weights[i]
        unit[first : first + len(i)] = raw / math.sqrt(float(raw @ raw))
    del kept, entries
    df = np.bincount(ids, minlength=len(terms))
    energy = np.bincount(ids, unit * unit, len(terms))
    light = np.argsort(weights, kind="stable")
    tail = light[np.cumsum(energy[light]) <= TAIL * max(1, n)]
    place = np.full(len(terms), -1, np.int32)
    place[tail] = -2
    often = np.flatnonzero((df > LONG * n) & (place == -1))
    place[often] = np.arange(len(often))
    lists = len(often)
    dense, tails = np.zeros((n, lists), np.float32), np.zeros(n)
    for v in range(n):
        here = slice(starts[v], starts[v + 1])
        at = place[ids[here]]
        dense[v, at[at >= 0]] = unit[here][at >= 0]
        tails[v] = math.sqrt(float((unit[here][at == -2] ** 2).sum()))
    order = _ordered(dense) if n and lists else np.arange(n)
    blocks = max(1, -(-n // BLOCK))
    long = np.zeros((blocks, lists, BLOCK), np.float32)
    for b in range(blocks):
        some = order[b * BLOCK : (b + 1) * BLOCK]
        long[b, :, : len(some)] = dense[some].T
    del dense
    new = np.empty(n, np.int32)
    new[order] = np.arange(n)
    at = np.repeat(new, sizes)
    short = np.flatnonzero(place[ids] == -1)
    short = short[np.argsort(ids[short].astype(np.int64) * max(1, n) + at[short], kind="stable")]
    take = _ranges(starts[:-1][order], starts[1:][order])
    return Index(
        terms=terms, weights=weights, place=place, starts=np.concatenate([[0], np.cumsum(sizes[order])]).astype(np.int64), ids=ids[take], units=unit[take], tails=tails[order],
        long=long, best=long.max(axis=2).T.copy(), short_starts=np.concatenate([[0], np.cumsum(np.bincount(ids[short], minlength=len(terms)))]).astype(np.int64),
        short_at=at[short], short_weights=unit[short].astype(np.float32),
        member_starts=np.concatenate([[0], np.cumsum([len(members[i]) for i in order])]).astype(np.int64), members=np.array([e for i in order for e in members[i]], np.int64), labels=labels,
    )


def weighed(df: np.ndarray, hit: np.ndarray, n: int, positive: int) -> np.ndarray:
    """The weight of terms that are in df of n examples, hit of them among the `positive` of label 1."""
    gap = hit * n - df * positive
    chi2 = gap * gap * n / np.maximum(float(positive) * (n - positive) * df * (n - df), 1e-9)
    return np.log((1 + n) / (1 + df)) * chi2 / (chi2 + SHRINK)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", examples: int = EXAMPLES) -> Model:
    """The model of at most `examples` labelled rows whose crc32(doc_id) mod 3 isn't 1.

    Rows without a label or an id, and ids without a document, teach nothing. Of ids labelled twice the
    highest label counts; of documents that share an id, each different text is an example. Without examples every score is 0.
    """
    spark = docs.sparkSession
    small_batches(spark, SCORED)
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & learnable(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    chosen = saved(known.orderBy(F.xxhash64("_id"), "_id").limit(examples))  # bounded, so it is broadcast
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"), F.xxhash64(text).alias("_th"))
    keys = rows.select("_id", "_th").join(F.broadcast(chosen), "_id").distinct().orderBy(F.xxhash64("_id"), "_id", "_th").limit(examples)
    found = keys.collect()
    own = np.array([r["_label"] for r in found], np.int64)
    n, positive = len(found), int(own.sum())
    numbered = spark.createDataFrame([(r["_id"], r["_th"], i) for i, r in enumerate(found)], rows.select("_id", "_th").schema.add("_e", "long"))
    seen = saved(rows.join(F.broadcast(numbered), ["_id", "_th"]).dropDuplicates(["_e"]).select("_e", "_text"))
    shared = spark.sparkContext.broadcast(own)

    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, row, at_ = terms_of(b.column(1))
            once = np.unique(at_ * len(b) + row)  # each term once a text
            mark = shared.value[b.column(0).to_numpy()][once % max(1, len(b))]
            df = np.bincount(once // max(1, len(b)), minlength=len(terms)).astype(np.int64)
            hit = np.bincount(once // max(1, len(b)), mark, len(terms)).astype(np.int64)
            there = pa.array(df > 0)
            yield pa.record_batch({"t": terms.filter(there), "df": pa.array(df).filter(there), "hit": pa.array(hit).filter(there)})

    stats = seen.mapInArrow(statistics, "t string, df long, hit long").groupBy("t").agg(F.sum("df").alias("df"), F.sum("hit").alias("hit"))
    got = stats.toArrow().sort_by("t")  # all terms of the examples, so bounded by them
    weights = weighed(got["df"].to_numpy().astype(float), got["hit"].to_numpy().astype(float), n, positive) if 0 < positive < n else np.zeros(len(got))
    terms, weights = got["t"].combine_chunks().cast(pa.string()).filter(pa.array(weights > 0)), weights[weights > 0]
    at = scratch(spark, "toxicity")
    empty = build(terms, weights, [], own)
    empty.save(f"{at}/terms")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = opened(f"{at}/terms")
        for b in batches:
            made = vectors(index, b.column(1))
            yield pa.record_batch({"e": b.column(0), "ids": pa.array([i.astype(np.int32) for i, _ in made], pa.list_(pa.int32())), "counts": pa.array([c.astype(np.int32) for _, c in made], pa.list_(pa.int32()))})

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [(np.empty(0, np.int32), np.empty(0, np.int32))] * len(shared.value)
        for b in batches:
            for e, i, c in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                made[e] = (i.values.to_numpy().copy(), c.values.to_numpy().copy())
        own_ = opened(f"{at}/terms")
        to = f"{at}/{uuid.uuid4().hex}"  # a task that runs again writes another one
        build(own_.terms, own_.weights, made, shared.value).save(to)
        yield pa.record_batch({"at": pa.array([to])})

    made = saved(seen.mapInArrow(entries, "e long, ids array<int>, counts array<int>"))
    lies = made.coalesce(1).mapInArrow(make, "at string").collect()  # the examples' entries, so bounded by them
    model = Model(lies[0]["at"] if lies else f"{at}/terms", [str(r["_id"]) for r in found], own, positive / n if n else 0.0)
    sent = spark.sparkContext.broadcast(model)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = opened(sent.value.at)
        for b in batches:
            e = b.column(0).to_pylist()
            near = nearest(index, vectors(index, b.column(1)), e)
            yield pa.record_batch({"e": b.column(0), "vote": pa.array([sent.value.vote(x) if x else None for x in near], pa.float64())})

    told = seen.mapInArrow(votes, "e long, vote double").where("vote IS NOT NULL").collect()
    model.calibrate([(r["vote"], int(own[r["e"]])) for r in told])
    return model


def scorer(spark: SparkSession, model: Model, evidence: bool = True):
    """A column function from texts to struct(score, evidence): the nearest examples with cosine and label; or to the score alone."""
    small_batches(spark, SCORED)
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([s for s, _ in sent.value.scores(texts)], pa.float64())

    @F.arrow_udf("score double, evidence array<struct<doc_id:string,cosine:double,label:int>>")
    def explained(texts: pa.Array) -> pa.Array:
        own = sent.value
        made = [{"score": s, "evidence": [{"doc_id": own.ids[e], "cosine": c, "label": int(own.labels[e])} for c, e in near[:3]]} for s, near in own.scores(texts)]
        item = pa.struct([("doc_id", pa.string()), ("cosine", pa.float64()), ("label", pa.int32())])
        return pa.array(made, pa.struct([("score", pa.float64()), ("evidence", pa.list_(item))]))

    return explained if evidence else score


def keep_civil(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that score REJECTED or more."""
    run = scorer(docs.sparkSession, fit(docs, labels, doc_id, text), evidence=False)
    return docs.where(run(F.col(text).cast("string")) < REJECTED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    run = scorer(spark, fit(docs, table(spark, sf_dir, "labels")), evidence=False)
    scored = docs.select("doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), run(F.col("text")).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= REJECTED).cast("int").alias("predicted"))
