import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerlens.llm import passages, pii, toxicity

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    def ok(k, m):
        d = [int(c) for c in m if c in "0123456789"]
        if k == 1:
            return all(int(x) <= 255 for x in m.split("."))
        if k == 2:
            return 12 <= len(d) <= 19 and sum((x * 2 - 9 if x > 4 else x * 2) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0
        return k == 0 or 9 <= len(d) <= 15

    found = sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if ok(k, m[0]))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in found)


def test_base_spans_against_brute_force(spark, tmp_path):
    rnd = random.Random(4)
    bits = ["a@b.co", "%d@e.f", "@", ".", "1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+", "10.0.0.256", "10.0.0.1", "0.0.0.0", "000.255.0256.1", "0010.1.1.1", "1.2.3.4.5.6.7.8", "é", "\U0001f600", " ", "-", "x", "7", "555", "\n", "(", "4242424242424242"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(300)] + [None, "", "9" * 20000, "a" * 20000, "a." * 9000 + "@b.c", "1." * 9000, "+1" + "(" * 9000]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)] + [(None, "x@y.zz", "n"), (1, "dup@x.yy", "n"), (1, "dup@x.yy", "n")], "doc_id long, text string, spans string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.base_sha256) for r in pii.query(spark, str(tmp_path)).collect()}
    want = {(r.doc_id, hashlib.sha256(brute_spans(r.text).encode()).hexdigest()) for r in df.collect()}
    assert got == want


def test_counts_of_each_kind(spark, tmp_path):
    texts = ["a@b.co 10.0.0.1 c@d.ef", "10.0.0.1 a@b.co 10.0.0.2 +1 555 010 9999", "4111 1111 1111 1111", "none", None, "+15550109999 +1 (555) 010-9998 a@b.co"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.query(spark, str(tmp_path)).collect()}
    assert got == {i: tuple(brute_spans(t).count(f"{k}:") for k in pii.KINDS) for i, t in enumerate(texts)}


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"some words before tel no {1000000 + i} please and more words") for i in range(6)]
    seeds = [(100 + i, f"some words before card number 4{i}42 4242 please hold the line") for i in range(2)]
    known = [(200 + i, f"write to customer id u{i}@mail{i}.example.com thanks a lot") for i in range(30)]
    unseen = [(300, "write to customer id AB-77-{0}x thanks a lot"), (301, "nothing here 12 apples")]
    df = spark.createDataFrame(rows + seeds + known + unseen, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find(df).collect()}
    assert [(s.start, s.kind, s.end) for s in found[300]] == [(21, 0, 31)]
    assert found[301] == [] and all(found[i] == [] for i in range(6))
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[300] == "write to customer id [EMAIL] thanks a lot" and clean[301] == "nothing here 12 apples" and clean[200] == "write to customer id [EMAIL] thanks a lot"
    assert pii.find(df.limit(0)).count() == 0 and pii.redact(df).columns == df.columns


def test_discovery_goes_on_until_a_round_finds_nothing(spark):
    sizes, rows = [1024, 256, 64, 16, 4, 1], []
    for layer, n in enumerate(sizes):  # each layer shares a context with the one before it and the one after it
        for i in range(n):
            contexts = [f"{kind} {c}" for c in (layer - 1, layer) if c >= 0 for kind in ("L", "LL", "LR", "RR")]
            rows.append((f"v{layer}-{i}", None if layer else 0, contexts))
    found = spark.createDataFrame(rows, "value string, kind int, patterns array<string>")
    got = {r.value for r in pii.bootstrap(found).collect()}
    assert got == {v for v, k, _ in rows if k is None}


def test_redaction_of_overlaps(spark):
    many = " ".join(f"a{i}@b.co 10.0.0.{i % 256}" for i in range(3000))
    rows = [(1, "x +1 415 555 2671 1111 y", 24, "k"), (2, None, 0, "k"), (3, "plain", 5, "k"), (4, "a@b.cc10.0.0.1 z", 16, "k"), (5, many, len(many), "k"), (6, "", 0, "k"), (7, "9@8.7.6.5.4", 11, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, base string")
    for n in ("th", "spans", "more", "_id", "_th", "_new", "kept", "kind", "TEXT2"):
        df = df.withColumn(n, F.lit(n))
    out = pii.redact(df.withColumnRenamed("doc_id", "id").withColumn("doc_id", F.lit("own")), doc_id="id")
    got = {r.id: (r.text, r.n_chars) for r in out.collect()}
    assert {(r.base, r.th, r.spans, r._new, r.doc_id) for r in out.collect()} == {("k", "th", "spans", "_new", "own")}

    def redacted(text):  # overlapping spans as one, named by the first
        merged = []
        for part in filter(None, brute_spans(text).split(",")):
            kind, a, b = part.split(":")
            if merged and int(a) < merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], int(b))
            else:
                merged.append([kind, int(a), int(b)])
        for kind, a, b in merged[::-1]:
            text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
        return text

    assert got[2] == (None, 0) and all(got[i] == (redacted(t), len(redacted(t))) for i, t, *_ in rows if t is not None)
    assert got[1][0].count("[") == 1 and got[5][0].count("[EMAIL]") == 3000


def brute_discovered(texts, kinds):
    """Values that bootstrapping finds, by the module's words, in plain loops."""
    found = {}  # value -> (kind or None, patterns)
    for text in texts:
        base = [tuple(map(int, p.split(":")[1:])) + (p.split(":")[0],) for p in filter(None, brute_spans(text).split(","))]
        free = [(m.start(), m.end(), None) for m in re.finditer(r"(?<!\S)[^\s0-9]*[0-9]\S*(?: [^\s0-9]*[0-9]\S*)*", text) if not any(a < m.end() and m.start() < b for a, b, _ in base)]
        for a, b, kind in base + free:
            ahead, behind = text[max(0, a - 49) : a], text[b : b + 49]
            before = (re.sub(r"^\S+", "", ahead) if a > 49 else ahead).lower().split()
            after = (re.sub(r"\S+$", "", behind) if len(behind) > 48 else behind).lower().split()
            pats = {f"L {before[-1]}"} if before else set()
            pats |= {f"LL {before[-2]} {before[-1]}"} if len(before) > 1 else set()
            pats |= {f"LR {before[-1]} {after[0]}"} if before and after else set()
            pats |= {f"RR {after[0]} {after[1]}"} if len(after) > 1 else set()
            value = text[a:b].lower()
            old = found.get(value, (None, set()))
            own = kinds.index(kind) if kind else None
            found[value] = (own if old[0] is None else old[0] if own is None else min(own, old[0]), old[1] | pats)
    known = {v: k for v, (k, _) in found.items() if k is not None}
    seeds = set(known)
    while True:
        good = {}
        for p in {p for _, ps in found.values() for p in ps}:
            having = [v for v, (_, ps) in found.items() if p in ps]
            hits = [sum(known.get(v) == k for v in having) for k in range(4)]
            if max(hits) >= 3 and max(hits) >= 0.8 * len(having):
                good[p] = (hits.index(max(hits)), max(hits) / (len(having) + 1))
        new = {}
        for v, (_, ps) in found.items():
            if v not in known:
                scores = [1 - math.prod(1 - good[p][1] for p in ps if p in good and good[p][0] == k) for k in range(4)]
                if max(scores) >= 0.95:
                    new[v] = max(range(4), key=lambda k: (round(scores[k], 9), -k))
        if not new:
            return {v: k for v, k in known.items() if v not in seeds}
        known |= new


def test_discovered_spans_against_brute_force(spark):
    rnd = random.Random(5)
    words = "write to mail box desk line call host node id ref no".split()
    texts = []
    for i in range(420):
        unknown = rnd.choice([f"AB-{i}x {i % 9}", f"{i}", f"q{i}é7", "7" * 60])
        known, left, right = [(f"u{i}@m{i}.co", ["write", "to"], ["please", "now"]), (f"10.1.{i % 250}.{i % 7}", ["host", "node"], ["is", "up"]), (unknown, rnd.sample(words, 2), rnd.sample(words, 2))][i % 3]
        value = known if rnd.random() < 0.9 else unknown
        texts.append(" ".join([rnd.choice(words) * rnd.randint(1, 12), *left, value, *right, rnd.choice(words) * rnd.randint(1, 12)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.value: r.kind for r in pii.bootstrap(pii.instances(df)).collect()}
    want = brute_discovered(texts, list(pii.KINDS))
    assert got == want and len(want) > 10


def corpus(n=240):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        t = [rnd.choice(words) for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            for w in rnd.sample(["scumbag", "vermin", "filth"], 2):
                t.insert(rnd.randrange(len(t)), w)
        docs.append((i, " ".join(t), "x"))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity(spark, tmp_path):
    docs, labels = corpus()
    docs += [(9000, None, "x"), (9001, "", "x"), (None, "vermin filth", "x"), (0, docs[0][1], "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    lab.write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.query(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.95 * len(held)
    kept = toxicity.keep_civil(d, lab)
    assert kept.columns == d.columns and {9000, 9001, 1} <= {r.doc_id for r in kept.collect()}
    assert toxicity.keep_civil(d, lab.limit(0)).count() == len(docs)


def brute_scores(examples, queries):
    """Scores by the docstring's words: all pairs, plain sums, isotonic regression by its max-min formula."""

    def terms(t):
        return Counter(re.findall(r"[^\W_]+", (t or "").lower()))

    n, positive = len(examples), sum(y for _, y in examples)
    df, hit = Counter(), Counter()
    for t, y in examples:
        df.update(terms(t).keys())
        hit.update(k for k in terms(t) if y)

    def weight(t):
        gap = hit[t] * n - df[t] * positive
        chi2 = gap * gap * n / max(positive * (n - positive) * df[t] * (n - df[t]), 1e-9)
        return math.log((1 + n) / (1 + df[t])) * chi2 / (chi2 + 25) if df[t] else 0.0

    def vector(t):
        raw = {k: (1 + math.log(c)) * weight(k) for k, c in terms(t).items() if weight(k) > 0}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {k: w / norm for k, w in raw.items()}

    vectors, prior = [vector(t) for t, _ in examples], positive / n

    def vote(v, but=None):
        near = sorted((-round(sum(w * e.get(k, 0) for k, w in v.items()), 12), i) for i, e in enumerate(vectors) if i != but)[:15]
        near = [(-s, i) for s, i in near if s < 0]
        if near:
            return (sum(s * examples[i][1] for s, i in near) + 0.1 * prior) / (sum(s for s, _ in near) + 0.1)

    pairs = sorted((vote(v, i), examples[i][1]) for i, v in enumerate(vectors) if vote(v, i) is not None)
    groups = [(x, [y for z, y in pairs if z == x]) for x in sorted({x for x, _ in pairs})]
    mean = lambda i, j: sum(sum(y) for _, y in groups[i : j + 1]) / sum(len(y) for _, y in groups[i : j + 1])
    fitted = [max(min(mean(i, j) for j in range(k, len(groups))) for i in range(k + 1)) for k in range(len(groups))]
    steps = []
    for value in dict.fromkeys(round(f, 9) for f in fitted):
        pool = [g for g, f in zip(groups, fitted, strict=True) if round(f, 9) == value]
        ones, size = sum(sum(y) for _, y in pool), sum(len(y) for _, y in pool)
        steps += [(pool[0][0], (ones + prior) / (size + 1)), (pool[-1][0], (ones + prior) / (size + 1))]
    xs, ys = [x for x, _ in steps], np.maximum.accumulate([y for _, y in steps])
    votes = [vote(vector(q)) for q in queries]
    return [prior if v is None else float(np.interp(v, xs, ys)) for v in votes]


def test_scores_against_brute_force(spark):
    docs, labels = corpus(240)
    docs += [(5000 + i, docs[i][1], "x") for i in range(0, 60, 2)]  # copies share a vector
    labels += [(5000 + i, 1, i % 3 == 0) for i in range(0, 60, 2)]
    docs += [(6000, "zzz unknown words only", "x"), (6001, "vermin " * 30_000, "x"), (6002, None, "x"), (6003, " .,- ", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, _text string")
    model = toxicity.fit(d, spark.createDataFrame([(i, q, int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int"))
    text, told = {i: t for i, t, _ in docs}, {i: int(t) for i, _, t in labels}
    examples = [(text[int(i)], told[int(i)]) for i in model.ids]
    assert [told[int(i)] for i in model.ids] == model.labels.tolist() and len(model.ids) > 150
    queries = [t for _, t, _ in docs]
    got = model.scores(pa.array(queries, pa.string()))
    want = brute_scores(examples, queries)
    assert max(abs(s - w) for (s, _), w in zip(got, want, strict=True)) < 1e-8
    some = d.limit(5).select("text", toxicity.scorer(spark, model)("text").alias("s")).collect()
    assert all(abs(r.s.score - dict(zip(queries, want, strict=True))[r.text]) < 1e-8 and len(r.s.evidence) == 3 for r in some)
    assert len({round(w, 6) for w in want}) > 3 and got[-1][1] == [] and got[-1][0] == model.prior


def test_nearest_is_exact_whatever_is_skipped(monkeypatch):
    rnd = random.Random(2)
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    for tail, long in ((5e-3, 1 / 24), (0.2, 1 / 8), (0.0, 1.0)):
        monkeypatch.setattr(toxicity, "TAIL", tail)
        monkeypatch.setattr(toxicity, "LONG", long)
        weights = np.array([rnd.random() ** 3 + 1e-6 for _ in range(300)])
        entries = []
        for i in range(600):
            own = sorted(rnd.sample(range(60 * (i % 4), 60 * (i % 4) + 70), rnd.randint(0, 25)))
            entries.append((np.array(own, np.int64), np.array([rnd.randint(1, 4) for _ in own], np.int64)))
        entries += entries[:50]
        index = toxicity.build(pa.array([f"t{i:03}" for i in range(300)]), weights, entries, np.zeros(650, int))
        vectors = np.zeros((650, 300))
        for e, (ids, counts) in enumerate(entries):
            vectors[e, ids] = (1 + np.log(counts)) * weights[ids]
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
        cosine = vectors @ vectors.T
        but = [e if e % 2 else -1 for e in range(650)]
        for e, got in enumerate(toxicity.nearest(index, entries, but)):
            want = sorted((-round(c, 12), i) for i, c in enumerate(np.minimum(cosine[e], 1).tolist()) if c > 0 and i != but[e])[: toxicity.NEIGHBOURS]
            assert len(got) == len(want) and all(abs(c + w) < 1e-10 for (c, _), (w, _) in zip(got, want, strict=True))


def test_toxicity_of_empty_tables(spark):
    docs, labels = corpus(30)
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert toxicity.keep_civil(d.limit(0), lab).count() == 0
    assert toxicity.keep_civil(d.limit(0), lab.limit(0)).columns == d.columns


def test_passages_against_brute_force(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    make = lambda n: [word() for _ in range(n)]
    p, q, short = make(70), make(60), make(30)
    fuzzy = [w if i != 30 else "changed" for i, w in enumerate(p)]
    docs = {i: make(80) for i in range(12)}
    for i in (1, 4, 9):
        docs[i][20:20] = p
    docs[6] += fuzzy
    docs[2] = q + docs[2]
    docs[7][40:40] = q
    for i in (3, 5):
        docs[i] += short
    rows = [(i, " ".join(t), 1) for i, t in docs.items()] + [(50, " ".join(docs[0]).upper(), 1), (51, None, 1), (52, "", 1), (None, " ".join(p), 1), (53, "few words", 1), (8, " ".join(docs[8]), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    got = {r.doc_id: r for r in passages.classes(df).collect()}
    same = {0: 0, 50: 0, 1: 1, 4: 1, 9: 1, 6: 1, 2: 2, 7: 2, 8: 8}
    for i in [*docs, 50, 51, 52, 53]:
        assert got[i].class_id == same.get(i, i), i
        assert (got[i].n_links > 0) == (i in same), i
    assert got[1].passages == "20-90" and got[6].passages == "80-150" and got[2].passages == "0-60" and got[None].class_id == 1
    assert [got[i].n_links for i in (0, 1, 2, 3)] == [1, 4, 1, 0]
    assert passages.classes(df.limit(0)).count() == 0
    named = passages.classes(df.select(F.concat(F.lit("n"), "doc_id").alias("id"), F.col("text").alias("body"), F.lit(1).alias("d"), F.lit(2).alias("doc_id")), "id", "body")
    assert {r.class_id for r in named.collect() if r.doc_id in ("n1", "n4", "n6")} == {"n1"}


def brute_classes(texts, least=50):
    """Classes of texts that share `least` words in a row, by every run of so many words."""
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    first = {}
    for d, words in texts.items():
        for i in range(len(words) - least + 1):
            a, b = find(first.setdefault(tuple(words[i : i + least]), d)), find(d)
            root[max(a, b)] = min(a, b)
    return {d: find(d) for d in texts}


def similarity(a, b):
    p, q = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(p & q) / len(p | q)


def test_passages_of_frequent_lines(spark):
    """Lines that many documents have, hot passages and copies: what two documents share of 50 words or more is found."""
    rnd = random.Random(21)
    vocabulary = [f"v{i}" for i in range(3000)]
    lines = [[rnd.choice(vocabulary) for _ in range(rnd.choice([12, 20, 30]))] for _ in range(60)]
    hot = [[rnd.choice(vocabulary) for _ in range(70)] for _ in range(2)]
    texts = {}
    for i in range(500):
        words = [w for _ in range(rnd.randint(3, 9)) for w in rnd.choice(lines)]
        for p in range(2):
            if rnd.random() < 0.1:
                at = rnd.randrange(len(words))
                words[at:at] = hot[p]
        texts[i] = words
    for i in range(0, 80, 2):
        at = rnd.randrange(len(texts[i]))
        run = [w for _ in range(5) for w in rnd.choice(lines)][:60]
        texts[i][at:at] = run
        texts[i + 1][:0] = run
    fuzzy = {}
    for i in range(40):  # a passage of 120 words with two changed words
        run = [rnd.choice(vocabulary) for _ in range(120)]
        other = list(run)
        for at in rnd.sample(range(20, 100), 2):
            other[at] = "changed"
        texts[1000 + 2 * i], texts[1001 + 2 * i] = [rnd.choice(vocabulary) for _ in range(30)] + run, other + [rnd.choice(vocabulary) for _ in range(40)]
        fuzzy[1000 + 2 * i] = 1001 + 2 * i
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in passages.classes(df).collect()}
    want = brute_classes(texts)
    linked = [d for d in texts if want[d] != d or d in {want[e] for e in texts if e != d}]
    missed = [d for d in linked if got[d].class_id != got[want[d]].class_id]
    assert len(linked) > 150 and len(missed) <= 0.02 * len(linked)
    assert sum(got[a].class_id == got[b].class_id for a, b in fuzzy.items()) >= 0.95 * len(fuzzy)
    for d, r in got.items():  # all that is found is a passage
        assert (r.n_links > 0) == bool(r.passages) and all(int(b) - int(a) >= 50 for a, b in (p.split("-") for p in r.passages.split(",") if p))
    sizes = Counter(r.class_id for r in got.values())
    assert all(r.n_links == sizes[r.class_id] - 1 for r in got.values())
    by_text = {" ".join(w): w for w in texts.values()}
    texts_df = df.select(F.xxhash64("text").alias("d"), "text").dropDuplicates(["d"])
    own = {r.d: by_text[r.text] for r in texts_df.collect()}
    for r in passages.repeats(texts_df).collect():
        a, b = own[r.a][r.a_from : r.a_to], own[r.b][r.b_from : r.b_to]
        assert min(len(a), len(b)) >= 50 and similarity(a, b) >= 0.75 and r.similarity >= 0.8


def test_passages_longer_than_what_is_read_at_first(spark):
    rnd = random.Random(3)
    run = [f"w{rnd.randrange(10**6)}" for _ in range(9000)]
    docs = [(1, " ".join(run)), (2, " ".join(["own", "start"] + run[:4000] + [f"new{i}" for i in range(300)] + run[4100:])), (3, " ".join(run[3000:3080]))]
    got = {r.doc_id: r for r in passages.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1].passages == "0-9000" and got[2].class_id == got[3].class_id == 1
    a = np.array([hash(w) & 0xFFFFFFFF for w in run[:3000]], "<u4")
    b = np.concatenate([a[:500], np.arange(2000, dtype="<u4"), a[700:]])
    columns = passages._between(a, b)
    assert sum(c[0] for c in columns) == len(a) and sum(c[1] for c in columns) == len(b) and sum(c[2] for c in columns) == 2800


def test_chains_by_fenwick_tree():
    rnd = random.Random(1)
    for _ in range(30):
        n = rnd.randint(2, 25)
        x = np.array([rnd.randint(0, 60) for _ in range(n)])
        y = np.array([rnd.randint(0, 60) for _ in range(n)])
        pts = sorted(zip(x.tolist(), y.tolist(), strict=True))
        best = {}
        for i, (a, b) in enumerate(pts):
            best[i] = passages.K + max([0.0, *(best[j] - 0.05 * (a - c + b - d) for j, (c, d) in enumerate(pts[:i]) if c < a and d < b)])
        chain = passages.chains(x, y)[0]
        px, py = x[chain], y[chain]
        assert (np.diff(px) > 0).all() and (np.diff(py) > 0).all()
        score = passages.K * len(chain) - 0.05 * (px[-1] - px[0] + py[-1] - py[0])
        assert abs(score - max(best.values())) < 1e-6


def test_passages_that_consist_of_frequent_spans(spark):
    """Runs of 50 words whose every part of 49 is in many texts: the two that share the whole run are found, exactly, and no other."""
    rnd = random.Random(12)
    own = lambda n: [f"o{rnd.randrange(10**9)}" for _ in range(n)]
    texts, pairs = {}, []
    for g in range(10):
        run = own(50)
        for k in range(14):
            texts[100 * g + k] = own(30) + (run[:49] if k % 2 else run[1:]) + own(30)
        texts[100 * g + 50], texts[100 * g + 51] = own(25) + run + own(40), own(60) + run + own(20) + run + own(9)
        pairs.append((100 * g + 50, 100 * g + 51))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in passages.classes(df).collect()}
    linked = {d for d, r in got.items() if r.n_links}
    assert linked == {d for p in pairs for d in p}
    for a, b in pairs:
        assert got[a].class_id == got[b].class_id == a and (got[a].passages, got[b].passages) == ("25-75", "60-110,130-180")


def test_all_runs_of_frequent_lines(spark):
    """No text that shares 50 words in a row with another is missed, whatever lines it consists of and repeats."""
    rnd = random.Random(5)
    lines = [[f"v{rnd.randrange(4000)}" for _ in range(rnd.choice([9, 14, 22]))] for _ in range(14)]
    texts = {i: [w for _ in range(rnd.randint(3, 8)) for w in rnd.choice(lines)] + [f"o{i}-{k}" for k in range(5)] for i in range(400)}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in passages.classes(df).collect()}
    spoken = {d: re.findall(r"[0-9a-z]+", " ".join(w)) for d, w in texts.items()}
    want = brute_classes(spoken)
    assert all(got[d].class_id == got[c].class_id for d, c in want.items())
    holders = defaultdict(set)
    for d, w in spoken.items():
        for i in range(len(w) - 49):
            holders[tuple(w[i : i + 50])].add(d)
    for d, w in spoken.items():
        covered = {k for p in got[d].passages.split(",") if p for k in range(*map(int, p.split("-")))}
        assert all(set(range(i, i + 50)) <= covered for i in range(len(w) - 49) if len(holders[tuple(w[i : i + 50])]) > 1), d


def plain_align(a, b, x, y):
    """Passages along a chain column by column, every part of it looked at."""
    lead, k = int(min(x[0], y[0])), passages.K
    cols = [(1, 1, bool(a[x[0] - n] == b[y[0] - n])) for n in range(lead, 0, -1)]
    for i, j, p, q in zip(x[:-1].tolist(), y[:-1].tolist(), x[1:].tolist(), y[1:].tolist(), strict=True):
        keep = min(k, p - i, q - j) if p - i != q - j else p - i
        cols += [(1, 1, bool(a[i + n] == b[j + n])) for n in range(keep)] + passages._between(a[i + keep : p], b[j + keep : q])
    cols += [(1, 1, bool(u == v)) for u, v in zip(a[x[-1] :].tolist(), b[y[-1] :].tolist(), strict=False)]
    at = [np.cumsum([int(x[0]) - lead] + [c[0] for c in cols]), np.cumsum([int(y[0]) - lead] + [c[1] for c in cols])]
    same, out, todo = np.array([c[2] for c in cols]), [], [(0, len(cols), 0)]
    while todo:
        lo, hi, level = todo.pop()
        if same[lo:hi].sum() < 40:
            continue
        total = np.concatenate([[0], np.cumsum(np.where(same[lo:hi], 1, -(4, 12, 40, 10**6)[level]))])
        end = int((total - np.minimum.accumulate(total)).argmax())
        s, e = lo + int(np.flatnonzero(total[: end + 1] == total[: end + 1].min())[-1]), lo + end
        if e <= s:
            continue
        todo += [(lo, s, level), (e, hi, level)]
        na, nb = (int(z[e] - z[s]) for z in at)
        if min(na, nb) < 50:
            continue
        shared = sum(bool(same[n : n + k].all()) for n in range(s, e - k + 1))
        similar = shared / (na - k + 1 + nb - k + 1 - shared)
        if similar >= 0.8:
            out.append((int(at[0][s]), int(at[0][e]), int(at[1][s]), int(at[1][e]), round(similar, 6)))
        elif level < 3:
            todo.append((s, e, level + 1))
    return sorted(out)


def test_alignment_skips_no_passage():
    """What is passed over has no passage, at the least similarity and length, too."""
    rnd = random.Random(9)
    found = Counter()
    for n in range(600):
        a = [rnd.randrange(10**6) for _ in range(rnd.randint(50, 260))]
        if n % 3 == 0:  # lines that repeat
            a = (a[: rnd.randint(5, 40)] * 50)[: len(a)]
        b = list(a)
        for at in sorted(rnd.sample(range(len(a)), rnd.choice([0, 1, 2, 3, 6, 12])), reverse=True):
            b[at : at + 1] = [[-1], [], [-1, -2, b[at]], [-1]][rnd.randrange(4) if n % 2 else 0]
        a, b = [rnd.randrange(10**6) for _ in range(rnd.randint(0, 9))] + a, [rnd.randrange(10**6) for _ in range(rnd.randint(0, 9))] + b
        places = defaultdict(list)
        for j in range(len(b) - 4):
            places[tuple(b[j : j + 5])].append(j)
        met = [(i, j) for i in range(0, len(a) - 4, 4) for j in places[tuple(a[i : i + 5])][:6]]
        if not met:
            continue
        p, q, x, y = np.array(a, "<i8"), np.array(b, "<i8"), np.array([i for i, _ in met]), np.array([j for _, j in met])
        for c in passages.chains(x, y)[:4]:
            got = passages.align(p, q, x[c], y[c])
            assert got == plain_align(p, q, x[c], y[c])
            found[len(np.unique(x[c] - y[c])) == 1, bool(got)] += 1
    assert min(found[s, g] for s in (True, False) for g in (True, False)) > 20


def test_least_of_every_window():
    rnd = np.random.default_rng(4)
    for n, w in ((16, 16), (17, 16), (300, 16), (90, 7), (5, 1), (40, 13)):
        h = rnd.integers(0, 12, n).astype(np.uint64)
        want = np.unique(np.lib.stride_tricks.sliding_window_view(h, w).argmin(axis=1) + np.arange(n - w + 1))
        assert passages._least(h, w).tolist() == want.tolist()


def test_chains_on_one_diagonal_are_aligned_once(monkeypatch):
    """Two texts that repeat a line have a chain for each pair of its places; all on one diagonal have the same passages."""

    class Cut:
        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    count, align = [0], passages.align
    monkeypatch.setattr(passages, "align", lambda *args: (count.__setitem__(0, count[0] + 1), align(*args))[1])
    words = np.array([*range(30)] * 20 + [99], "<u4")
    rows = []
    for shift in (0, 30):
        for i in range(150):
            x, y = np.array([3 * i + shift, 3 * i + shift + 20], "<i4"), np.array([3 * i, 3 * i + 20], "<i4")
            rows.append({"a": 1, "b": 2, "i": len(rows), "xs": x.tobytes(), "ys": y.tobytes(), "wa": words.tobytes(), "oa": 0, "na": len(words), "wb": words[:-1].tobytes(), "ob": 0, "nb": len(words) - 1})
    schema = pa.schema([(n, pa.binary() if n in ("xs", "ys", "wa", "wb") else pa.int64() if n in "ab" else pa.int32()) for n in rows[0]])
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 64], schema) for i in range(0, 300, 64)]
    got = [r for b in passages._aligned(Cut())(iter(batches)) for r in b.to_pylist()]
    assert [(r["i"], r["a_from"], r["a_to"], r["b_from"], r["b_to"], r["similarity"], r["open"]) for r in got] == [(i, 0, 600, 0, 600, 1.0, False) if i < 150 else (i, 30, 600, 0, 570, 1.0, False) for i in range(300)]
    assert count[0] == 2
