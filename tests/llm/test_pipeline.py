import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
from test_texts import brute_scores, brute_spans
from tokenizers import Tokenizer

from ledgerlens.llm import toxicity
from ledgerlens.llm.bpe import default_path


def runs(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def windows(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    return {tuple(w[i : i + 8]) for i in range(len(w) - 7)} if len(w) >= 8 else {tuple(w)} if w else set()


def corpus():
    """Documents with toxic words, copies, near copies, benchmark passages of one item, and personal data."""
    rnd = random.Random(31)
    vocabulary = [f"w{i}" for i in range(900)]
    say = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(30))) for i in range(4)] + [(9, "only three words")]
    docs, labels = [], []
    for i in range(240):
        words = say(rnd.randint(40, 90))
        if i % 6 == 0:
            for w in rnd.sample(["scumbag", "vermin", "filth"], 2):
                words.insert(rnd.randrange(len(words)), w)
        if i % 10 == 3:
            at = rnd.randrange(len(words))
            words[at:at] = items[i % 4][1].split()[5:20]
        if i % 12 == 5:
            words.insert(20, f"mail u{i}@m{i % 7}.co now")
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    for i in range(0, 60, 4):
        words = docs[i + 1][1].split()
        docs.append((300 + i, docs[i][1]))
        docs.append((400 + i, " ".join(w if k != 7 else "edited" for k, w in enumerate(words))))
    docs += [(500, None), (501, ""), (502, None), (503, "only three words"), (504, "x " * 20_000)]
    return items, docs, labels


def expected(docs, items, labels, ids):
    """Rows of the pipeline by plain loops over the stages' words."""
    text, told = dict(docs), dict(labels)
    scores = brute_scores([(text[i], told[i]) for i in ids], [t for _, t in docs])
    kept = [d for (d, _), s in zip(docs, scores, strict=True) if s < 0.7]
    sets = {d: runs(text[d]) for d in kept}
    root = {d: d for d in kept}
    for d in sorted(kept):
        near = {root[e] for e in kept if e < d and (sets[d] == sets[e] or len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e]))}
        root = {e: min(near | {d}) if r in near | {d} else r for e, r in root.items()}
    kept = [d for d in kept if root[d] == d]
    held = {w for _, t in items for w in windows(t)}
    short = {w for w in held if len(w) < 8}
    leaks = lambda t: bool(windows(t) & held) or any(" ".join(w) in " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())) for w in short)
    return {d for d in kept if not leaks(text[d])}


def test_rows_against_plain_loops(spark, tmp_path):
    items, docs, labels = corpus()
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int")
    for name, df in (("documents", d), ("labels", lab), ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    model = toxicity.fit(d, lab)
    want = expected(docs, items, labels, [int(i) for i in model.ids])
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == want and 100 < len(want) < 220
    gone = {i for i, _ in docs} - want
    assert {i for i in range(240) if i % 10 == 3} <= gone and {i for i in range(0, 240, 6)} <= gone and {503} <= gone and {300 + i for i in range(0, 60, 4)} <= gone
    text, library = dict(docs), Tokenizer.from_file(default_path())
    clean = {i: "" if text[i] is None else text[i] for i in want}
    for i, t in clean.items():
        spans = [s.split(":") for s in brute_spans(t).split(",") if s]
        for kind, a, b in spans[::-1]:
            t = f"{t[: int(a)]}[{kind.upper()}]{t[int(b) :]}"
        assert (len(spans) > 0) == ("@" in clean[i])
        ids = library.encode(t, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].decoded_sha256) == (len(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()), i


def test_stages_take_any_columns_and_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, th string, base string, _id long, _th string, c int, score double"
    rows = [(None, "some text", "l", "s", 9, "x", "y", 1, "z", 2, 0.5), (None, None, None, None, None, None, None, None, None, None, None), (1, "same text", "l", "s", 9, "x", "y", 1, "z", 2, 0.5), (1, "same text", "l", "s", 9, "x", "y", 1, "z", 2, 0.5), (1, "an entirely different text", "l", "s", 26, "x", "y", 1, "z", 2, 0.5)]
    docs = spark.createDataFrame(rows, schema)
    for df in (docs, docs.limit(0)):
        now = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, "/root/testdata/sf0.001")
            assert now.columns == df.columns, name
            assert now.count() <= df.count()
    one = Counter((r.doc_id, r.text) for r in corpus_pipeline.STAGES[1][1](spark, docs, "").collect())
    assert one == {(None, "some text"): 1, (None, None): 1, (1, "same text"): 1, (1, "an entirely different text"): 1}


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "pii", "bpe"]
