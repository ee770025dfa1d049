import random

import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import simhash

SCHEMA = "doc_id long, text string, fp string, n int"


def brute(rows):
    def lower(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def words(t):
        out, cur = [], ""
        for c in lower(t or ""):
            if c in " \t\n\x0b\x0c\r":
                out.append(cur)
                cur = ""
            else:
                cur += c
        return [w for w in [*out, cur] if w]

    def print_of(t):
        w = words(t)
        k = min(3, len(w))
        hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    prints = [print_of(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=str)


def cases():
    rnd = random.Random(5)
    rows = []
    for i in range(60):
        w = [rnd.choice("ab cd ef Gh ÄÉ ij k lm no pq rs".split(" ")) + str(rnd.randint(0, 40)) for _ in range(rnd.randint(1, 120))]
        rows.append((i, " ".join(w)))
        if i % 3 == 0 and len(w) > 1:
            w[rnd.randrange(len(w))] = "edit"
            rows.append((100 + i, "\n".join(w)))
        if i % 10 == 0:
            rows.append((200 + i, rows[i][1].upper().replace("É", "é") if i else rows[i][1]))
    return rows + [(300, None), (301, ""), (302, " \t\n"), (None, "one"), (303, "one"), (304, "One two"), (304, "One two"), (None, "only here nameless text"), (305, "x " * 30000)]


def test_against_brute_force(spark):
    rows = cases()
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA).repartition(5)
    assert sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str) == brute(rows)


def test_large_buckets_reach_the_same_components(spark):
    rnd = random.Random(3)
    base = rnd.getrandbits(63)
    prints = {base, *(base ^ (1 << rnd.randrange(62)) ^ (1 << rnd.randrange(62)) for _ in range(80)), *(rnd.getrandbits(63) for _ in range(40))}
    prints |= {p ^ 0b11 for p in list(prints)[:20]} | {-1, -2, -4}
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    from ledgerlens.llm.common import components

    def groups(paired):
        return sorted(map(tuple, components(simhash.links(df, paired=paired)).collect()))

    assert groups(2) == groups(10**6) != []


def test_empty_table_and_stage(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0
    df = spark.createDataFrame([(1, "a b c d", "z", 1), (2, "a b c d", "z", 1), (1, "a b c d", "z", 1), (None, "a b c d", "z", 1), (None, "nameless", "z", 1), (None, "nameless", "z", 2), (7, "other words", "z", 1)], SCHEMA)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(1, "a b c d"), (7, "other words"), (None, "nameless")]


def test_attach_keeps_every_row_of_hot_keys(spark):
    from ledgerlens.llm.common import attach

    big = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    small = big.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    got = attach(big, small, "k", "n")
    assert got.count() == 1000 and got.where("low IS NULL").count() == 0


def test_stage_drops_near_copies(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(40):
        t = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(100, 400))]
        rows.append((i, " ".join(t)))
        for j, edits in ((1, 1), (2, len(t) // 60), (3, len(t) // 5)):
            u = list(t)
            for at in rnd.sample(range(len(u)), edits):
                u[at] = "edit"
            rows.append((100 * j + i, " ".join(u)))

    def runs(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets = {d: runs(t) for d, t in rows}
    roots = {}
    for d in sorted(sets):  # groups by links of 0.8 or more
        near = {roots[e] for e in roots if len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e])}
        roots = {e: min(near | {d}) if r in near else r for e, r in roots.items()} | {d: min(near | {d})}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert kept == set(roots.values()) and len(kept) == 80
