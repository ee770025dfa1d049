import hashlib
import re

from ledgerlens.llm import decontam

DOCS = "doc_id long, text string, item_id string, w string, h long"
ITEMS = "item_id long, text string, doc_id long, len int"


def brute(docs, items, n=8):
    def words(t):
        return re.findall(decontam.WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    wins = {}
    for item, t in items:
        w = words(t)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i in range(len(w)):
            for k in {len(x) for x in wins}:
                if tuple(w[i : i + k]) in wins and i + k <= len(w):
                    hit |= set(range(i, i + k))
                    found |= {str(x) for x in wins[tuple(w[i : i + k])] if x is not None}
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=str)


def run(spark, docs, items, tmp_path):
    spark.createDataFrame([(d, t, "x", "y", 1) for d, t in docs], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, t, 1, 1) for d, t in items], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    return sorted(map(tuple, decontam.query(spark, str(tmp_path)).collect()), key=str)


def test_against_brute_force(spark, tmp_path):
    a = "one two three four five six seven eight nine ten"
    b = "Änd été 3 vier fünf sechs sieben acht neun"
    items = [(1, a), (2, b), (10, "Short Item"), (3, ""), (4, None), (5, a), (None, "zz yy xx")]
    docs = [
        (1, f"x {a.upper()} y {a} short-item"), (2, b.replace(" ", "\n")), (3, None), (4, ""), (5, "one two three four five six seven"),
        (6, "short item short item " * 3000), (6, "clean text"), (6, "clean text"), (None, f"{a} / {b}"), (7, "--- ..."), (8, "zz yy xx"), (9, "one\U0001f600two short"),
    ]
    assert run(spark, docs, items, tmp_path) == brute(docs, items)


def test_removal_and_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    docs = spark.createDataFrame([(1, "a b c d e f g h i", "x", "y", 1), (2, "a b c d e f g h k l", "x", "y", 1), (3, None, "x", "y", 1)], DOCS)
    items = spark.createDataFrame([(1, "A b c d e f g h", 1, 1), (2, "a b c d e f g h i", 1, 1)], ITEMS)
    assert decontam.decontaminate(docs, none).count() == 3
    assert decontam.decontaminate(docs.limit(0), items).count() == 0
    kept = decontam.decontaminate(docs, items)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.orderBy("doc_id").collect()] == [3]
    assert [r.words for r in decontam.remove_spans(docs, items).orderBy("doc_id").collect()] == [[], ["k", "l"], []]


def test_shuffled_windows_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "p q r s t u v w x" if i % 3 else "other", "x", "y", 1) for i in range(30)], DOCS)
    items = spark.createDataFrame([(1, "q r s t u v w x", 1, 1)], ITEMS)
    one = sorted(map(str, decontam.scan(docs, items).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert sorted(map(str, decontam.scan(docs, items).collect())) == one
