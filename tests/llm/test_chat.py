import json
import random

from pyspark.sql import functions as F

from ledgerlens.llm import chat


def test_linking(spark):
    calls = spark.createDataFrame(
        [
            ("a", "add", '{"y": 2, "x": 1}', None, 1), ("b", "add", '{"x": 1.5, "y": "no"}', "a", 1), ("c", "add", '{"x": 1}', "b", 1), ("d", "add", "[1]", "c", 1), ("e", "add", None, "gone", 1), ("f", "lost", "{}", "a", 1),
            ("g", "add", '{"x": 1, "y": 2, "z": 3}', "h", 1), ("h", "add", '{"x": 1, "y": 2}', "g", 1), ("a", "add", '{"x": 3, "y": 4}', None, 1), (None, "add", '{"x": 1, "y": 2}', None, 1), (None, "add", '{"x": 1, "y": 2}', None, 1), ("k", "add", '{"x": 1, "y": 2}', "h", 1),
        ],
        "id string, tool string, arguments string, after string, level int",
    )
    clash = {n: F.lit(1) for n in ("v", "keys", "fields", "called", "answered", "n_results", "status", "parts", "further", "errors", "copies")}
    calls = calls.withColumns(clash | {"content": F.lit("none")})
    results = spark.createDataFrame([("a", "3"), ("k", "z"), ("k", "y"), ("k", "y"), ("orphan", "text\n\"é\""), ("orphan", "second"), (None, "n")], "id string, content string").withColumns(clash | {"tool": F.lit("t")})
    schemas = spark.createDataFrame([("add", "x", "number", True), ("add", "y", "integer", True)], "tool string, field string, kind string, required boolean")
    got = chat.link(calls, results, schemas).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert len(got) == 15
    assert {r.status for r in by["a"]} == {"linked"} and {json.loads(r.record)["arguments"]["x"] for r in by["a"]} == {1, 3}
    assert by["b"][0].errors == ["type:y"] and by["b"][0].level == 1 and by["c"][0].errors == ["missing:y"] and by["c"][0].level == 2
    assert by["d"][0].errors == ["json"] and by["e"][0].errors == ["json"] and by["f"][0].errors == ["tool"]
    assert by["g"][0].errors == ["unknown:z"] and by["h"][0].status == "cyclic" and sorted((r.status, r.n_results) for r in by["k"]) == [("ambiguous", 3), ("cyclic", 3)]
    assert [r.record for r in by["k"] if r.status == "ambiguous"] == ['{"id":"k","result":"z","status":"ambiguous"}']
    assert [r.status for r in by[None]] == ["unanswered"] * 2 and {r.status for r in by["orphan"]} == {"orphan"}
    assert max(r.record for r in by["orphan"]) == '{"id":"orphan","result":"text\\n\\"é\\"","status":"orphan"}'
    record = [r.record for r in by["a"] if '"x":1' in r.record][0]
    assert record == '{"arguments":{"x":1,"y":2},"errors":[],"id":"a","level":0,"result":"3","status":"linked","tool":"add"}'


def test_long_chains_and_empty_tables(spark):
    chain = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(300)], "id string, after string")
    got = {r.id: r.level for r in chat.levels(chain).collect()}
    assert got == {str(i): i for i in range(300)}
    messages = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    calls, results, order = chat.from_messages(messages)
    assert chat.link(calls, results, chat.message_schemas(spark), order).count() == 0
    some = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "b"), (None, 2, "user", "x"), (2, None, "user", "x"), (3, 0, "tool", "t")], "conv_id long, turn long, role string, text string")
    calls, results, order = chat.from_messages(some)
    got = sorted((r.id, r.status, r.n_results, r.errors) for r in chat.link(calls, results, chat.message_schemas(spark), order).collect())
    assert got[0][:3] == ("1:0", "ambiguous", 2) and got[1] == ("1:0", "invalid", 2, ["missing:text"]) and len(got) == 2


def test_levels_against_longest_paths(spark):
    rnd = random.Random(11)
    edges = [(f"n{i}", f"n{j}") for i in range(1, 16) for j in {rnd.randrange(max(0, i - 4), i) for _ in range(rnd.choice([1, 1, 2]))}]
    edges += [("n0", "missing"), ("n0", None), ("c1", "c2"), ("c2", "c1"), ("after", "c1"), ("self", "self"), ("two", "n5"), ("two", "after")]
    want = {}
    for i in range(16):
        own = f"n{i}"
        want[own] = max((want[b] + 1 for a, b in edges if a == own and b in want), default=0)
    edges += [(f"m{i}", f"m{j}") for i in range(1, 30) for j in {0, i - 1}]  # all after the first, and each after the one before it
    want |= {f"m{i}": i for i in range(30)}
    edges += [("m0", None), ("c3", "m5"), ("c3", "c4"), ("c4", "c3")]
    got = {r.id: r.level for r in chat.levels(spark.createDataFrame(edges, "id string, after string")).collect()}
    assert got == want | {k: None for k in ("c3", "c4")} | {k: None for k in ("c1", "c2", "after", "self", "two")}


def test_quoted_fields_and_long_texts(spark):
    calls = spark.createDataFrame([("a", "t", '{"it\'s": 1, "b.c": "x", "d\\"e": [1], "f g": {"h": null}}', None), ("b", "t", '{"it\'s": "no", "it\'s": 2}', "a"), ("c", "t", '{"it\'s": 1, "b.c": "' + "long " * 100_000 + '"}', "b")], "id string, tool string, arguments string, after string")
    schemas = spark.createDataFrame([("t", "it's", "integer", True), ("t", "b.c", "string", False), ("t", 'd"e', "array", False), ("t", "f g", "object", False)], "tool string, field string, kind string, required boolean")
    results = spark.createDataFrame([("a", "r"), ("c", "r")], "id string, content string")
    got = {r.id: (r.status, r.errors, r.level) for r in chat.link(calls, results, schemas).collect()}
    assert got["a"] == ("linked", [], 0) and got["b"] == ("invalid", ["json"], 1) and got["c"] == ("linked", [], 2)
