"""Chat formatting: tool calls linked to results, ordered, validated and serialised. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import forget, saved, table

#: Schema rows (tool, field) up to which they are broadcast.
BROADCAST_FIELDS = 10_000
NAMES = {"STRING": "string", "BIGINT": "integer", "BOOLEAN": "boolean", "VOID": "null"}


def levels(calls: DataFrame) -> DataFrame:
    """(id, level) per distinct id of calls (id, after): the length of the longest chain of calls that must come before.

    `after` names a call that must be done first; several rows of an id name several, ids that no call has are
    ignored. Each id follows one of those it comes after, and the lengths of these walks are found by pointer
    doubling (a chain of n calls takes log n joins). Where another of them has a longer walk, the id follows that one
    instead, until nothing changes; a walk that doesn't end counts as the longest. Ids in a cycle, or after one,
    have a null level.
    """
    named = calls.where("id IS NOT NULL")
    own = saved(named.select("id").distinct())
    edges = saved(named.where("after IS NOT NULL").select("id", "after").distinct().join(own.select(F.col("id").alias("after")), "after").select("id", "after"))
    follows = saved(edges.groupBy("id").agg(F.max("after").alias("jump")))
    while True:
        found = _walks(own, follows)
        rank = F.struct(F.col("level").isNull().alias("endless"), F.coalesce("level", F.lit(0).cast("long")).alias("level"))
        ahead = edges.join(found.select(F.col("id").alias("after"), rank.alias("r")), "after").groupBy("id").agg(F.max_by("after", F.struct("r", "after")).alias("jump"), F.max("r").alias("r"))
        better = ahead.join(found, "id").where("level IS NOT NULL AND (r.endless OR r.level + 1 > level)").select("id", "jump")
        better = saved(better)
        if better.isEmpty():
            return found
        old, follows = follows, saved(follows.join(better, "id", "left_anti").unionByName(better))
        forget(old, better, found)


def _walks(own: DataFrame, follows: DataFrame) -> DataFrame:
    """(id, level) of each id of own: how many steps follows (id, jump) leads on from it, null if without an end."""
    steps = F.when(F.col("jump").isNull(), 0).otherwise(1).cast("long")
    now = saved(own.join(follows, "id", "left").select("id", "jump", steps.alias("level")))
    for _ in range(max(1, now.count()).bit_length() + 1):
        if now.where("jump IS NOT NULL").isEmpty():
            break
        ahead = now.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("level").alias("more"))
        rest = now.where("jump IS NOT NULL").join(ahead, "jump").select("id", F.col("next").alias("jump"), (F.col("level") + F.col("more")).alias("level"))
        old, now = now, saved(now.where("jump IS NULL").unionByName(rest))
        forget(old)
    return saved(now.select("id", F.when(F.col("jump").isNull(), F.col("level")).alias("level")))


def _kind(fields: Column, name: Column) -> Column:
    """The JSON type of a field, of a map of variants; null if there is none."""
    made = F.schema_of_variant(F.try_element_at(fields, name))
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), made), F.lit(None).cast("string"))
    return F.when(made.startswith("OBJECT"), "object").when(made.startswith("ARRAY"), "array").when(made.startswith("DECIMAL") | (made == "DOUBLE"), "number").otherwise(kind)


def errors(fields: Column, v: Column, parts: Column, keys: Column) -> Column:
    """What is wrong with the arguments v, in parts, under the fields (field, kind, required) of a tool; fields null: unknown tool."""
    missing = F.transform(F.filter(fields, lambda f: f["required"] & ~F.array_contains(keys, f["field"])), lambda f: F.concat(F.lit("missing:"), f["field"]))
    fits = lambda f: (_kind(parts, f["field"]) == f["kind"]) | ((f["kind"] == "number") & (_kind(parts, f["field"]) == "integer"))
    typed = F.transform(F.filter(fields, lambda f: F.array_contains(keys, f["field"]) & ~F.coalesce(fits(f), F.lit(False))), lambda f: F.concat(F.lit("type:"), f["field"]))
    extra = F.transform(F.array_except(keys, F.transform(fields, lambda f: f["field"])), lambda k: F.concat(F.lit("unknown:"), k))
    found = F.array_sort(F.concat(missing, typed, extra))
    return F.when(fields.isNull(), F.array(F.lit("tool"))).when(v.isNull() | keys.isNull(), F.array(F.lit("json"))).otherwise(found)


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """One row per call, with the least result of its identifier; one per further result, and per result without a call.

    calls (id, tool, arguments JSON, after), results (id, content), schemas (tool, field, kind, required), order
    (id, after) with further calls that must come first; no other columns are read. Returns id, level, status,
    n_results, errors and `record`: canonical JSON, keys sorted, no white space. Status is invalid, cyclic,
    unanswered, ambiguous (several results), linked, or orphan for results without a call. Results are reduced to
    their different contents before the join and only the least is joined, so no id, however frequent, multiplies
    rows. Calls that repeat an id stay, each with that id's result. Calls without an id are unanswered and have
    level 0; results without one are dropped. Arguments that aren't a JSON object are invalid, null ones too.
    """
    calls = calls.select("id", "tool", "arguments", "after")
    different = saved(results.where("id IS NOT NULL").groupBy("id", "content").agg(F.count("*").alias("copies")))
    answers = different.groupBy("id").agg(F.sum("copies").alias("n_results"), F.min("content").alias("content"))
    more = different.join(answers.select("id", "n_results", F.col("content").alias("least")), "id").where(~F.col("content").eqNullSafe(F.col("least"))).select("id", "n_results", "content")
    fields = schemas.groupBy("tool").agg(F.array_sort(F.collect_list(F.struct("field", "kind", "required"))).alias("fields"))
    if schemas.count() <= BROADCAST_FIELDS:
        fields = F.broadcast(fields)
    edges = calls.select("id", "after")
    placed = levels(edges if order is None else edges.unionByName(order.select("id", "after")).join(calls.select("id").distinct(), "id", "left_semi"))
    known = answers.join(placed, "id", "full").withColumn("answered", F.coalesce(F.col("n_results"), F.lit(0).cast("long")))
    rows = calls.join(fields, "tool", "left").withColumn("called", F.lit(True))
    ids = calls.select("id").distinct()
    orphans = known.where("answered > 0").join(ids, "id", "left_anti").unionByName(more.join(ids, "id", "left_anti").withColumnRenamed("n_results", "answered"), allowMissingColumns=True)
    further = more.join(ids, "id", "left_semi").withColumnRenamed("n_results", "answered").withColumn("further", F.lit(True))
    nameless = rows.where("id IS NULL")  # they match nothing, and would all meet in one task
    rows = rows.where("id IS NOT NULL").join(known, "id", "left").withColumn("further", F.lit(False))
    rows = rows.unionByName(nameless, allowMissingColumns=True).unionByName(orphans, allowMissingColumns=True).unionByName(further, allowMissingColumns=True)
    v, keys = F.try_parse_json("arguments"), F.json_object_keys("arguments")
    rows = rows.withColumns({"v": v, "keys": keys, "parts": F.when(v.isNotNull() & keys.isNotNull(), F.from_json("arguments", "map<string,variant>"))})
    rows = rows.withColumns({"errors": F.when(F.col("called"), errors(F.col("fields"), F.col("v"), F.col("parts"), F.col("keys"))), "n_results": F.coalesce("answered", F.lit(0).cast("long"))})
    cyclic = F.col("id").isNotNull() & F.col("level").isNull()
    status = (
        F.when(F.col("further"), "ambiguous").when(F.col("called").isNull(), "orphan").when(F.size("errors") > 0, "invalid").when(cyclic, "cyclic")
        .when(F.col("n_results") == 0, "unanswered").when(F.col("n_results") > 1, "ambiguous").otherwise("linked")
    )
    level = F.when(F.col("id").isNull(), F.lit(0).cast("long")).otherwise(F.col("level"))
    rows = rows.withColumns({"status": status, "level": level})
    body = F.struct(F.col("v").alias("arguments"), F.col("errors"), F.col("id"), F.col("level"), F.col("content").alias("result"), F.col("status"), F.col("tool"))
    return rows.select("id", "tool", "level", "status", "n_results", "errors", F.to_json(body).alias("record"))


def from_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and order of chat messages (conv_id, turn, role, text).

    What a user or the system says is a call of the tool of that name, with the text, the turn and, if it has
    line breaks, their number; it comes after the call two turns before, and what a user says also after what
    the system says in turn 0. What the assistant says is the result of the turn before. Other roles, and rows
    without conv_id or turn, are neither.
    """
    rows = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    name = lambda turn: F.concat_ws(":", "conv_id", turn)
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    said = F.to_json(F.struct(F.when(breaks > 0, breaks).alias("breaks"), F.col("text").alias("text"), F.col("turn").alias("turn")))
    calls = rows.where(F.col("role").isin("user", "system")).select(name(F.col("turn")).alias("id"), F.col("role").alias("tool"), said.alias("arguments"), name(F.col("turn") - 2).alias("after"))
    order = rows.where("role = 'user' AND turn <> 0").select(name(F.col("turn")).alias("id"), name(F.lit(0)).alias("after"))
    order = order.join(rows.where("role = 'system' AND turn = 0").select(name(F.lit(0)).alias("after")).distinct(), "after", "left_semi").select("id", "after")
    return calls, rows.where("role = 'assistant'").select(name(F.col("turn") - 1).alias("id"), F.col("text").alias("content")), order


def message_schemas(spark: SparkSession) -> DataFrame:
    """Both tools take a text and the number of the turn; only a user's text may have line breaks."""
    rows = [(t, f, k, True) for t in ("user", "system") for f, k in (("text", "string"), ("turn", "integer"))]
    return spark.createDataFrame([*rows, ("user", "breaks", "integer", False)], "tool string, field string, kind string, required boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, order = from_messages(table(spark, sf_dir, "conversations"))
    found = link(calls, results, message_schemas(spark), order)
    return found.select("id", "tool", "level", "status", "n_results", F.sha2(F.coalesce("record", F.lit("")), 256).alias("record_sha256"), F.octet_length("record").cast("long").alias("record_bytes"))


SQL = """
WITH RECURSIVE m AS (SELECT * FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id || ':' || turn AS id, conv_id || ':' || (turn - 2) AS after, conv_id || ':0' AS start, role AS tool, text, turn, nullif(length(text) - length(replace(text, chr(10), '')), 0) AS breaks FROM m WHERE role IN ('user', 'system')),
r0 AS (SELECT conv_id || ':' || (turn - 1) AS id, text AS content, count(*) AS copies FROM m WHERE role = 'assistant' GROUP BY ALL),
r AS (SELECT id, sum(copies)::BIGINT AS n, min(content) AS content FROM r0 GROUP BY id),
e AS (SELECT DISTINCT id, after FROM c WHERE after IN (SELECT id FROM c) UNION SELECT id, start FROM c WHERE tool = 'user' AND turn <> 0 AND start IN (SELECT id FROM c WHERE tool = 'system')),
w(id, level) AS (SELECT DISTINCT id, 0::BIGINT FROM c WHERE id NOT IN (SELECT id FROM e) UNION SELECT e.id, w.level + 1 FROM e JOIN w ON e.after = w.id),
l AS (SELECT id, max(level) AS level FROM w GROUP BY id),
j AS (
  SELECT c.id, c.tool, l.level, CASE WHEN tool = 'system' AND breaks IS NOT NULL THEN 'invalid' WHEN r.n IS NULL THEN 'unanswered' WHEN r.n > 1 THEN 'ambiguous' ELSE 'linked' END AS status, coalesce(r.n, 0)::BIGINT AS n_results,
    '{"arguments":{' || CASE WHEN breaks IS NULL THEN '' ELSE '"breaks":' || breaks || ',' END || '"text":' || to_json(c.text)::VARCHAR || ',"turn":' || c.turn || '},"errors":[' || CASE WHEN tool = 'system' AND breaks IS NOT NULL THEN '"unknown:breaks"' ELSE '' END || '],"id":"' || c.id || '","level":' || l.level
    || CASE WHEN r.n IS NULL THEN '' ELSE ',"result":' || to_json(r.content)::VARCHAR END AS head, ',"tool":"' || c.tool || '"}' AS tail
  FROM c LEFT JOIN l USING (id) LEFT JOIN r USING (id)
  UNION ALL
  SELECT r0.id, NULL, NULL, CASE WHEN r0.id IN (SELECT id FROM c) THEN 'ambiguous' ELSE 'orphan' END, r.n, '{"id":"' || r0.id || '","result":' || to_json(r0.content)::VARCHAR, '}' FROM r0 JOIN r USING (id)
  WHERE r0.id NOT IN (SELECT id FROM c) OR r0.content <> r.content
), k AS (SELECT *, head || ',"status":"' || status || '"' || tail AS record FROM j)
SELECT id, tool, level, status, n_results, sha256(record) AS record_sha256, strlen(record)::BIGINT AS record_bytes FROM k
"""
