"""Tool-call linking for chat data.

Calls and their results meet in a hash join on (conversation, call id).  Calls
are put in topological order by the length of the longest chain of
dependencies below them, found by pointer doubling (``levels``): a chain of n
calls takes about log2(n) joins, and a long conversation is no single task's
work.  Arguments are parsed as variants, checked against a schema per tool, and written back as
canonical JSON (sorted keys, no white space).

Only DataFrame functions are used.  The schemas are code: they become
expressions, never a join.

* A call id given twice in a conversation is one call: the first by (issued,
  name, arguments); ``n_calls`` counts them.
* Several results of a call: the first by (issued, content); ``n_results``.
* A result without a call is a row of its own with status ``orphan``; a call
  without a result is ``unanswered``.  Null call ids never match.
* A dependency that is no call of the conversation is ignored and reported;
  calls in or behind a cycle have no level.
* Arguments that are null or no JSON object are invalid, and null in the
  canonical form.  A tool without a schema is reported.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import materialise, table

QUERY = "op1_tool_calls"

ENDLESS = 1 << 30  # the level of calls in or behind a cycle

TYPES = {  # JSON type: pattern of a variant's schema
    "string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*",
    "boolean": "BOOLEAN", "array": "ARRAY<.*>", "object": "OBJECT<.*>", "null": "VOID",
}


def argument_errors(args: Column, name: Column, schemas: dict) -> Column:
    """Violations of the tool's schema, in the schema's order.

    A schema has ``properties`` (type, enum, minimum, maximum), ``required``
    and ``additional`` (whether other keys are allowed)."""
    fields = F.try_variant_get(args, "$", "map<string,variant>")
    known = F.lit(None).cast("array<string>")
    for tool, schema in schemas.items():
        checks = []
        for key, rule in schema["properties"].items():
            value = F.element_at(fields, key)
            text = value.try_cast("string")
            if key in schema.get("required", ()):
                checks.append(F.when(value.isNull(), F.lit(f"{key}: missing")))
            if "type" in rule:
                right = F.schema_of_variant(value).rlike(f"^({TYPES[rule['type']]})$")
                checks.append(F.when(~right, F.lit(f"{key}: not {rule['type']}")))
            if "enum" in rule:
                checks.append(F.when(~text.isin(*rule["enum"]), F.lit(f"{key}: not allowed")))
            for bound, wrong in (("minimum", lambda v, b: v < b), ("maximum", lambda v, b: v > b)):
                if bound in rule:
                    checks.append(F.when(wrong(text.try_cast("double"), rule[bound]),
                                         F.lit(f"{key}: beyond {bound}")))
        found = F.array_compact(F.array(*checks, F.lit(None).cast("string")))
        if not schema.get("additional", False):
            other = F.array_sort(F.array_except(F.map_keys(fields), F.array(
                *[F.lit(k) for k in schema["properties"]], F.lit("").cast("string"))))
            found = F.concat(found, F.transform(other, lambda k: F.concat(k, F.lit(": unknown"))))
        known = F.when(name == tool, found).otherwise(known)
    return (F.when(fields.isNull(), F.array(F.lit("arguments: no object")))
            .when(known.isNull(), F.array(F.lit("tool: unknown"))).otherwise(known))


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv, call_id, level) of every call: the length of the longest chain of
    dependencies below it, null in or behind a cycle.  ``calls``: conv, call_id,
    issued; ``edges``: conv, before, after (distinct, both calls).

    Every call follows one dependency at first, the one issued last.  Pointer
    doubling gives the lengths of these chains in as many rounds as the longest
    has binary digits.  A call with a dependency that is higher than the one it
    follows then follows that one, and the doubling is repeated until there is
    none: the lengths are then the longest.  A chain that meets no end is in or
    behind a cycle, which counts as higher than any length.
    """
    largest = calls.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    issued = calls.select("conv", F.col("call_id").alias("before"), "issued")
    up = (edges.join(issued, ["conv", "before"]).groupBy("conv", F.col("after").alias("call_id"))
          .agg(F.max(F.struct("issued", "before"))["before"].alias("up")))
    while True:
        up = materialise(up, "chat-up")
        at = materialise(calls.select("conv", "call_id").join(up, ["conv", "call_id"], "left").select(
            "conv", "call_id", F.coalesce("up", "call_id").alias("end"),
            F.col("up").isNotNull().cast("int").alias("far"), F.col("up").isNull().alias("done")), "chat-chains")
        for _ in range(largest.bit_length() + 1):
            going = at.filter(~F.col("done"))
            if not going.limit(1).count():
                break
            step = at.select("conv", F.col("call_id").alias("end"), F.col("end").alias("next_end"),
                             F.col("far").alias("more"), F.col("done").alias("ended"))
            at = materialise(at.filter("done").unionByName(going.join(step, ["conv", "end"]).select(
                "conv", "call_id", F.col("next_end").alias("end"), (F.col("far") + F.col("more")).alias("far"),
                F.col("ended").alias("done"))), "chat-chains")
        high = at.select("conv", "call_id", F.when(F.col("done"), F.col("far")).otherwise(ENDLESS).alias("level"))
        over = high.select("conv", F.col("call_id").alias("before"), "level")
        best = materialise(
            edges.join(over, ["conv", "before"]).groupBy("conv", F.col("after").alias("call_id"))
            .agg(F.max(F.struct("level", "before")).alias("best")), "chat-best")
        better = materialise(
            best.join(high, ["conv", "call_id"])
            .filter(F.least(F.col("best.level") + 1, F.lit(ENDLESS)) > F.col("level"))
            .select("conv", "call_id", F.col("best.before").alias("up")), "chat-better")
        if not better.limit(1).count():
            return high.withColumn("level", F.when(F.col("level") < ENDLESS, F.col("level")))
        up = up.join(better.select("conv", "call_id"), ["conv", "call_id"], "left_anti").unionByName(better)


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """Calls (conv, call_id, issued, name, arguments, depends_on) with their
    results (conv, call_id, issued, content), one row per call and orphan id."""
    body = F.struct("issued", "name", "arguments", "depends_on")
    calls = materialise(
        calls.filter(F.col("call_id").isNotNull()).groupBy("conv", "call_id")
        .agg(F.min(body).alias("_c"), F.count(F.lit(1)).alias("n_calls"))
        .select("conv", "call_id", "_c.*", "n_calls"), "chat-calls")
    answers = (results.groupBy("conv", "call_id")
               .agg(F.min(F.struct("issued", "content")).alias("_r"), F.count(F.lit(1)).alias("n_results"))
               .select("conv", "call_id", F.col("_r.content").alias("content"), "n_results"))
    ids = calls.select("conv", "call_id", "issued")
    wanted = calls.select("conv", F.col("call_id").alias("after"),
                          F.explode(F.array_distinct("depends_on")).alias("before"))
    there = ids.select("conv", F.col("call_id").alias("before"), F.lit(True).alias("there"))
    wanted = materialise(wanted.join(there, ["conv", "before"], "left"), "chat-edges")
    edges = wanted.filter("there").drop("there")
    lost = (wanted.filter("there is null").groupBy("conv", F.col("after").alias("call_id"))
            .agg(F.count(F.lit(1)).alias("lost")))
    args = F.try_parse_json("arguments")
    linked = (calls.join(answers.hint("shuffle_hash"), ["conv", "call_id"], "left")
              .join(levels(ids, edges), ["conv", "call_id"], "left").join(lost, ["conv", "call_id"], "left")
              .withColumn("_args", F.when(F.schema_of_variant(args).startswith("OBJECT"), args))
              .withColumn("errors", F.concat(
                  argument_errors(F.col("_args"), F.col("name"), schemas),
                  F.when(F.col("lost") > 0, F.array(F.lit("depends_on: missing call")))
                  .otherwise(F.array().cast("array<string>"))))
              .select("conv", "call_id", "name", "issued", "level", "n_calls",
                      F.coalesce("n_results", F.lit(0)).alias("n_results"),
                      F.when(F.col("n_results").isNull(), "unanswered").otherwise("linked").alias("status"),
                      (F.size("errors") == 0).alias("valid"), "errors",
                      F.to_json(F.struct(
                          F.col("_args").alias("arguments"),
                          F.array_sort("depends_on").alias("depends_on"), F.col("call_id").alias("id"),
                          "name", F.col("content").alias("result")),
                          {"ignoreNullFields": "false"}).alias("canonical")))
    orphans = (answers.join(ids, ["conv", "call_id"], "left_anti")
               .select("conv", "call_id", F.lit(0).cast("bigint").alias("n_calls"), "n_results",
                       F.lit("orphan").alias("status"),
                       F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result")),
                                 {"ignoreNullFields": "false"}).alias("canonical")))
    return linked.unionByName(orphans, allowMissingColumns=True)


# The tools that the registered query derives calls of.
TOOLS = {
    "search": {"properties": {"exact": {"type": "boolean"},
                              "limit": {"type": "integer", "maximum": 50},
                              "query": {"type": "string"}}, "required": ["query"]},
    "summarise": {"properties": {"max_words": {"type": "integer", "minimum": 20},
                                 "text": {"type": "string"}}, "required": ["text"]},
    "translate": {"properties": {"target": {"type": "string", "enum": ["de", "en", "es", "fr"]},
                                 "text": {"type": "string"}}, "required": ["target", "text"]},
}


def derived_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that conversations stand for: a user turn calls a tool
    with its text, the assistant turn after it is the result, and a call needs
    those of the two user turns before it."""
    id_ = lambda back: F.concat(F.lit("call_"), F.col("conv_id"), F.lit("_"), F.col("turn") - back)
    n, kind = F.length("text"), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3))
    text = F.col("text")
    target = F.element_at(F.array(*[F.lit(x) for x in ("xx", "fr", "en", "es", "de")]),
                          (n % 5 + 1).cast("int"))
    arguments = (F.when(kind == 0, F.to_json(F.struct(
        text.alias("query"), (n % 60).alias("limit"), (F.col("turn") == 1).alias("exact"))))
        .when(kind == 1, F.to_json(F.struct(text.alias("text"), target.alias("target"))))
        .otherwise(F.to_json(F.struct(text.alias("text"), (n % 40).alias("max_words"),
                                      F.when(n % 7 == 0, "short").alias("style")))))
    calls = conversations.filter("role = 'user'").select(
        F.col("conv_id").alias("conv"), id_(0).alias("call_id"), F.col("turn").alias("issued"),
        F.when(kind == 0, "search").when(kind == 1, "translate").otherwise("summarise").alias("name"),
        arguments.alias("arguments"),
        F.array_compact(F.array(F.when(F.col("turn") >= 2, id_(2)),
                                F.when(F.col("turn") >= 4, id_(4)))).alias("depends_on"))
    results = conversations.filter("role = 'assistant'").select(
        F.col("conv_id").alias("conv"), id_(1).alias("call_id"), F.col("turn").alias("issued"),
        text.alias("content"))
    return calls, results


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = derived_calls(table(spark, sf_dir, "conversations"))
    return link_calls(calls, results, TOOLS).select(
        F.col("conv").alias("conv_id"), "call_id", "name", "issued", "level", "n_calls", "n_results",
        "status", "valid", F.array_join("errors", "; ").alias("errors"), "canonical")


SQL = r"""
WITH RECURSIVE c0 AS (
  SELECT conv_id, 'call_' || conv_id || '_' || turn AS call_id, turn AS issued, text, length(text) AS n,
         (conv_id + turn) % 3 AS kind
  FROM conversations WHERE role = 'user'),
c AS (SELECT conv_id, call_id, issued, min(text) AS text, min(n) AS n, any_value(kind) AS kind,
             count(*) AS n_calls FROM c0 GROUP BY ALL),
r0 AS (SELECT conv_id, 'call_' || conv_id || '_' || (turn - 1) AS call_id, text FROM conversations
       WHERE role = 'assistant'),
r AS (SELECT conv_id, call_id, min(text) AS content, count(*) AS n_results FROM r0 GROUP BY ALL),
e AS (SELECT a.conv_id, b.issued AS before, a.issued AS after FROM c a JOIN c b
      ON a.conv_id = b.conv_id AND (b.issued = a.issued - 2 OR b.issued = a.issued - 4)),
walk AS (SELECT conv_id, issued, 0 AS level FROM c
         UNION ALL SELECT e.conv_id, e.after, w.level + 1 FROM walk w JOIN e
         ON e.conv_id = w.conv_id AND e.before = w.issued),
lv AS (SELECT conv_id, issued, max(level) AS level FROM walk GROUP BY ALL),
lost AS (SELECT conv_id, issued,
         (issued >= 2 AND issued - 2 NOT IN (SELECT issued FROM c x WHERE x.conv_id = c.conv_id))
         OR (issued >= 4 AND issued - 4 NOT IN (SELECT issued FROM c x WHERE x.conv_id = c.conv_id)) AS gone
         FROM c),
d AS (
  SELECT c.*, lv.level, r.content, coalesce(r.n_results, 0) AS n_results, lost.gone,
    ['search', 'translate', 'summarise'][kind + 1] AS name,
    ['xx', 'fr', 'en', 'es', 'de'][n % 5 + 1] AS target,
    r.call_id IS NOT NULL AS answered
  FROM c JOIN lv USING (conv_id, issued) JOIN lost USING (conv_id, issued) LEFT JOIN r USING (conv_id, call_id)),
f AS (SELECT *, list_filter([
    CASE WHEN kind = 0 AND n % 60 > 50 THEN 'limit: beyond maximum' END,
    CASE WHEN kind = 0 AND text IS NULL THEN 'query: missing' END,
    CASE WHEN kind = 2 AND n % 40 < 20 THEN 'max_words: beyond minimum' END,
    CASE WHEN kind = 1 AND text IS NULL THEN 'target: missing' END,
    CASE WHEN kind = 1 AND target = 'xx' THEN 'target: not allowed' END,
    CASE WHEN kind <> 0 AND text IS NULL THEN 'text: missing' END,
    CASE WHEN kind = 2 AND n % 7 = 0 THEN 'style: unknown' END,
    CASE WHEN gone THEN 'depends_on: missing call' END], lambda x: x IS NOT NULL) AS errors
  FROM d)
SELECT conv_id, call_id, name, issued, level::INT AS level, n_calls, n_results,
  CASE WHEN answered THEN 'linked' ELSE 'unanswered' END AS status,
  len(errors) = 0 AS valid, array_to_string(errors, '; ') AS errors,
  '{"arguments":' || CASE kind
    WHEN 0 THEN '{"exact":' || (issued = 1)::VARCHAR || coalesce(',"limit":' || (n % 60), '')
      || coalesce(',"query":' || to_json(text)::VARCHAR, '') || '}'
    WHEN 1 THEN '{' || coalesce('"target":"' || target || '","text":' || to_json(text)::VARCHAR, '') || '}'
    ELSE '{' || coalesce('"max_words":' || (n % 40) || CASE WHEN n % 7 = 0 THEN ',"style":"short"' ELSE '' END
      || ',"text":' || to_json(text)::VARCHAR, '') || '}' END
  || ',"depends_on":[' || CASE WHEN issued >= 4 THEN '"call_' || conv_id || '_' || (issued - 4) || '","call_'
      || conv_id || '_' || (issued - 2) || '"' WHEN issued >= 2 THEN '"call_' || conv_id || '_' || (issued - 2) || '"'
      ELSE '' END
  || '],"id":"' || call_id || '","name":"' || name || '","result":' || coalesce(to_json(content)::VARCHAR, 'null')
  || '}' AS canonical
FROM f
UNION ALL
SELECT conv_id, call_id, NULL, NULL, NULL, 0, n_results, 'orphan', NULL, NULL,
  '{"id":"' || call_id || '","result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}'
FROM r WHERE call_id NOT IN (SELECT call_id FROM c)
"""
