"""Benchmark-shaped inputs derived from the driver tables.

The driver ships TPC-H-like tables, not question banks.  These builders map
them onto the benchmark's data model (SURVEY §2 stand-in roles) so every
registered query reads the given tables and grows with them:

* distance questions: one per order; expected ``<k> ± <t> MILES``;
  every line item is one model's response ``about <qty> miles``.
* cardinal questions: one per order; expected a ring direction (every 11th
  order an unknown one); line items answer a direction, some lower-cased.
* textual questions: one per document; the response is derived from the
  document and a benchmark passage (whole texts, never prefixes).

Each builder has a DuckDB twin (``*_sql``) returning a CTE body.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.ring import DIRECTIONS
from evalspark.operators.annotations import NOINFO
from evalspark.operators.report import RELATIONSHIPS
from evalspark.plans.sqlfrag import q, ring_list
from evalspark.session import read_table

UNKNOWN_DIRECTION = "Up"


def _ring_at(idx_col):
    return F.element_at(F.array(*[F.lit(d) for d in DIRECTIONS]), (idx_col % 8 + 1).cast("int"))


def _numbered(prefix: str, k):
    """``printf('<prefix>%07d', k)``; plain padding, several times as fast, where seven digits do."""
    return (F.when(k.between(0, 9_999_999), F.concat(F.lit(prefix), F.lpad(k.cast("string"), 7, "0")))
            .otherwise(F.format_string(f"{prefix}%07d", k)))


def row_count(df: DataFrame):
    """The number of rows as a scalar subquery (one aggregate, no join)."""
    return df.agg(F.count(F.lit(1))).scalar()


# ----------------------------------------------------------------- answers
def answers(spark: SparkSession, sf: str) -> DataFrame:
    """``question_ref, answer_type, expected_answer`` (string)."""
    o = read_table(spark, sf, "orders").select("o_orderkey")
    d = read_table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    k = F.col("o_orderkey")
    dist = o.select(
        _numbered("d", k).alias("question_ref"),
        F.lit("distance").alias("answer_type"),
        F.concat((k % 50).cast("string"),
                 F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(" ± "), (k % 4).cast("string"))),
                 F.lit(" MILES")).alias("expected_answer"))
    card = o.select(
        _numbered("c", k).alias("question_ref"),
        F.lit("cardinal").alias("answer_type"),
        F.when(k % 11 == 0, F.lit(UNKNOWN_DIRECTION)).otherwise(_ring_at(k)).alias("expected_answer"))
    text = d.select(
        _numbered("t", F.col("doc_id")).alias("question_ref"),
        F.lit("textual").alias("answer_type"),
        F.when(F.col("lang") == "de", F.col("n_chars").cast("string"))
        .otherwise(F.col("text")).alias("expected_answer"))
    return dist.unionByName(card).unionByName(text)


def answers_sql() -> str:
    return f"""
SELECT printf('d%07d', o_orderkey) AS question_ref, 'distance' AS answer_type,
       CAST(o_orderkey % 50 AS VARCHAR) ||
       CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' ± ' || CAST(o_orderkey % 4 AS VARCHAR) END
       || ' MILES' AS expected_answer
FROM orders
UNION ALL
SELECT printf('c%07d', o_orderkey), 'cardinal',
       CASE WHEN o_orderkey % 11 = 0 THEN {q(UNKNOWN_DIRECTION)}
            ELSE {ring_list()}[CAST(o_orderkey % 8 AS INTEGER) + 1] END
FROM orders
UNION ALL
SELECT printf('t%07d', doc_id), 'textual',
       CASE WHEN lang = 'de' THEN CAST(n_chars AS VARCHAR) ELSE text END
FROM documents"""


# --------------------------------------------------------------- responses
def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Long form ``question_ref, model, setting, response``."""
    li = read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    d = read_table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    b = read_table(spark, sf, "benchmark").select(F.col("item_id"), F.col("text").alias("b_text"))
    model = F.concat(F.lit("m"), F.col("l_linenumber").cast("string"))
    setting = F.when(F.col("l_partkey") % 2 == 0, F.lit("direct")).otherwise(F.lit("contextual"))
    dist = li.select(
        _numbered("d", F.col("l_orderkey")).alias("question_ref"),
        model.alias("model"), setting.alias("setting"),
        F.concat(F.lit("about "), F.col("l_quantity").cast("string"), F.lit(" miles")).alias("response"))
    direction = _ring_at(F.col("l_partkey") + F.col("l_linenumber"))
    card = li.select(
        _numbered("c", F.col("l_orderkey")).alias("question_ref"),
        model.alias("model"), setting.alias("setting"),
        F.when(F.col("l_suppkey") % 13 == 0, F.lower(direction)).otherwise(direction).alias("response"))
    i = F.col("doc_id") % 4
    text_resp = (
        F.when(F.col("lang") == "de", (F.col("n_chars") + F.col("doc_id") % 2).cast("string"))
        .when(i == 0, F.regexp_replace(F.replace(F.col("text"), F.lit(","), F.lit(" ,")), "the", "THE"))
        .when(i == 1, F.coalesce(F.col("b_text"), F.lit("")))
        .when(i == 2, F.array_join(F.reverse(F.split(F.col("text"), ";")), ";"))
        .otherwise(F.concat(F.col("text"), F.lit(" (see map)"))))
    text = (d.withColumn("_item", F.col("doc_id") % row_count(b)).join(b, F.col("_item") == b.item_id, "left")
            .select(_numbered("t", F.col("doc_id")).alias("question_ref"),
                    F.lit("m1").alias("model"), F.lit("direct").alias("setting"),
                    text_resp.alias("response")))
    return dist.unionByName(card).unionByName(text)


def responses_sql() -> str:
    direction = f"{ring_list()}[CAST((l_partkey + l_linenumber) % 8 AS INTEGER) + 1]"
    return f"""
SELECT printf('d%07d', l_orderkey) AS question_ref, 'm' || CAST(l_linenumber AS VARCHAR) AS model,
       CASE WHEN l_partkey % 2 = 0 THEN 'direct' ELSE 'contextual' END AS setting,
       'about ' || CAST(l_quantity AS VARCHAR) || ' miles' AS response
FROM lineitem
UNION ALL
SELECT printf('c%07d', l_orderkey), 'm' || CAST(l_linenumber AS VARCHAR),
       CASE WHEN l_partkey % 2 = 0 THEN 'direct' ELSE 'contextual' END,
       CASE WHEN l_suppkey % 13 = 0 THEN lower({direction}) ELSE {direction} END
FROM lineitem
UNION ALL
SELECT printf('t%07d', d.doc_id), 'm1', 'direct',
       CASE WHEN d.lang = 'de' THEN CAST(d.n_chars + d.doc_id % 2 AS VARCHAR)
            WHEN d.doc_id % 4 = 0 THEN regexp_replace(replace(d.text, ',', ' ,'), 'the', 'THE', 'g')
            WHEN d.doc_id % 4 = 1 THEN coalesce(b.text, '')
            WHEN d.doc_id % 4 = 2 THEN array_to_string(list_reverse(string_split(d.text, ';')), ';')
            ELSE d.text || ' (see map)' END
FROM documents d LEFT JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id"""


# ---------------------------------------------------------------- verdicts
def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Judge verdict text per textual response, from ``labels.quality``."""
    lab = read_table(spark, sf, "labels").select("doc_id", "quality")
    return lab.select(
        _numbered("t", F.col("doc_id")).alias("question_ref"),
        F.lit("m1").alias("model"), F.lit("direct").alias("setting"),
        F.when(F.col("quality") == 1, F.lit(" Yes, it matches.")).otherwise(F.lit("No.")).alias("verdict"))


def verdicts_sql() -> str:
    return """
SELECT printf('t%07d', doc_id) AS question_ref, 'm1' AS model, 'direct' AS setting,
       CASE WHEN quality = 1 THEN ' Yes, it matches.' ELSE 'No.' END AS verdict
FROM labels"""


# -------------------------------------------------------------------- bank
def _rel_at(idx_col):
    return F.element_at(F.array(*[F.lit(r) for r in RELATIONSHIPS]), (idx_col % 6 + 1).cast("int"))


def bank(spark: SparkSession, sf: str) -> DataFrame:
    """Question bank, one question per document (images named from its id)."""
    d = read_table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    k = F.col("doc_id")
    img = lambda n, suffix: F.concat(F.col("lang"), F.lit("/image"), n.cast("string"), suffix, F.lit(".png"))
    targets = F.when(k % 3 == 0, F.array(img(k, F.lit("")),
                                         img(k, F.concat(F.lit("_m"), (k % 5).cast("string")))))\
        .otherwise(F.array(img(k, F.lit(""))))
    ctx = F.array(img(k + 1, F.lit("")), img(k + 2, F.lit("")),
                  img(k + 3, F.concat(F.lit("_"), (k % 4).cast("string"))))
    return d.select(
        F.format_string("q_%04d", k).alias("question_ref"),
        F.col("text").alias("question_text"),
        F.col("n_chars").cast("string").alias("expected_answer"),
        targets.alias("image_urls"),
        F.when(k % 3 == 0, F.lit("Multi")).otherwise(F.lit("Single")).alias("map_count"),
        _rel_at(k).alias("spatial_relationship"),
        F.element_at(F.array(F.lit("distance"), F.lit("textual"), F.lit("cardinal")),
                     (k % 3 + 1).cast("int")).alias("answer_type"),
        ctx.alias("contextual_urls"),
        F.col("source"), F.col("lang"), k.alias("doc_id"))


def rel_list() -> str:
    return "[" + ", ".join(q(r) for r in RELATIONSHIPS) + "]"


def bank_sql() -> str:
    img = lambda n, suffix: f"(lang || '/image' || CAST({n} AS VARCHAR) || {suffix} || '.png')"
    return f"""
SELECT printf('q_%04d', doc_id) AS question_ref, text AS question_text,
       CAST(n_chars AS VARCHAR) AS expected_answer,
       CASE WHEN doc_id % 3 = 0 THEN [{img('doc_id', "''")}, {img('doc_id', "'_m' || CAST(doc_id % 5 AS VARCHAR)")}]
            ELSE [{img('doc_id', "''")}] END AS image_urls,
       CASE WHEN doc_id % 3 = 0 THEN 'Multi' ELSE 'Single' END AS map_count,
       {rel_list()}[CAST(doc_id % 6 AS INTEGER) + 1] AS spatial_relationship,
       ['distance', 'textual', 'cardinal'][CAST(doc_id % 3 AS INTEGER) + 1] AS answer_type,
       [{img('doc_id + 1', "''")}, {img('doc_id + 2', "''")},
        {img('doc_id + 3', "'_' || CAST(doc_id % 4 AS VARCHAR)")}] AS contextual_urls,
       source, lang, doc_id
FROM documents"""


# ------------------------------------------------------------- annotations
def submissions(spark: SparkSession, sf: str) -> DataFrame:
    """Annotation form posts, one per event (validity/necessary variants)."""
    e = read_table(spark, sf, "events")
    et = F.col("event_type")
    kq = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id"),
        F.format_string("%03d", F.col("user_id")).alias("user"),
        F.format_string("q_%04d", kq).alias("question_ref"),
        F.concat(F.lit('Is "'), et, F.lit('", near\n'), F.col("props")).alias("question_text"),
        F.when(F.col("value") > 250, F.lit("Multi")).otherwise(F.lit("Single")).alias("map_count"),
        F.when(F.col("event_id") % 17 == 0, F.lit("Nearby")).otherwise(_rel_at(F.col("event_id")))
        .alias("spatial_relationship"),
        F.when(F.col("event_id") % 23 == 0, F.lit("None"))
        .otherwise(F.concat(F.col("value").cast("string"), F.lit(" km"))).alias("answer"),
        F.when(et == "view", F.lit(NOINFO)).when(et == "error", F.lit("Unsure"))
        .otherwise(F.lit("Can be answered")).alias("validity"),
        F.when(et == "click", F.lit("Yes")).when(et == "purchase", F.lit("no"))
        .when(et == "signup", F.lit("")).alias("necessary"),
        F.when(F.col("event_id") % 2 == 0, F.lit("legend missing")).alias("noinfo_reason"),
        F.col("ts").cast("timestamp").alias("timestamp"))


def submissions_sql() -> str:
    return f"""
SELECT event_id, printf('%03d', user_id) AS "user",
       printf('q_%04d', CAST(json_extract_string(props, '$.k') AS INTEGER)) AS question_ref,
       'Is "' || event_type || '", near' || chr(10) || props AS question_text,
       CASE WHEN value > 250 THEN 'Multi' ELSE 'Single' END AS map_count,
       CASE WHEN event_id % 17 = 0 THEN 'Nearby' ELSE {rel_list()}[CAST(event_id % 6 AS INTEGER) + 1] END
         AS spatial_relationship,
       CASE WHEN event_id % 23 = 0 THEN 'None' ELSE CAST(value AS VARCHAR) || ' km' END AS answer,
       CASE WHEN event_type = 'view' THEN {q(NOINFO)} WHEN event_type = 'error' THEN 'Unsure'
            ELSE 'Can be answered' END AS validity,
       CASE WHEN event_type = 'click' THEN 'Yes' WHEN event_type = 'purchase' THEN 'no'
            WHEN event_type = 'signup' THEN '' END AS necessary,
       CASE WHEN event_id % 2 = 0 THEN 'legend missing' END AS noinfo_reason,
       ts AS "timestamp"
FROM events"""
