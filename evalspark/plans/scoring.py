"""Scoring stand-in queries: E1–E5 and the accuracy report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.ring import accepted_directions
from evalspark.functions.text import all_numbers, first_number, is_numeric_list, normalise_list, split_answers
from evalspark.operators import report, scoring
from evalspark.plans import sqlfrag as S
from evalspark.plans import standins
from evalspark.plans.registry import register

KEYS = ["question_ref", "model", "setting"]


def _typed(spark: SparkSession, sf: str, t: str) -> DataFrame:
    a = standins.answers(spark, sf).filter(F.col("answer_type") == t).drop("answer_type")
    return standins.responses(spark, sf).join(a, "question_ref", "inner")


def _typed_sql(t: str, expr: str) -> str:
    return f"""
WITH a AS ({standins.answers_sql()}), r AS ({standins.responses_sql()})
SELECT r.question_ref, r.model, r.setting, {expr} AS correct
FROM r JOIN a ON r.question_ref = a.question_ref WHERE a.answer_type = '{t}'"""


@register("score_distance", "E1", lambda: _typed_sql(
    "distance", S.distance_correct(S.split_answers("r.response"), S.split_answers("a.expected_answer"))))
def q_score_distance(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_distance(_typed(spark, sf, "distance")).select(*KEYS, "correct")


@register("score_cardinal", "E2", lambda: _typed_sql(
    "cardinal", S.cardinal_correct(S.split_answers("r.response"), S.split_answers("a.expected_answer"))))
def q_score_cardinal(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_cardinal(_typed(spark, sf, "cardinal")).select(*KEYS, "correct")


@register("score_text", "E3", lambda: _typed_sql(
    "textual", S.text_correct(S.split_answers("r.response"), S.split_answers("a.expected_answer"),
                              "r.response", "a.expected_answer")))
def q_score_text(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_text(_typed(spark, sf, "textual")).select(*KEYS, "correct")


def _scored_sql() -> str:
    r_list, e_list = S.split_answers("r.response"), S.split_answers("a.expected_answer")
    return f"""
a AS ({standins.answers_sql()}), r AS ({standins.responses_sql()}),
runs AS (SELECT DISTINCT model, setting FROM r),
j AS (
  SELECT a.question_ref, runs.model, runs.setting, a.answer_type, a.expected_answer, r.response
  FROM a CROSS JOIN runs
  LEFT JOIN r ON r.question_ref = a.question_ref AND r.model = runs.model AND r.setting = runs.setting
  UNION ALL
  SELECT r.question_ref, r.model, r.setting, NULL, NULL, r.response
  FROM r WHERE r.question_ref NOT IN (SELECT question_ref FROM a)),
s AS (
  SELECT question_ref, model, setting, answer_type, expected_answer, response,
         {S.score('answer_type', S.split_answers('response'), S.split_answers('expected_answer'),
                  'response', 'expected_answer')} AS correct
  FROM j WHERE question_ref IS NOT NULL)"""


def _repr_sql(x: str) -> str:
    return f"('[' || array_to_string(list_transform({x}, lambda t_: chr(39) || t_ || chr(39)), ', ') || ']')"


@register("judge_queue", "E4", lambda: f"""
WITH {_scored_sql()}
SELECT question_ref, model, setting,
       {_repr_sql(S.normalise_list(S.split_answers('expected_answer')))} AS expected,
       {_repr_sql(S.normalise_list(S.split_answers('response')))} AS response,
       md5('Question reference: ' || question_ref || chr(10) || 'Expected answer: ' ||
           {_repr_sql(S.normalise_list(S.split_answers('expected_answer')))} || chr(10) ||
           'Given response: ' ||
           {_repr_sql(S.normalise_list(S.split_answers('response')))} || chr(10) || chr(10) ||
           'Does the response correctly answer the question based on expected answer? ' ||
           'Answer strictly ''yes'' or ''no''.') AS prompt_md5
FROM s WHERE correct IS NULL""")
def q_judge_queue(spark: SparkSession, sf: str) -> DataFrame:
    jq = scoring.queue_responses(standins.responses(spark, sf), standins.answers(spark, sf), skipped=True)
    return jq.withColumn("prompt_md5", F.md5("prompt")).drop("prompt")


def _evaluated(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.evaluate(standins.responses(spark, sf), standins.answers(spark, sf),
                            verdicts=standins.verdicts(spark, sf))


def _evaluated_sql() -> str:
    return f"""
{_scored_sql()},
v AS ({standins.verdicts_sql()}),
e AS (
  SELECT s.question_ref, s.model, s.setting, s.answer_type,
         coalesce(s.correct, CASE WHEN v.verdict IS NOT NULL THEN {S.yes_verdict('v.verdict')} END) AS correct
  FROM s LEFT JOIN v ON s.question_ref = v.question_ref AND s.model = v.model
                    AND s.setting = v.setting)"""


@register("evaluate", "E5", lambda: f"WITH {_evaluated_sql()} SELECT * FROM e")
def q_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluated(spark, sf).select("question_ref", "model", "setting", "answer_type", "correct")


ACCURACY_SQL_COLS = """count(*) AS n,
       CAST(sum(coalesce(correct, 0)) AS BIGINT) AS n_correct,
       CAST(count(*) - count(correct) AS BIGINT) AS n_pending,
       round(100.0 * sum(coalesce(correct, 0)) / count(*), 6) AS accuracy"""


@register("accuracy", "G7", lambda: f"""
WITH {_evaluated_sql()}
SELECT model, setting, answer_type, {ACCURACY_SQL_COLS}
FROM e GROUP BY model, setting, answer_type""")
def q_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return report.accuracy(_evaluated(spark, sf), by=["model", "setting", "answer_type"])


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluate every response and report accuracy by model/setting/type."""
    return q_accuracy(spark, sf)


@register("accepted_directions", "J9", lambda: f"""
SELECT l_orderkey, l_linenumber, array_to_string({S.accepted_directions(
    f"CASE WHEN l_partkey % 9 = 0 THEN 'Up' ELSE {S.ring_list()}[CAST(l_partkey % 8 AS INTEGER) + 1] END")}, '|')
    AS accepted
FROM lineitem""")
def q_accepted_directions(spark: SparkSession, sf: str) -> DataFrame:
    li = spark.read.parquet(f"{sf.rstrip('/')}/lineitem.parquet")
    exp = F.when(F.col("l_partkey") % 9 == 0, F.lit("Up")).otherwise(standins._ring_at(F.col("l_partkey")))
    return li.select("l_orderkey", "l_linenumber",
                     F.array_join(accepted_directions(exp), "|").alias("accepted"))


@register("answer_text_functions", "X1-X7", lambda: f"""
SELECT doc_id,
       CAST(len({S.split_answers('text')}) AS INTEGER) AS n_parts,
       {S.first_number('text')} AS first_number,
       CAST(len({S.all_numbers('text')}) AS INTEGER) AS n_numbers,
       CAST(len({S.normalise_list(S.split_answers('text'))}) AS INTEGER) AS n_tokens,
       CAST({S.is_numeric_list(S.normalise_list(S.split_answers('text')))} AS INTEGER) AS all_numeric,
       coalesce(({S.normalise_list(S.split_answers('text'))})[1], '') AS first_token
FROM documents""")
def q_answer_text_functions(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf.rstrip('/')}/documents.parquet")
    parts = split_answers("text")
    toks = normalise_list(parts)
    return d.select("doc_id", F.size(parts).alias("n_parts"), first_number("text").alias("first_number"),
                    F.size(all_numbers("text")).alias("n_numbers"), F.size(toks).alias("n_tokens"),
                    is_numeric_list(toks).cast("int").alias("all_numeric"),
                    F.coalesce(F.try_element_at(toks, F.lit(1)), F.lit("")).alias("first_token"))


@register("score_cardinal_exact", "E2/D25", lambda: _typed_sql(
    "cardinal", "(CASE WHEN coalesce(" + S.ustrip("string_split(r.response, ';')[1]") + " = "
    + S.ustrip("string_split(a.expected_answer, ';')[1]") + ", false) THEN 1 ELSE 0 END)"))
def q_score_cardinal_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The exact-only variant of the direction scorer (no ring neighbours)."""
    return scoring.score_cardinal(_typed(spark, sf, "cardinal"), exact_only=True).select(*KEYS, "correct")


@register("filter_answer_type", "P7", lambda: f"""
SELECT question_ref, expected_answer FROM ({standins.answers_sql()}) WHERE answer_type = 'textual'""")
def q_filter_answer_type(spark: SparkSession, sf: str) -> DataFrame:
    from evalspark.operators import basic
    return basic.filter_answer_type(standins.answers(spark, sf), "textual").select("question_ref", "expected_answer")
