"""Streaming stand-in queries.

``events`` become annotation form posts (see ``standins.submissions``) and
are appended as four JSON slices in ``event_id`` order — the arrival order.
Each query runs its stream to completion (``availableNow``) into tables
under the shared checkpoint folder and returns the final table, which the
oracle recomputes in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark import schemas
from evalspark.operators import assign, ordinals
from evalspark.plans import sqlfrag as S
from evalspark.plans import standins
from evalspark.plans.annotators import _reasons_sql
from evalspark.plans.providers import RuleProvider
from evalspark.plans.registry import register
from evalspark.session import scratch_path
from evalspark.streaming import annotations as sa
from evalspark.streaming import inference as si

N_SLICES = 4
ORDER = ("event_id",)
SUBMISSION_WITH_ID = T.StructType([T.StructField("event_id", T.LongType()), *schemas.SUBMISSION.fields])


def _feed(spark: SparkSession, sf: str) -> str:
    src = scratch_path(spark, "submissions_src")
    si.write_slices(standins.submissions(spark, sf), src, N_SLICES, ["event_id"])
    return src


def _ingested(spark: SparkSession, sf: str) -> str:
    src = _feed(spark, sf)
    out = scratch_path(spark, "annotations_out")
    sa.ingest_annotations(spark, src, out, scratch_path(spark, "annotations_ckpt"), SUBMISSION_WITH_ID,
                          max_files_per_trigger=si.FILES_PER_SLICE, order=ORDER)
    return out


def _valid_sql() -> str:
    return f"""
s AS ({standins.submissions_sql()}),
v AS (SELECT *, {_reasons_sql()} AS r FROM s),
ok AS (SELECT *, row_number() OVER (PARTITION BY {S.ustrip('"user"')}, {S.ustrip('question_ref')} ORDER BY event_id) AS rn
       FROM v WHERE len(r) = 0)"""


@register("ingest_annotations", "R1", lambda: f"""
WITH {_valid_sql()}
SELECT event_id, 'accepted' AS status, '' AS reasons FROM ok WHERE rn = 1
UNION ALL SELECT event_id, 'rejected', 'duplicate' FROM ok WHERE rn > 1
UNION ALL SELECT event_id, 'rejected', array_to_string(r, ',') FROM v WHERE len(r) > 0""")
def q_ingest_annotations(spark: SparkSession, sf: str) -> DataFrame:
    out = _ingested(spark, sf)
    acc = sa.read_accepted(spark, out).select(
        "event_id", F.lit("accepted").alias("status"), F.lit("").alias("reasons"))
    rej = sa.read_quarantine(spark, out).select(
        "event_id", F.lit("rejected").alias("status"), F.array_join("reasons", ",").alias("reasons"))
    return acc.unionByName(rej)


@register("first_write_wins", "R2", lambda: f"""
WITH {_valid_sql()}
SELECT event_id, {S.ustrip('"user"')} AS "user", {S.ustrip('question_ref')} AS question_ref FROM ok WHERE rn = 1""")
def q_first_write_wins(spark: SparkSession, sf: str) -> DataFrame:
    """The row that won each key, by arrival order."""
    return sa.read_accepted(spark, _ingested(spark, sf)).select("event_id", "user", "question_ref")


@register("first_write_wins_bounded", "R2", lambda: f"""
WITH {_valid_sql()}
SELECT DISTINCT trim("user") AS "user", question_ref FROM ok""")
def q_first_write_wins_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """Constant-state variant: watermark + dropDuplicatesWithinWatermark."""
    from evalspark.operators.annotations import validate_annotation
    src = _feed(spark, sf)
    out = scratch_path(spark, "fww_out")
    stream = spark.readStream.schema(SUBMISSION_WITH_ID).option("maxFilesPerTrigger", si.FILES_PER_SLICE).json(src)
    valid = validate_annotation(stream).filter(F.col("accepted")).drop("reasons", "accepted")
    dedup = sa.first_write_wins_bounded(valid, delay="3650 days")
    q = (dedup.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch_path(spark, "fww_ckpt")).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).select("user", "question_ref")


@register("upsert_users", "R3", lambda: f"""
WITH {_valid_sql()}
SELECT DISTINCT trim("user") AS user_id, trim("user") AS name FROM v WHERE len(r) = 0""")
def q_upsert_users(spark: SparkSession, sf: str) -> DataFrame:
    out = _ingested(spark, sf)
    return sa.read_users(spark, out)


def _progress_pages(spark: SparkSession, sf: str) -> DataFrame:
    sub = standins.submissions(spark, sf)
    questions = ordinals.number_questions(sub.select("question_ref").distinct()
                                          .withColumnRenamed("question_ref", "qref"), ["qref"])
    questions = questions.drop("question_ref").withColumnRenamed("qref", "question_ref")
    roster = sub.select(F.col("user").alias("user_id")).distinct()
    return assign.page_ordinals(assign.assign_round_robin(questions, roster, r=2))


@register("progress", "R4", lambda: f"""
WITH {_valid_sql()},
qs AS (SELECT question_ref, row_number() OVER (ORDER BY question_ref) AS ordinal
       FROM (SELECT DISTINCT question_ref FROM s)),
us AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS idx FROM (SELECT DISTINCT "user" AS user_id FROM s)),
n AS (SELECT count(*) AS n FROM us),
a AS (SELECT qs.question_ref, qs.ordinal, t.slot, us.user_id
      FROM qs, (VALUES (0), (1)) t(slot), n JOIN us ON us.idx = ((qs.ordinal - 1) * 2 + t.slot) % n.n),
p AS (SELECT user_id, question_ref, row_number() OVER (PARTITION BY user_id ORDER BY ordinal, slot) AS page_idx
      FROM a)
SELECT p.user_id, max(p.page_idx) AS last_idx
FROM (SELECT DISTINCT trim("user") AS user_id, question_ref FROM v WHERE len(r) = 0) x
JOIN p ON x.user_id = p.user_id AND x.question_ref = p.question_ref GROUP BY p.user_id""")
def q_progress(spark: SparkSession, sf: str) -> DataFrame:
    pages = _progress_pages(spark, sf)
    src = _feed(spark, sf)
    checkpoint = scratch_path(spark, "progress_ckpt")
    sa.run_progress(spark, src, pages, SUBMISSION_WITH_ID, checkpoint)
    return sa.read_progress(spark, checkpoint).select("user_id", "last_idx")


@register("resumable_inference", "R5", lambda: f"""
SELECT question_ref, CAST(length(question_text) % 50 AS VARCHAR) || ' miles' AS rule_response
FROM ({standins.bank_sql()})""")
def q_resumable_inference(spark: SparkSession, sf: str) -> DataFrame:
    """Stream the first half of the bank files, stop (a run ending half-way),
    append the rest, restart from the same checkpoint, then retry twice the rows
    whose model call failed; every question ends answered exactly once."""
    bank = standins.bank(spark, sf).drop("source", "lang", "doc_id")
    src = scratch_path(spark, "bank_stream_src")
    out = scratch_path(spark, "responses_out")
    ckpt = scratch_path(spark, "responses_ckpt")
    flaky = RuleProvider("rule", fail_every=97)
    half = N_SLICES // 2
    si.write_slices(bank, src, N_SLICES, ["question_ref"], which=range(0, half))
    si.resumable_inference(spark, src, out, ckpt, flaky, schemas.BANK, max_files_per_trigger=si.FILES_PER_SLICE)
    si.write_slices(bank, src, N_SLICES, ["question_ref"], which=range(half, N_SLICES))
    si.resumable_inference(spark, src, out, ckpt, flaky, schemas.BANK, max_files_per_trigger=si.FILES_PER_SLICE)
    files = spark.read.schema(schemas.BANK).json(src)
    si.retry_pending(files, RuleProvider("rule", fail_every=194), out)  # some calls fail again
    si.retry_pending(files, RuleProvider("rule"), out)
    return si.responses_table(spark, out).select("question_ref", "rule_response")
