"""Annotation collection as Structured Streaming jobs.

Form posts land as JSON files; a file-source stream validates every
micro-batch (P10), keeps the *first* valid write per ``(user, question_ref)``
forever (the store's unique constraint, D19), quarantines everything else
with a reason, and creates users on first sight (R3).  Three streams follow
each other, each with its own checkpoint:

1. posts -> ``staged``: validated posts, numbered within their micro-batch;
2. ``staged`` -> ``posts``: keyed streaming state (RocksDB, no expiry) holds the
   winner of every key as ``min(struct(batch, order, content, number))``.  The
   least struct is found before the shuffle too, so a key flooded with posts is
   one row per task.  A post is accepted if it is its key's winner;
3. ``seen_users`` -> ``users``: users of the accepted posts, told apart by the
   same kind of state.

A run reads its own files and the state of its own keys, and none of the
tables written before.  A replayed micro-batch writes the same folders again
(dynamic partition overwrite), so nothing is stored twice.
:func:`first_write_wins_bounded` is the alternative whose state is bounded
(watermark + ``dropDuplicatesWithinWatermark``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.operators.annotations import validate_annotation
from evalspark.session import read_if_exists, rocksdb_state

KEY = ["user", "question_ref"]
ACCEPTED, REJECTED = "accepted", "rejected"
NUMBER, CONTENT, MARK = "_number", "_content", "_mark"


def _write_batch(df: DataFrame, path: str, batch_id: int | None = None, by: tuple[str, ...] = ()) -> None:
    if batch_id is not None:
        df = df.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by, "batch_id").parquet(path))


def stage_batch(posts: DataFrame, batch_id: int, out_dir: str) -> None:
    """Validate one micro-batch of posts, number them and write them down.

    One more row says that the batch is there, so that the next stream knows
    which batches it was given even if no post of a batch is valid.
    """
    v = (validate_annotation(posts).withColumn(CONTENT, F.xxhash64(*posts.columns))
         .withColumn(NUMBER, F.monotonically_increasing_id()).withColumn(MARK, F.lit(None).cast("bigint")))
    mark = v.sparkSession.range(1).select(F.lit(batch_id).cast("bigint").alias(MARK))
    _write_batch(v.unionByName(mark, allowMissingColumns=True), os.path.join(out_dir, "staged"), batch_id)


def winners(staged: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """R2: the first valid post of every key: by batch, then ``order`` (nulls
    first), then content; on a stream, of all batches so far."""
    valid = staged.filter(F.col("accepted") | F.col(MARK).isNotNull())
    return valid.groupBy(*KEY, MARK).agg(F.min(F.struct("batch_id", *order, CONTENT, NUMBER)).alias("first"))


def classify_batches(found: DataFrame, run: int, out_dir: str) -> None:
    """Write the posts of the batches that ``found`` marks, by their status.

    ``found``: winners of the keys in these batches, whenever they won.
    """
    spark = found.sparkSession
    path = os.path.join(out_dir, "winners", f"run={run}")
    found.select(*KEY, MARK, F.col("first.batch_id").alias("batch_id"), F.col(f"first.{NUMBER}").alias(NUMBER)) \
        .write.mode("overwrite").parquet(path)
    won = spark.read.parquet(path)
    batches = [r[0] for r in won.filter(F.col(MARK).isNotNull()).select(MARK).collect()]
    won = won.filter(F.col(MARK).isNull() & F.col("batch_id").isin(batches))
    here = spark.read.parquet(os.path.join(out_dir, "staged")).filter(F.col("batch_id").isin(batches))
    first = won.select("batch_id", NUMBER, F.lit(True).alias("_first"))
    posts = (here.filter(F.col(MARK).isNull()).join(first, ["batch_id", NUMBER], "left")
             .withColumn("status", F.when(F.col("_first"), ACCEPTED).otherwise(REJECTED))
             .withColumn("reasons", F.when(F.col("accepted") & F.col("_first").isNull(), F.array(F.lit("duplicate")))
                         .otherwise(F.col("reasons")))
             .drop("_first", "accepted", CONTENT, NUMBER, MARK))
    _write_batch(posts, os.path.join(out_dir, "posts"), by=("status",))
    _write_batch(won.select(F.col("user").alias("user_id"), "batch_id").distinct(), os.path.join(out_dir, "seen_users"))


def process_batch(batch: DataFrame, batch_id: int, out_dir: str,
                  order: tuple[str, ...] = ("timestamp",)) -> None:
    """R1–R3 for posts that are all there: one static batch without earlier posts."""
    stage_batch(batch, batch_id, out_dir)
    staged = batch.sparkSession.read.parquet(os.path.join(out_dir, "staged")).filter(F.col("batch_id") == batch_id)
    classify_batches(winners(staged, order), batch_id, out_dir)
    upsert_users(batch.sparkSession, out_dir, os.path.join(out_dir, f"users_checkpoint_{batch_id}"))


def _run(stream: DataFrame, sink, checkpoint: str, mode: str = "append"):
    q = (stream.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def upsert_users(spark: SparkSession, out_dir: str, checkpoint: str) -> None:
    """Users on first sight, named by their id; the state holds every user once."""
    path = os.path.join(out_dir, "seen_users")
    seen = read_if_exists(spark, path)
    if seen is None:
        return
    with rocksdb_state(spark):
        users = (spark.readStream.schema(seen.schema).parquet(path).select("user_id")
                 .dropDuplicates(["user_id"]).withColumn("name", F.col("user_id")))
        _run(users, lambda df, run: _write_batch(df, os.path.join(out_dir, "users"), run), checkpoint)


def ingest_annotations(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str,
                       schema: T.StructType, max_files_per_trigger: int | None = None,
                       order: tuple[str, ...] = ("timestamp",)):
    """File-source stream -> validated, de-duplicated tables; ``availableNow``.

    ``checkpoint`` holds the state, so it belongs to ``out_dir`` for good.
    Returns the (finished) query that decides about the posts.
    """
    reader = spark.readStream.schema(schema).option("multiLine", False)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    _run(reader.json(source_dir), lambda df, bid: stage_batch(df, bid, out_dir), os.path.join(checkpoint, "staged"))
    path = os.path.join(out_dir, "staged")
    staged = read_if_exists(spark, path)
    if staged is None:
        return None
    with rocksdb_state(spark):
        # Without a limit on files a run takes whole batches.
        q = _run(winners(spark.readStream.schema(staged.schema).parquet(path), order),
                 lambda df, run: classify_batches(df, run, out_dir), os.path.join(checkpoint, "posts"), "update")
    upsert_users(spark, out_dir, os.path.join(checkpoint, "users"))
    return q


def read_accepted(spark: SparkSession, out_dir: str) -> DataFrame:
    """The winning post of every key."""
    return (spark.read.parquet(os.path.join(out_dir, "posts")).filter(F.col("status") == ACCEPTED)
            .drop("status", "reasons"))


def read_quarantine(spark: SparkSession, out_dir: str) -> DataFrame:
    """All other posts, with their reasons."""
    return spark.read.parquet(os.path.join(out_dir, "posts")).filter(F.col("status") == REJECTED).drop("status")


def read_users(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(out_dir, "users")).select("user_id", "name")


def first_write_wins_bounded(stream: DataFrame, delay: str = "30 days",
                             event_time: str = "timestamp") -> DataFrame:
    """R2, constant-state variant: duplicates within ``delay`` of the first
    write are dropped; state expires behind the watermark.  ``event_time``
    must be a ``TIMESTAMP`` (not ``TIMESTAMP_NTZ``)."""
    return (stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
            .withWatermark(event_time, delay)
            .dropDuplicatesWithinWatermark(KEY))


def progress(answered: DataFrame, pages: DataFrame) -> DataFrame:
    """Per-user last answered page index (stream-static join + max).

    Run in ``complete``/``update`` mode; the result feeds :func:`resume_pointer`.
    """
    return (answered.select(F.col("user").alias("user_id"), "question_ref")
            .join(pages.select("user_id", "question_ref", "page_idx"), ["user_id", "question_ref"], "inner")
            .groupBy("user_id").agg(F.max("page_idx").alias("last_idx")))


def run_progress(spark: SparkSession, source_dir: str, pages: DataFrame, schema: T.StructType, checkpoint: str):
    """R4 as a stream: accepted-answer files -> each user's last answered page.

    The table is the query's own state, one row per user, which
    :func:`read_progress` reads; no trigger writes any output.
    """
    answered = spark.readStream.schema(schema).json(source_dir)
    agg = progress(validate_annotation(answered).filter(F.col("accepted")), pages)
    with rocksdb_state(spark):
        q = (agg.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return q


def read_progress(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Current progress (``user_id``, ``last_idx``) as of the last committed
    batch, from the state of :func:`run_progress`; no batch yet: no rows."""
    try:
        state = spark.read.format("statestore").load(checkpoint)
    except Exception as e:  # noqa: BLE001 - looked at below
        if "STDS_" not in str(e) or "BATCH" not in str(e):
            raise
        return spark.createDataFrame([], "user_id string, last_idx bigint")
    return state.select("key.user_id", F.col("value.max").cast("bigint").alias("last_idx"))
