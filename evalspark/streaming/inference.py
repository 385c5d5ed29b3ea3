"""Resumable inference as a file stream.

The bank arrives as files; every micro-batch keeps only questions without a
usable answer yet (J5 against the bucketed keys of all stored responses),
runs the provider (I1) and appends successes under its ``batch_id``.  No
trigger reads stored answers, but its own of a try before.  The table is append-only: a
replayed batch finds what it stored before and asks only for the rest, and
nothing that was answered is ever replaced.  Failed rows (null responses) are
not written, so a later :func:`retry_pending` pass — a plain batch job over
the same bank — answers them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.operators.infer import Provider, build_image_list, infer
from evalspark.session import read_if_exists, scratch_path
from evalspark.sources.answered import AnsweredKeys

FILES_PER_SLICE = 4
FIRST_RETRY = 1_000_000  # batch ids of retries start here, above any stream batch


def answered_keys(spark: SparkSession, out_dir: str) -> AnsweredKeys:
    """Keys of the answers stored in ``out_dir``, beside it."""
    return AnsweredKeys(spark, out_dir.rstrip("/") + ".keys")


def _missing(spark: SparkSession, bank: DataFrame, keys: AnsweredKeys, out_dir: str, batch_id: int) -> DataFrame:
    """Rows of ``bank`` without a stored answer.  An earlier try of this batch may
    have stored answers and died before it noted their keys; only its own folder
    is read for that."""
    mine = read_if_exists(spark, f"{out_dir}/batch_id={batch_id}")
    if mine is not None:
        keys.add(mine.join(keys.stored(mine), "question_ref", "left_anti"))
    return keys.pending(bank)


def answer_batch(bank: DataFrame, provider: Provider, out_dir: str, batch_id: int,
                 distractor: bool = False, batch_size: int = 1) -> None:
    spark = bank.sparkSession
    keys = answered_keys(spark, out_dir)
    todo = _missing(spark, bank, keys, out_dir, batch_id)
    lists = build_image_list(todo, distractor)
    res = infer(lists, provider, batch_size=batch_size)
    ok = res.filter(F.col("q_answered")).drop("raw_response", "error")
    (ok.withColumn("batch_id", F.lit(batch_id)).write.mode("append")
     .partitionBy("batch_id").parquet(out_dir))
    done = read_if_exists(spark, f"{out_dir}/batch_id={batch_id}")
    if done is not None:
        keys.add(done)


def resumable_inference(spark: SparkSession, bank_dir: str, out_dir: str, checkpoint: str,
                        provider: Provider, schema: T.StructType, distractor: bool = False,
                        batch_size: int = 1, max_files_per_trigger: int | None = None):
    """Stream the bank through the provider (``availableNow``).

    A second call with the same checkpoint resumes: only files that arrived
    since are read, and only questions still pending are sent.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.json(bank_dir)
    q = (stream.writeStream
         .foreachBatch(lambda df, bid: answer_batch(df, provider, out_dir, bid, distractor, batch_size))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def retry_pending(bank: DataFrame, provider: Provider, out_dir: str, distractor: bool = False,
                  batch_size: int = 1) -> None:
    """Answer what the stream could not (failed rows re-enter through J5), under
    a fresh batch id."""
    done = read_if_exists(bank.sparkSession, out_dir)
    last = done.agg(F.max("batch_id")).first()[0] if done is not None else None
    batch_id = max(FIRST_RETRY, (last or 0) + 1)
    answer_batch(bank, provider, out_dir, batch_id, distractor, batch_size)


def responses_table(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(out_dir)


def write_slices(df: DataFrame, path: str, n_files: int, order: list,
                 which: range | None = None, files: int = FILES_PER_SLICE) -> None:
    """Append ``df`` to ``path`` as ``n_files`` JSON slices in ``order``, each of
    ``files`` files.

    Slices are appended one after another, so file times follow ``order`` and
    a file stream that takes ``files`` files a trigger sees one slice a time.
    The numbered rows are written once and every slice reads its own folder.  A single integer key is sliced by
    value range from one min/max aggregate; other keys by a distributed
    ordinal.  Replay/test feeder only.
    """
    numeric = (len(order) == 1 and isinstance(order[0], str)
               and dict(df.dtypes).get(order[0]) in ("bigint", "int", "smallint"))
    if numeric:
        k = order[0]
        lo, hi = df.agg(F.min(k), F.max(k)).first()
        span = max(1, (hi - lo + 1) if lo is not None else 1)
        o = df.withColumn("_slice", F.floor((F.col(k) - F.lit(lo or 0)) * F.lit(n_files) / F.lit(span)))
    else:
        from evalspark.operators.ordinals import global_ordinal
        o = global_ordinal(df, order, out="_o")
        total = max(1, o.count())
        o = o.withColumn("_slice", F.floor((F.col("_o") - 1) * F.lit(n_files) / F.lit(total))).drop("_o")
    staged = scratch_path(df.sparkSession, "slices")
    o.write.partitionBy("_slice").parquet(staged)
    rows = df.sparkSession.read.schema(o.schema).parquet(staged)
    for i in which if which is not None else range(n_files):
        rows.filter(F.col("_slice") == i).drop("_slice").repartition(files).write.mode("append").json(path)
