"""Exact deduplication with keyed streaming state.

A Structured Streaming query reads the documents in micro-batches and keeps,
per text digest and without expiry, the largest id seen, that row's locator
(file and row number) and a count.  The state lives in RocksDB on the
executors' disks and is checkpointed to the shared folder, so a lost executor
or a restarted query goes on from the last batch.  The state holds no text:
rows whose digest was hit more than once are compared, byte for byte, with
the text found at the kept row's locator.  Rows that differ (a digest
collision) are grouped by their full text instead.

Only DataFrame functions are used.  One third of all rows in one group is
counted by map-side partial aggregation, and joined on its digest by a join
whose large partitions are split at run time.

A null text equals the empty text.  Of equal texts the row with the largest
id is kept (a null id is the smallest; equal ids: the last by file and row).
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import materialise, session_conf
from evalspark.session import ensure_checkpoint_dir, scratch_path

QUERY = "op8_stream_dedup"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else; null becomes empty.

    An ASCII text takes the fast ``lower``; in others only A-Z may change."""
    text = F.coalesce(text, F.lit(""))
    return (F.when(F.octet_length(text) == F.length(text), F.lower(text))
            .otherwise(F.translate(text, UPPER, LOWER)))


def sha256_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _rows(frame: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, normalised text and locator of each row of a file-based frame."""
    return frame.select(
        F.col(id_col).cast("bigint").alias("doc_id"), ascii_lower(F.col(text_col)).alias("text"),
        F.struct(F.col("_metadata.file_path").alias("file"),
                 F.col("_metadata.row_index").alias("row")).alias("at"))


def run_state(spark: SparkSession, path: str, id_col: str, text_col: str, digest, batches: int,
              checkpoint: str) -> DataFrame:
    """Run the stream over the Parquet files at ``path`` until it has read them
    all; return its state: digest, keep (id and locator), n."""
    static = spark.read.parquet(path)
    size = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
            .agg(F.sum("length")).first()[0] or 1)
    path = path.rstrip("/")
    # As a pattern the path may also name a single file, which a stream refuses.
    source = (spark.readStream.schema(static.schema)
              .option("maxBytesPerTrigger", str(max(1, -(-size // batches))))
              .parquet(f"{path[:-1]}[{path[-1]}]"))
    state = (_rows(source, id_col, text_col)
             .select(digest(F.col("text")).alias("digest"), F.struct("doc_id", "at").alias("row"))
             .groupBy("digest").agg(F.max("row").alias("keep"), F.count(F.lit(1)).alias("n")))
    with session_conf(spark, **{
            "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
            "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
            # Else every partition's store reserves 4 MB of disk for its manifest.
            "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}):
        running = (state.writeStream.format("noop").outputMode("update")
                   .option("checkpointLocation", checkpoint)
                   .trigger(availableNow=True).start())
        running.awaitTermination()
    found = spark.read.format("statestore").load(checkpoint)
    keep, n = found.schema["value"].dataType.names
    return found.select("key.digest", F.col("value")[keep].alias("keep"), F.col("value")[n].alias("n"))


def stream_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
                 digest=sha256_digest, batches: int = 4) -> DataFrame:
    """One row per row of the Parquet table at ``path``: doc_id, keep_id,
    group_size, kept, text_sha256, and its locator ``at``."""
    ensure_checkpoint_dir(spark)
    if not spark.read.parquet(path).limit(1).count():
        return spark.createDataFrame([], "doc_id bigint, keep_id bigint, group_size bigint, "
                                         "kept boolean, text_sha256 string, "
                                         "at struct<file:string,row:bigint>")
    state = materialise(run_state(spark, path, id_col, text_col, digest, batches,
                                  scratch_path(spark, "dedup-stream")), "dedup-state")
    rows = _rows(spark.read.parquet(path), id_col, text_col)
    rows = rows.select("*", digest(F.col("text")).alias("digest"), F.sha2("text", 256).alias("sha"))
    # Texts travel once; past this join only texts of hit digests are kept.
    seen = materialise(
        rows.join(state, "digest", "left")
        .select("doc_id", "digest", "sha", "at", "keep", "n",
                F.when(F.col("n") > 1, F.col("text")).alias("text")), "dedup-rows")
    single = seen.filter("n = 1").select("doc_id", "sha", "at", "keep", "n")

    hits = seen.filter("n > 1")
    kept = hits.filter("at = keep.at").select("digest", F.col("text").alias("kept_text"))
    # Empty for equal bytes, else the text itself: a second group of the digest.
    # Written before and after grouping: a join that stands alone in its stage
    # is one whose large partitions Spark can split.
    hits = materialise(hits.join(kept, "digest", "left").select(
        "doc_id", "digest", "sha", "at",
        F.when(F.col("text") == F.col("kept_text"), F.lit(None)).otherwise(F.col("text")).alias("other")),
        "dedup-hits")
    groups = materialise(
        hits.groupBy(F.col("digest").alias("g_digest"), F.col("other").alias("g_other")).agg(
            F.max(F.struct("doc_id", "at")).alias("keep"), F.count(F.lit(1)).alias("n")), "dedup-groups")
    double = (hits.join(groups, (F.col("digest") == F.col("g_digest"))
                        & F.col("other").eqNullSafe(F.col("g_other")), "left")
              .select("doc_id", "sha", "at", "keep", "n"))
    return single.unionByName(double).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("at") == F.col("keep.at")).alias("kept"), F.col("sha").alias("text_sha256"), "at")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup(spark, f"{sf_dir.rstrip('/')}/documents.parquet").drop("at")


SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
