"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame, which ``run``
writes to the shared folder and reads again as the next stage's ``docs``.  All
but the last return the columns of ``documents``.  ``docs`` is a table as read,
whose rows are known by their place in its files (any other frame is written
first), so that texts are neither copied nor shuffled more than once.

1. toxicity: documents that the neighbour vote rejects go; labels outside the
   held-out fold teach it.
2. exact dedup: of equal texts (but for A-Z case) the largest id stays.
3. near dedup: of a class of near duplicates the smallest id stays.
4. mixing: each row is an unbroken run of words that one pass of the mix takes
   of a document.  A pass takes a document whole, or in runs that end where a
   block does or the document itself; no word is taken over three times.
5. packing: adds tokens, bucket, batch, slot and padding.

Null texts count as empty; they teach and take nothing and get no batch.  An
empty table passes through every stage.  Columns that only look like a
stage's own are kept, but in the last stage, whose columns replace them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import op3_source_mix, op6_length_packing, op7_toxicity_neighbours
from evalspark.llm import op8_stream_dedup, op9_order_near_dups
from evalspark.llm.common import materialise, table, written
from evalspark.session import ensure_checkpoint_dir


def addressed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_at``, a row's place in the files that it is read from."""
    try:
        meta = docs.metadataColumn("_metadata")
        return docs.withColumn("_at", F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row")))
    except AnalysisException:
        return addressed(materialise(docs, "pipeline-rows"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = op7_toxicity_neighbours.learn(spark, docs, sf_dir)
    scored = op7_toxicity_neighbours.score(docs, model)
    return scored.filter(F.col("_toxic.predicted") == 0).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = written(docs, "pipeline-docs")
    kept = op8_stream_dedup.stream_dedup(spark, path).filter("kept").select(F.col("at").alias("_at"))
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return (spark.read.schema(docs.schema).parquet(path).withColumn("_at", at)
            .join(kept, "_at", "left_semi").select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # A row is known by its id and text; equal rows are one class, so one stays.
    text = F.coalesce("text", F.lit(""))
    key = ["_id", "_x", "_y"]
    rows = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                             "_x": F.xxhash64(text), "_y": F.hash(text)})
    kept = op9_order_near_dups.near_duplicates(rows, carry=tuple(key)).filter("kept").select(*key)
    return rows.join(kept, key, "left_semi").dropDuplicates(key).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = addressed(docs)
    mixed = op3_source_mix.mix(rows, carry=("_at",))
    return (op3_source_mix.taken_texts(mixed, rows, "_at")
            .withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Narrow rows are numbered; the texts are joined to them in one shuffle.
    rows = addressed(docs)
    counted = op6_length_packing.token_lengths(rows)
    lengths = materialise(counted.select("_at", "n_tokens", op6_length_packing.order_hash(
        ["doc_id", "n_tokens", "text"]).alias("_hash")), "pipeline-tokens")
    packed = op6_length_packing.pack(lengths, "n_tokens", ["_at"], hashed=F.col("_hash")).drop("_hash")
    own = ["bucket", "batch", "slot", "padding"]
    columns = [c for c in counted.columns if c not in ("_at", *own)]
    return rows.drop("n_tokens", *own).join(packed, "_at").select(*columns, *own)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("near dedup", near_dedup),
          ("mixing", mixing), ("packing", packing)]

# Neighbour votes, alignment and the mix's permutations are not SQL; the stages
# are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
