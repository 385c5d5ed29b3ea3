"""Readers and writers for banks, rosters, annotation exports, responses and
the hosted-batch request/result files (S1, S3–S8, S10).

Quoted multi-line CSV exports, and JSON-array banks on request, are read from
byte ranges by many tasks (:mod:`evalspark.sources.pieces`); by default a
JSON array is one task, as most banks are small.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark import schemas
from evalspark.functions.assets import split_path, strip_leading_slash
from evalspark.functions.text import let
from evalspark.session import cut_lineage, read_if_exists
from evalspark.sources.listing import can_walk, walk_files
from evalspark.sources.pieces import csv_records, json_records


# ----------------------------------------------------------------- S1 / S2
def read_bank(spark: SparkSession, path: str, multi_line: bool = True,
              schema: T.StructType = schemas.BANK, columns: list[str] | None = None,
              split: bool = False) -> DataFrame:
    """Question bank from JSON (array-of-records files by default).

    The explicit schema covers every bank variant; absent fields read as null.
    ``columns`` is a projection (S2) — on Parquet it prunes the scan.
    ``split`` reads one array by many tasks, for files too large for one.
    """
    if split:
        df = json_records(spark, path).select(F.from_json("record", schema).alias("_r")).select("_r.*")
    else:
        df = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    return df.select(*columns) if columns else df


def land_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                 mode: str = "overwrite") -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


# --------------------------------------------------------------------- S3
def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """S3: annotation CSV export with quoted commas/newlines, any schema version.

    Read every column as text, then evolve: ``question_id`` -> ``question_ref``,
    missing columns -> null, ``necessary`` lower-cased ('' -> null),
    ``None``/'' answers kept as they are (the scorer decides), timestamps with
    a ``+00`` suffix parsed as UTC.

    Exports with different headers may share a folder: every file's first
    record is joined to its other records, and only the distinct headers (one
    per version of the export) reach the driver, to name the columns.  Files
    are read once, in byte ranges.  Repeated column names keep the first.
    """
    rows = csv_records(spark, path)
    headers = cut_lineage(rows.filter("first").select("file", F.col("record").alias("header")))
    out = rows.filter(~F.col("first")).join(headers, "file")
    fields = F.lit(None)
    for h in sorted(r[0] for r in headers.select("header").distinct().collect()):
        names = next(csv.reader([h.replace("\n", " ")]))
        positions = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
        cells = F.from_csv("record", F.lit(positions.simpleString()[len("struct<"):-1].replace(":", " ")), CSV_OPTIONS)
        known = {}
        for i, n in enumerate(names):
            known.setdefault("question_ref" if n == "question_id" and "question_ref" not in names else n, f"_c{i}")
        parsed = let(cells, _columns_of(known))
        fields = F.when(F.col("header") == h, parsed).otherwise(fields)
    if fields is None or not headers.take(1):
        empty = T.StructType([T.StructField(n, T.StringType()) for n in schemas.ANNOTATION_COLUMNS])
        return _typed_annotations(spark.createDataFrame([], empty))
    return _typed_annotations(out.select(fields.alias("_f")).select("_f.*"))


def _columns_of(known: dict[str, str]):
    """The annotation columns of parsed cells; ``known`` names the cell of each that is there."""
    return lambda c: F.struct(*[(c[known[n]] if n in known else F.lit(None).cast("string")).alias(n)
                                for n in schemas.ANNOTATION_COLUMNS])


CSV_OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}


def _typed_annotations(raw: DataFrame) -> DataFrame:
    if "question_id" in raw.columns and "question_ref" not in raw.columns:
        raw = raw.withColumnRenamed("question_id", "question_ref")
    for c in schemas.ANNOTATION_COLUMNS:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    ts = F.regexp_replace(F.col("timestamp"), r"\+00$", "+00:00")
    return raw.select(
        "question_ref",
        F.col("id").try_cast("bigint").alias("id"),
        "answer",
        F.coalesce(F.try_to_timestamp(ts), F.try_to_timestamp(F.col("timestamp"))).alias("timestamp"),
        "user_id",
        F.nullif(F.lower(F.trim(F.col("necessary"))), F.lit("")).alias("necessary"),
        "validity", "map_count", "question_text", "spatial_relationship", "noinfo_reason",
        "expected_answer",
        F.col("count").try_cast("int").alias("count"),
    )


def read_annotation_store(spark: SparkSession, url: str, table: str, properties: dict,
                          lower: int, upper: int, num_partitions: int = 64) -> DataFrame:
    """The relational annotation table, read in parallel ranges of ``id``.

    Credentials come from ``properties`` supplied by the caller, never from
    code.  Rows get the same typing as the CSV export.
    """
    df = spark.read.jdbc(url, table, column="id", lowerBound=lower, upperBound=upper,
                         numPartitions=num_partitions, properties=properties)
    for c in schemas.ANNOTATION_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df.withColumn("necessary", F.nullif(F.lower(F.trim(F.col("necessary"))), F.lit("")))


def write_annotations_csv(df: DataFrame, path: str) -> str:
    (df.write.mode("overwrite").option("header", True).option("quote", '"')
     .option("escape", '"').option("quoteAll", False).csv(path))
    return path


# --------------------------------------------------------------------- S4
def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """``user_id,user_name`` with ids kept as strings (leading zeros).

    An empty roster is an error (the reference stops with a message).
    """
    df = spark.read.schema(schemas.ROSTER).option("header", True).csv(path)
    if df.isEmpty():
        raise ValueError(f"roster {path} is empty — need at least one user")
    return df


# --------------------------------------------------------------------- S5
def asset_manifest(spark: SparkSession, root: str,
                   extensions: tuple[str, ...] = ("png", "jpg", "jpeg"),
                   recursive: bool = True) -> DataFrame:
    """Image files under ``root`` as ``(dir, name, path)``, relative to root.

    Executors list the folders (:mod:`evalspark.sources.listing`), and file
    contents are never read.  The root may be a plain path or a URI.  A store that
    only Spark can open is listed by Spark's driver, which then holds the list.
    Hidden names (``.x``, ``_x``) are left out.
    """
    if can_walk(root):
        name = F.element_at(F.split("path", "/"), -1)
        files = walk_files(spark, root, recursive).filter(
            name.contains(".") & F.element_at(F.split(name, r"\."), -1).isin(list(extensions)))
        return manifest_from_paths(files, "path")
    pattern = "*.{" + ",".join(extensions) + "}"
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", recursive).load(root).select("path"))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(hadoop)
    prefix = base.toString().rstrip("/") + "/"
    plain = F.regexp_replace("path", "^file:/+", "file:/")
    prefix = re.sub("^file:/+", "file:/", prefix)
    rel = F.when(plain.startswith(prefix), F.substring(plain, len(prefix) + 1, 1 << 20)).otherwise(plain)
    return manifest_from_paths(files.select(rel.alias("path")), "path")


def manifest_from_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """``(dir, name, path)`` for a table of relative asset paths."""
    p = strip_leading_slash(F.col(path))
    sp = split_path(p)
    return df.select(sp["dir"].alias("dir"), sp["name"].alias("name"), p.alias("path"))


# --------------------------------------------------------------- S6 / S10
def response_file_tag(distractor: bool) -> str:
    """``_w_contextual`` / ``_wo_contextual`` naming of the reference."""
    return "w_contextual" if distractor else "wo_contextual"


def write_responses(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Long responses partitioned by ``model`` and ``setting``.

    Appends: what was stored stays, and rows whose (question_ref, model,
    setting) is stored already are left out, so writing the pending rows of a
    second run, or the same rows again, loses and repeats nothing.
    """
    key = ["question_ref", "model", "setting"]
    stored = read_if_exists(df.sparkSession, path, fmt)
    if stored is not None:
        df = df.join(stored.select(*key).distinct(), key, "left_anti").select(*df.columns)
    df.write.mode("append").partitionBy("model", "setting").format(fmt).save(path)
    return path


def write_bank_partitioned(df: DataFrame, path: str, by: list[str]) -> str:
    """One folder per slice (tier / relationship); reads prune partitions."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return path


def read_bank_slice(spark: SparkSession, path: str, **values: str) -> DataFrame:
    """Read the folders of one slice only (``tier="all"``, ``spatial_relationship=...``):
    equality filters on partition columns become ``PartitionFilters``."""
    df = spark.read.parquet(path)
    for c, v in values.items():
        df = df.filter(F.col(c) == F.lit(v))
    return df


# --------------------------------------------------------------- S7 / S8
def batch_request_column(key, system_text, question, uris, mime_types) -> F.Column:
    """One hosted-batch request (text first, then the images) as JSON."""
    contents = F.concat(
        F.array(F.struct(question.alias("text"),
                         F.lit(None).cast("struct<file_uri:string,mime_type:string>").alias("file_data"))),
        F.transform(F.arrays_zip(uris.alias("u"), mime_types.alias("m")),
                    lambda z: F.struct(F.lit(None).cast("string").alias("text"),
                                       F.struct(z["u"].alias("file_uri"),
                                                z["m"].alias("mime_type")).alias("file_data"))))
    req = F.struct(
        key.alias("key"),
        F.struct(F.struct(F.array(F.struct(system_text.alias("text"))).alias("parts"))
                 .alias("system_instruction"),
                 contents.alias("contents")).alias("request"))
    return F.to_json(req, {"ignoreNullFields": "true"})


def write_batch_requests(df: DataFrame, path: str, json_col: str = "request_json") -> str:
    """One JSON object per line (text files, any number of parts)."""
    df.select(F.col(json_col).alias("value")).write.mode("overwrite").text(path)
    return path


def read_batch_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.BATCH_REQUEST).json(path)


def read_batch_results(spark: SparkSession, path: str, requests: DataFrame | None = None,
                       job_state: str = "JOB_STATE_SUCCEEDED") -> DataFrame:
    """Per key ``status`` ok / raw / error, ``text``, ``error``.

    ``ok``: a response with text, at its top or in its candidates' parts;
    ``raw``: a response object without any (the payload is kept); ``error``: an
    error entry; ``bad_line``: a line that is no result (key null, the line as
    text).  A key that comes twice counts once: ok before raw before error,
    then the smaller text.  With ``requests``, keys that have no result at all
    are reported as ``missing``; bad lines are kept.  A failed job yields no
    rows.
    """
    if job_state != "JOB_STATE_SUCCEEDED":
        import warnings
        warnings.warn(f"batch job did not succeed: {job_state}; no results read", stacklevel=2)
        return spark.createDataFrame([], "key string, status string, text string, error string")
    raw = spark.read.text(path).select(F.col("value").alias("_line"))
    parsed = raw.select("_line", F.from_json("_line", schemas.BATCH_RESULT).alias("r"))
    parts = F.from_json(F.get_json_object("_line", "$.response"), NESTED_RESPONSE)
    nested = F.array_join(F.filter(F.flatten(F.transform(
        parts["candidates"], lambda c: F.transform(c["content"]["parts"], lambda p: p["text"]))),
        lambda t: t.isNotNull()), "")
    text = F.coalesce(F.col("r.response.text"), F.nullif(nested, F.lit("")))
    bad = F.col("r.key").isNull()
    res = parsed.filter(F.trim("_line") != "").select(
        F.col("r.key").alias("key"),
        F.when(bad, F.lit("bad_line")).when(F.col("r.error").isNotNull(), F.lit("error"))
        .when(text.isNotNull(), F.lit("ok")).otherwise(F.lit("raw")).alias("status"),
        F.when(bad, F.col("_line")).when(F.col("r.error").isNull(), F.coalesce(
            text, F.get_json_object("_line", "$.response"))).alias("text"),
        F.col("r.error").alias("error"))
    bad_lines = res.filter("status = 'bad_line'")
    # One row per key: "ok" < "raw" < "error" by rank, then by text.
    rank = F.when(F.col("status") == "ok", 0).when(F.col("status") == "raw", 1).otherwise(2)
    res = (res.filter("status <> 'bad_line'").groupBy("key")
           .agg(F.min(F.struct(rank.alias("rank"), "text", "error", "status")).alias("r"))
           .select("key", "r.status", "r.text", "r.error"))
    if requests is not None:
        keys = requests.select("key").distinct()
        res = (keys.join(res, "key", "left")
               .withColumn("status", F.coalesce(F.col("status"), F.lit("missing"))))
    return res.unionByName(bad_lines)


# The nested payload of a hosted result, as far as text goes.
NESTED_RESPONSE = "candidates array<struct<content: struct<parts: array<struct<text: string>>>>>"
