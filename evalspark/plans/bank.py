"""Bank & shape stand-in queries: S1, S3–S8, S10, S12, J1, J2, P5, P6, U1, U2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.text import symmetric_difference_size
from evalspark.operators import shape
from evalspark.plans import standins
from evalspark.plans.registry import register
from evalspark.session import read_table, scratch_path
from evalspark.sources import bank as io

BANK_OUT = ["question_ref", "question_text", "expected_answer", "map_count",
            "spatial_relationship", "answer_type"]


def _bank_flat(df: DataFrame) -> DataFrame:
    return df.select(*BANK_OUT, F.array_join("image_urls", "|").alias("image_urls"),
                     F.array_join("contextual_urls", "|").alias("contextual_urls"))


BANK_FLAT_SQL = (", ".join(BANK_OUT)
                 + ", array_to_string(image_urls, '|') AS image_urls,"
                 " array_to_string(contextual_urls, '|') AS contextual_urls")


@register("read_bank", "S1", lambda: f"SELECT {BANK_FLAT_SQL} FROM ({standins.bank_sql()})")
def q_read_bank(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "bank_json")
    standins.bank(spark, sf).drop("source", "lang", "doc_id").write.mode("overwrite").json(path)
    return _bank_flat(io.read_bank(spark, path, multi_line=False))


@register("read_bank_array", "S1", lambda: f"SELECT {BANK_FLAT_SQL} FROM ({standins.bank_sql()})")
def q_read_bank_array(spark: SparkSession, sf: str) -> DataFrame:
    """S1 in its array form: files that are each one JSON array of records."""
    record = F.to_json(F.struct(*[c for c in standins.bank(spark, sf).columns if c not in ("source", "lang", "doc_id")]))
    bank = standins.bank(spark, sf)
    # One file per hundred records, holding one JSON array.
    arrays = (bank.select(F.floor(F.col("doc_id") / 100).alias("part"), record.alias("r"))
              .groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ","), F.lit("]")).alias("value")))
    path = scratch_path(spark, "bank_arrays")
    arrays.write.partitionBy("part").text(path)
    return _bank_flat(io.read_bank(spark, f"{path}/*", multi_line=True))


@register("read_bank_split", "S1", lambda: f"SELECT {BANK_FLAT_SQL} FROM ({standins.bank_sql()})")
def q_read_bank_split(spark: SparkSession, sf: str) -> DataFrame:
    """S1 from arrays that several tasks read: the same files, cut at byte ranges."""
    record = F.to_json(F.struct(*[c for c in standins.bank(spark, sf).columns if c not in ("source", "lang", "doc_id")]))
    arrays = (standins.bank(spark, sf).select(F.floor(F.col("doc_id") / 1000).alias("part"), record.alias("r"))
              .groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ","), F.lit("]")).alias("value")))
    path = scratch_path(spark, "bank_arrays")
    arrays.write.partitionBy("part").text(path)
    return _bank_flat(io.read_bank(spark, f"{path}/*", split=True))


@register("read_bank_columns", "S2", lambda: f"""
SELECT question_ref, answer_type, map_count FROM ({standins.bank_sql()})""")
def q_read_bank_columns(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "bank_json")
    standins.bank(spark, sf).drop("source", "lang", "doc_id").write.json(path)
    return io.read_bank(spark, path, multi_line=False, columns=["question_ref", "answer_type", "map_count"])


@register("sort_by_ref", "T1", lambda: f"""
SELECT question_ref, row_number() OVER (ORDER BY question_ref) AS position FROM ({standins.bank_sql()})""")
def q_sort_by_ref(spark: SparkSession, sf: str) -> DataFrame:
    """The sorted rows, written and read back with their place in the order."""
    from evalspark.operators import basic, ordinals
    bank = standins.bank(spark, sf).select("question_ref")
    path = scratch_path(spark, "bank_sorted")
    basic.sort_by_ref(bank).write.parquet(path)
    placed = ordinals.global_ordinal(spark.read.parquet(path), ["question_ref"], out="position")
    return placed.select("question_ref", "position")


@register("asset_files", "S5", """
SELECT CAST(page_id % 10 AS VARCHAR) AS folder, count(*) AS n
FROM pages GROUP BY page_id % 10""")
def q_asset_files(spark: SparkSession, sf: str) -> DataFrame:
    """S5's file reader: files laid out in ten folders are listed and told apart."""
    pages = read_table(spark, sf, "pages").select("page_id", (F.col("page_id") % 10).alias("k"))
    path = scratch_path(spark, "asset_files")
    pages.repartition("k").write.partitionBy("k").parquet(path)
    files = io.asset_manifest(spark, path, extensions=("parquet",))
    rows = (spark.read.option("basePath", path).parquet(path)
            .groupBy(F.col("_metadata.file_name").alias("name"), F.col("k").cast("string").alias("k"))
            .agg(F.count(F.lit(1)).alias("n")))
    j = files.join(rows, (F.col("dir") == F.concat(F.lit("k="), F.col("k"))) & (files["name"] == rows["name"]))
    return j.groupBy(F.col("k").alias("folder")).agg(F.sum("n").alias("n"))


@register("read_annotations", "S3", lambda: f"""
SELECT question_ref, event_id AS id, answer, epoch_us("timestamp") AS ts_us, "user" AS user_id,
       nullif(lower(trim(necessary)), '') AS necessary, validity, map_count, question_text,
       spatial_relationship, noinfo_reason, CAST(NULL AS VARCHAR) AS expected_answer,
       CAST(event_id % 4 AS INTEGER) AS "count"
FROM ({standins.submissions_sql()})""")
def q_read_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Export annotations the way the store does (``+00`` timestamps, an old
    ``question_id`` column name, no ``expected_answer``), then read them back."""
    sub = standins.submissions(spark, sf)
    export = sub.select(
        F.col("question_ref").alias("question_id"), F.col("event_id").alias("id"), "answer",
        F.concat(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00")).alias("timestamp"),
        F.col("user").alias("user_id"), "necessary", "validity", "map_count", "question_text",
        "spatial_relationship", "noinfo_reason", (F.col("event_id") % 4).alias("count"))
    path = scratch_path(spark, "annotations_csv")
    io.write_annotations_csv(export, path)
    ann = io.read_annotations(spark, path)
    return ann.select("question_ref", "id", "answer",
                      F.unix_micros("timestamp").alias("ts_us"), *[c for c in ann.columns if c not in (
                          "question_ref", "id", "answer", "timestamp")])


@register("read_roster", "S4", """
SELECT printf('%05d', c_custkey) AS user_id, c_name AS user_name FROM customer""")
def q_read_roster(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer")
    path = scratch_path(spark, "roster_csv")
    (c.select(F.format_string("%05d", "c_custkey").alias("user_id"), F.col("c_name").alias("user_name"))
     .write.mode("overwrite").option("header", True).csv(path))
    return io.read_roster(spark, path)


PAGE_PATH_SQL = "regexp_extract(url, '^https?://[^/]+/(.*)$', 1)"


@register("asset_manifest", "S5", f"""
SELECT CASE WHEN contains(p, '/') THEN regexp_extract(p, '^(.*)/([^/]*)$', 1) ELSE '' END AS dir,
       CASE WHEN contains(p, '/') THEN regexp_extract(p, '^(.*)/([^/]*)$', 2) ELSE p END AS name,
       p AS path
FROM (SELECT regexp_replace({PAGE_PATH_SQL}, '^/+', '') AS p FROM pages)""")
def q_asset_manifest(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages")
    paths = pages.select(F.regexp_extract("url", r"^https?://[^/]+/(.*)$", 1).alias("path"))
    return io.manifest_from_paths(paths, "path")


@register("write_responses", "S6", lambda: f"SELECT * FROM ({standins.responses_sql()})")
def q_write_responses(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "responses")
    io.write_responses(standins.responses(spark, sf), path)
    return spark.read.parquet(path).select("question_ref", "model", "setting", "response")


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "conversations")
    sysd = c.filter(F.col("role") == "system").groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("system_text"))
    usr = c.filter(F.col("role") == "user").groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("question"))
    img = c.filter(F.col("role") == "assistant").groupBy("conv_id").agg(
        F.array_sort(F.collect_list("turn")).alias("turns"))
    base = c.select("conv_id").distinct()
    j = base.join(sysd, "conv_id", "left").join(usr, "conv_id", "left").join(img, "conv_id", "left")
    uris = F.transform(F.coalesce(F.col("turns"), F.array().cast("array<bigint>")),
                       lambda t: F.format_string("files/c%d_%d", F.col("conv_id"), t))
    mimes = F.transform(uris, lambda u: F.lit("image/png"))
    return j.select(F.format_string("q_%04d", "conv_id").alias("key"), io.batch_request_column(
        F.format_string("q_%04d", "conv_id"),
        F.coalesce(F.col("system_text"), F.lit("Answer the question.")),
        F.coalesce(F.col("question"), F.lit("")), uris, mimes).alias("request_json"))


REQUESTS_SQL = """
SELECT printf('q_%04d', b.conv_id) AS key,
       coalesce(s.system_text, 'Answer the question.') AS system_text,
       CAST(1 + coalesce(len(i.turns), 0) AS INTEGER) AS n_contents,
       md5(coalesce(u.question, '')) AS question_md5,
       coalesce(array_to_string(list_transform(i.turns, lambda t: printf('files/c%d_%d', b.conv_id, t)), '|'), '')
         AS uris
FROM (SELECT DISTINCT conv_id FROM conversations) b
LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS system_text FROM conversations
           WHERE role = 'system' GROUP BY conv_id) s ON b.conv_id = s.conv_id
LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS question FROM conversations
           WHERE role = 'user' GROUP BY conv_id) u ON b.conv_id = u.conv_id
LEFT JOIN (SELECT conv_id, list(turn ORDER BY turn) AS turns FROM conversations
           WHERE role = 'assistant' GROUP BY conv_id) i ON b.conv_id = i.conv_id"""


@register("write_batch_requests", "S7", REQUESTS_SQL)
def q_write_batch_requests(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "batch_requests")
    io.write_batch_requests(_requests(spark, sf), path)
    r = io.read_batch_requests(spark, path)
    contents = F.col("request.contents")
    return r.select(
        "key",
        F.col("request.system_instruction.parts")[0]["text"].alias("system_text"),
        F.size(contents).alias("n_contents"),
        F.md5(contents[0]["text"]).alias("question_md5"),
        F.array_join(F.transform(F.filter(contents, lambda x: x["file_data"].isNotNull()),
                                 lambda x: x["file_data"]["file_uri"]), "|").alias("uris"))


@register("read_batch_results", "S8", """
WITH last_a AS (SELECT conv_id, arg_max(text, turn) AS text FROM conversations
                WHERE role = 'assistant' GROUP BY conv_id),
     keys AS (SELECT DISTINCT conv_id FROM conversations)
SELECT printf('q_%04d', k.conv_id) AS key,
       CASE WHEN k.conv_id % 5 = 4 THEN 'missing' WHEN k.conv_id % 7 = 0 THEN 'error'
            WHEN a.text IS NOT NULL THEN 'ok' ELSE 'raw' END AS status,
       CASE WHEN k.conv_id % 5 = 4 OR k.conv_id % 7 = 0 THEN NULL
            WHEN a.text IS NOT NULL THEN md5(a.text) ELSE md5('{"candidates":[]}') END AS text_md5,
       CASE WHEN k.conv_id % 5 <> 4 AND k.conv_id % 7 = 0 THEN 'RESOURCE_EXHAUSTED' END AS error
FROM keys k LEFT JOIN last_a a ON k.conv_id = a.conv_id""")
def q_read_batch_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results file written from the conversations: every 7th key an error,
    a response without text where there is no assistant turn, every 5th key
    (remainder 4) missing from the file."""
    c = read_table(spark, sf, "conversations")
    last = c.filter(F.col("role") == "assistant").groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("text"))
    keys = c.select("conv_id").distinct()
    res = keys.join(last, "conv_id", "left").filter(F.col("conv_id") % 5 != 4)
    line = (F.when(F.col("conv_id") % 7 == 0,
                   F.to_json(F.struct(F.format_string("q_%04d", "conv_id").alias("key"),
                                      F.lit("RESOURCE_EXHAUSTED").alias("error"))))
            .when(F.col("text").isNotNull(),
                  F.to_json(F.struct(F.format_string("q_%04d", "conv_id").alias("key"),
                                     F.struct(F.col("text").alias("text")).alias("response"))))
            .otherwise(F.to_json(F.struct(
                F.format_string("q_%04d", "conv_id").alias("key"),
                F.struct(F.array().cast("array<string>").alias("candidates")).alias("response")))))
    path = scratch_path(spark, "batch_results")
    res.select(line.alias("value")).write.mode("overwrite").text(path)
    requests = keys.select(F.format_string("q_%04d", "conv_id").alias("key"))
    out = io.read_batch_results(spark, path, requests=requests)
    return out.select("key", "status", F.md5("text").alias("text_md5"), "error")


@register("write_bank_partitioned", "S10", lambda: f"""
SELECT question_ref, answer_type, spatial_relationship, source
FROM ({standins.bank_sql()})""")
def q_write_bank_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "bank_partitioned")
    b = standins.bank(spark, sf).drop("doc_id", "lang")
    io.write_bank_partitioned(b, path, ["answer_type", "spatial_relationship"])
    return spark.read.parquet(path).select("question_ref", "answer_type", "spatial_relationship", "source")


def _variants(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    lab = read_table(spark, sf, "labels")
    ref = F.format_string("q_%04d", "doc_id").alias("question_ref")
    hi = lab.filter(F.col("quality") == 1).select(
        ref, F.array(F.format_string("ctx/%d_a.png", "doc_id"),
                     F.format_string("ctx/%d_b.png", "doc_id")).alias("contextual_urls"))
    tox = lab.select(ref, F.array(F.format_string("ctx/%d_t%d.png", "doc_id", "toxic"))
                     .alias("contextual_urls"))
    return {"quality": hi, "toxic": tox}


@register("merge_contextual", "S12", """
WITH v AS (
  SELECT printf('q_%04d', doc_id) AS question_ref, 'quality' AS variant,
         printf('ctx/%d_a.png', doc_id) || '|' || printf('ctx/%d_b.png', doc_id) AS ctx
  FROM labels WHERE quality = 1
  UNION ALL
  SELECT printf('q_%04d', doc_id), 'toxic', printf('ctx/%d_t%d.png', doc_id, toxic) FROM labels)
SELECT coalesce(b.question_ref, v.question_ref) AS question_ref, b.lang,
       coalesce(b.variant, v.variant) AS variant, v.ctx AS contextual_urls
FROM (SELECT printf('q_%04d', doc_id) AS question_ref, lang, unnest(['quality', 'toxic']) AS variant
      FROM documents) b
FULL OUTER JOIN v ON b.question_ref = v.question_ref AND b.variant = v.variant""")
def q_merge_contextual(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").select(
        F.format_string("q_%04d", "doc_id").alias("question_ref"), "lang")
    m = shape.merge_contextual(d, _variants(spark, sf))
    return m.select("question_ref", "lang", "variant",
                    F.array_join("contextual_urls", "|").alias("contextual_urls"))


@register("align", "J1", """
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.lang, d.n_chars, l.quality, l.toxic
FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id""")
def q_align(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    lab = read_table(spark, sf, "labels")
    return shape.align(d, lab).select("doc_id", "lang", "n_chars", "quality", "toxic")


@register("align_left", "J2", """
SELECT o.o_orderkey, o.o_totalprice, l.l_linenumber, l.l_quantity
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey""")
def q_align_left(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    li = read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return shape.align_left(o, li)


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    return li.select(
        F.format_string("q_%d_%d", "l_orderkey", "l_linenumber").alias("question_ref"),
        F.col("l_quantity").cast("string").alias("qty_response"),
        F.col("l_extendedprice").cast("string").alias("price_response"),
        F.col("l_discount").cast("string").alias("vlm2.5_response"))


@register("resolve_response_column", "P5", """
SELECT printf('q_%d_%d', l_orderkey, l_linenumber) AS question_ref,
       CAST(l_quantity AS VARCHAR) AS _response
FROM lineitem""")
def q_resolve_response_column(spark: SparkSession, sf: str) -> DataFrame:
    return shape.resolve_response_column(_wide(spark, sf)).select("question_ref", "_response")


@register("melt_responses", "P6", """
SELECT question_ref, replace(model, '_response', '') AS model, response
FROM (SELECT printf('q_%d_%d', l_orderkey, l_linenumber) AS question_ref,
             CAST(l_quantity AS VARCHAR) AS qty_response,
             CAST(l_extendedprice AS VARCHAR) AS price_response,
             CAST(l_discount AS VARCHAR) AS "vlm2.5_response" FROM lineitem)
UNPIVOT (response FOR model IN (qty_response, price_response, "vlm2.5_response"))""")
def q_melt_responses(spark: SparkSession, sf: str) -> DataFrame:
    return shape.melt_responses(_wide(spark, sf), ids=["question_ref"])


@register("diagonal_union", "U1", """
SELECT doc_id, text, lang, source, n_chars, NULL::BIGINT AS page_id, NULL::VARCHAR AS url,
       NULL::VARCHAR AS html FROM documents
UNION ALL
SELECT NULL, NULL, NULL, NULL, NULL, page_id, url, html FROM pages""")
def q_diagonal_union(spark: SparkSession, sf: str) -> DataFrame:
    return shape.diagonal_union([read_table(spark, sf, "documents"), read_table(spark, sf, "pages")])


@register("symmetric_difference_size", "U2", f"""
WITH p AS (
  SELECT d.doc_id, b.item_id, string_split(lower(b.text), ' ') AS a,
         string_split(lower(d.text), ' ') AS c
  FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id)
SELECT doc_id, item_id,
       CAST(len(list_distinct(list_filter(a, lambda x: NOT list_contains(c, x))))
          + len(list_distinct(list_filter(c, lambda x: NOT list_contains(a, x)))) AS INTEGER) AS sym_diff
FROM p""")
def q_symmetric_difference_size(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    b = read_table(spark, sf, "benchmark").select("item_id", F.col("text").alias("b_text"))
    j = d.withColumn("_item", F.col("doc_id") % standins.row_count(b)).join(b, F.col("_item") == b.item_id)
    return j.select("doc_id", "item_id", symmetric_difference_size(
        F.split(F.lower("b_text"), " "), F.split(F.lower("text"), " ")).alias("sym_diff"))
