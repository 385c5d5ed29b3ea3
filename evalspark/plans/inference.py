"""Inference stand-in queries: P1–P4, P15, J5, J6, G17, I1/I3, X17."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.text import extract_final_answer
from evalspark.operators import infer
from evalspark.plans import sqlfrag as S
from evalspark.plans import standins
from evalspark.plans.providers import RuleProvider
from evalspark.plans.context import ASSET_BANK_SQL, MANIFEST_SQL, _asset_bank, _manifest
from evalspark.plans.registry import register
from evalspark.session import read_table

IMG_LIMIT = 2
FAIL_EVERY = 97


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    return infer.build_image_list(standins.bank(spark, sf), distractor=True)


LISTS_SQL = lambda: f"SELECT *, contextual_urls || image_urls AS image_lists FROM ({standins.bank_sql()})"


@register("build_image_list", "P1", lambda: f"""
SELECT question_ref, array_to_string(image_lists, '|') AS image_lists, 0 AS q_answered FROM ({LISTS_SQL()})""")
def q_build_image_list(spark: SparkSession, sf: str) -> DataFrame:
    return _lists(spark, sf).select("question_ref", F.array_join("image_lists", "|").alias("image_lists"),
                                    F.col("q_answered").cast("int").alias("q_answered"))


@register("cap_images", "P2", lambda: f"""
SELECT question_ref, array_to_string(image_lists[1:{IMG_LIMIT + 1}], '|') AS capped FROM ({LISTS_SQL()})""")
def q_cap_images(spark: SparkSession, sf: str) -> DataFrame:
    return _lists(spark, sf).select("question_ref",
                                    F.array_join(infer.cap_images("image_lists", IMG_LIMIT), "|").alias("capped"))


@register("assemble_prompt", "P3", lambda: f"""
SELECT question_ref,
       'Answer in English only.' || chr(10) ||
       array_to_string(list_transform(image_lists[1:{IMG_LIMIT + 1}], lambda u: '<image:' || u || '>'), chr(10))
       || chr(10) || question_text || '. ' AS prompt_prefixed,
       'Answer in English only.' || chr(10) ||
       array_to_string(list_transform(range(1, len(image_lists) + 1), lambda i: printf('Image %d: <image>', i)),
                       chr(10)) || chr(10) || question_text AS prompt_numbered
FROM ({LISTS_SQL()})""")
def q_assemble_prompt(spark: SparkSession, sf: str) -> DataFrame:
    df = _lists(spark, sf)
    pre = infer.prompt_content(F.col("question_text"), F.col("image_lists"), "prefixed", IMG_LIMIT)
    num = infer.prompt_content(F.col("question_text"), F.col("image_lists"), "numbered")
    return df.select("question_ref", infer.render_content(pre).alias("prompt_prefixed"),
                     infer.render_content(num).alias("prompt_numbered"))


MARKED_SQL = """
SELECT conv_id, turn,
       CASE WHEN turn % 3 = 0 THEN text
            WHEN turn % 3 = 1 THEN text || ' Final answer: ' || role || chr(160)
            ELSE 'Final answer: draft ' || text || chr(10) || 'Final answer:' || chr(9) || CAST(conv_id AS VARCHAR) END
         AS response
FROM conversations"""


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "conversations")
    t = F.col("turn")
    resp = (F.when(t % 3 == 0, F.col("text"))
            .when(t % 3 == 1, F.concat(F.col("text"), F.lit(" Final answer: "), F.col("role"), F.lit(" ")))
            .otherwise(F.concat(F.lit("Final answer: draft "), F.col("text"), F.lit("\nFinal answer:\t"),
                                F.col("conv_id").cast("string"))))
    return c.select("conv_id", "turn", resp.alias("response"))


@register("extract_final_answer", "P4", lambda: f"""
SELECT conv_id, turn,
       {S.ustrip("string_split(response, 'Final answer:')[-1]")} AS answer
FROM ({MARKED_SQL})""")
def q_extract_final_answer(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).select("conv_id", "turn", extract_final_answer("response").alias("answer"))


@register("drop_failed_responses", "P15", """
SELECT conv_id, turn FROM conversations WHERE turn % 5 <> 0 AND turn % 7 <> 3""")
def q_drop_failed_responses(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "conversations")
    r = c.select("conv_id", "turn", F.when(F.col("turn") % 5 == 0, F.lit("None"))
                 .when(F.col("turn") % 7 == 3, F.lit(None).cast("string")).otherwise(F.col("text"))
                 .alias("resp"))
    return infer.drop_failed_responses(r, "resp").select("conv_id", "turn")


@register("pending", "J5", """
SELECT printf('q_%04d', doc_id) AS question_ref FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def q_pending(spark: SparkSession, sf: str) -> DataFrame:
    bank = read_table(spark, sf, "documents").select(F.format_string("q_%04d", "doc_id").alias("question_ref"))
    lab = read_table(spark, sf, "labels")
    answered = lab.select(F.format_string("q_%04d", "doc_id").alias("question_ref"),
                          F.when(F.col("quality") == 1, F.lit("ok")).otherwise(F.lit("None")).alias("resp"))
    return infer.pending(bank, answered, response="resp")


@register("resolve_assets", "J6", f"""
WITH b AS ({ASSET_BANK_SQL}), m AS ({MANIFEST_SQL}),
x AS (SELECT question_ref, unnest(image_urls) AS path, unnest(range(1, len(image_urls) + 1)) AS pos FROM b),
j AS (SELECT x.question_ref, x.pos, x.path, 'files/' || substr(md5(m.path), 1, 12) AS uri
      FROM x LEFT JOIN m ON x.path = m.path)
SELECT question_ref, array_to_string(list(coalesce(uri, '?') ORDER BY pos), '|') AS uris,
       coalesce(array_to_string(list(path ORDER BY path) FILTER (WHERE uri IS NULL), '|'), '') AS missing_paths
FROM j GROUP BY question_ref""")
def q_resolve_assets(spark: SparkSession, sf: str) -> DataFrame:
    m = _manifest(spark, sf).select("path", F.concat(F.lit("files/"), F.substring(F.md5("path"), 1, 12)).alias("uri"))
    r = infer.resolve_assets(_asset_bank(spark, sf), m, images="image_urls")
    return r.select("question_ref",
                    F.array_join(F.transform("uris", lambda u: F.coalesce(u, F.lit("?"))), "|").alias("uris"),
                    F.array_join("missing_paths", "|").alias("missing_paths"))


@register("length_buckets", "G17", lambda: f"""
SELECT question_ref, CAST(len(image_lists) AS INTEGER) AS n_images,
       CAST(floor((row_number() OVER (PARTITION BY len(image_lists) ORDER BY question_ref) - 1) / 8) AS BIGINT)
         AS batch_in_bucket
FROM ({LISTS_SQL()})""")
def q_length_buckets(spark: SparkSession, sf: str) -> DataFrame:
    b = infer.length_buckets(_lists(spark, sf), "image_lists", 8)
    return b.select("question_ref", "n_images", "batch_in_bucket")


@register("infer", "I1", lambda: f"""
SELECT question_ref,
       CASE WHEN length(question_text) % {FAIL_EVERY} = 0 THEN NULL
            ELSE CAST(length(question_text) % 50 AS VARCHAR) || ' miles' END AS rule_response,
       CAST(length(question_text) % {FAIL_EVERY} <> 0 AS INTEGER) AS q_answered,
       'rule' AS model, CAST(0.0 AS DOUBLE) AS temperature, 2048 AS max_new_tokens
FROM ({LISTS_SQL()})""")
def q_infer(spark: SparkSession, sf: str) -> DataFrame:
    provider = RuleProvider("rule", fail_every=FAIL_EVERY)
    out = infer.infer(_lists(spark, sf), provider, batch_size=1)
    return out.select("question_ref", "rule_response", F.col("q_answered").cast("int").alias("q_answered"),
                      "model", "temperature", "max_new_tokens")


@register("json_fields", "X17", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       CAST(to_json({'event_type': event_type, 'k': CAST(json_extract_string(props, '$.k') AS INTEGER)}) AS VARCHAR) AS packed
FROM events""")
def q_json_fields(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    parsed = e.withColumn("p", F.from_json("props", "k int"))
    return parsed.select("event_id", F.col("p.k").alias("k"),
                         F.to_json(F.struct("event_type", F.col("p.k").alias("k"))).alias("packed"))


@register("cap_images_strict", "P2/D7", lambda: f"""
SELECT question_ref, array_to_string(image_lists[1:{IMG_LIMIT}], '|') AS capped FROM ({LISTS_SQL()})""")
def q_cap_images_strict(spark: SparkSession, sf: str) -> DataFrame:
    """``compat=False``: exactly ``limit`` images."""
    return _lists(spark, sf).select(
        "question_ref", F.array_join(infer.cap_images("image_lists", IMG_LIMIT, compat=False), "|").alias("capped"))


@register("assemble_prompt_styles", "P3", lambda: f"""
SELECT question_ref,
       array_to_string(list_transform(image_lists[1:{IMG_LIMIT + 1}], lambda u: '<image:' || u || '>'), chr(10))
       || chr(10) || question_text AS prompt_text_last,
       question_text || chr(10) ||
       array_to_string(list_transform(image_lists, lambda u: '<image:' || u || '>'), chr(10)) AS prompt_text_first
FROM ({LISTS_SQL()})""")
def q_assemble_prompt_styles(spark: SparkSession, sf: str) -> DataFrame:
    df = _lists(spark, sf)
    last = infer.prompt_content(F.col("question_text"), F.col("image_lists"), "text_last", IMG_LIMIT)
    first = infer.prompt_content(F.col("question_text"), F.col("image_lists"), "text_first")
    return df.select("question_ref", infer.render_content(last).alias("prompt_text_last"),
                     infer.render_content(first).alias("prompt_text_first"))


class _PrefixProvider(infer.ProviderBase):
    """Uploads nothing: serves images from a mounted prefix (the local runners)."""

    image_prefix = "https://assets.example/maps"

    def respond(self, requests):  # pragma: no cover - not used for uploads
        return [None for _ in requests]


@register("upload_assets", "I3", lambda: f"""
SELECT path, 'https://assets.example/maps/' || path AS uri
FROM (SELECT DISTINCT unnest(image_urls || contextual_urls) AS path FROM ({standins.bank_sql()}))""")
def q_upload_assets(spark: SparkSession, sf: str) -> DataFrame:
    """Asset map of lifecycle step 2: every distinct image -> provider URI."""
    from evalspark.operators import context
    return infer.upload_assets(context.asset_set(standins.bank(spark, sf)), _PrefixProvider("prefix"))
