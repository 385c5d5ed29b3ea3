"""Context stand-in queries: J7, J8, J10, W9, T5, G14, X8 and the whole step.

Stand-ins: the asset manifest comes from ``pages.url`` (language segment =
folder, the number after it = the image number, a suffix from the page id);
one question per page with its own image as target (every 4th page adds the
next page's image as a second target).  Embeddings are image vectors with
``label`` as the folder; question ``q`` targets vectors ``2q`` and ``2q+1``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.assets import parse_asset
from evalspark.operators import context
from evalspark.plans import standins
from evalspark.plans.registry import register
from evalspark.session import read_table
from evalspark.sources.bank import manifest_from_paths

K = 10


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "pages")
    pid = F.col("page_id")
    suffix = (F.when(pid % 3 == 0, F.lit(""))
              .when(pid % 3 == 1, F.concat(F.lit("_"), (pid % 4).cast("string")))
              .otherwise(F.concat(F.lit("_m"), (pid % 7).cast("string"))))
    path = F.concat(F.regexp_extract("url", r"/([a-z]{2})/", 1), F.lit("/image"),
                    F.regexp_extract("url", r"/[a-z]{2}/(\d+)", 1), suffix, F.lit(".png"))
    return manifest_from_paths(p.select(path.alias("path")), "path").distinct()


MANIFEST_SQL = """
SELECT DISTINCT dir, name, dir || '/' || name AS path FROM (
  SELECT regexp_extract(url, '/([a-z]{2})/', 1) AS dir,
         'image' || regexp_extract(url, '/[a-z]{2}/(\\d+)', 1) ||
         CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '_' || CAST(page_id % 4 AS VARCHAR)
              ELSE '_m' || CAST(page_id % 7 AS VARCHAR) END || '.png' AS name
  FROM pages)"""


def _page_path(pid):
    suffix = (F.when(pid % 3 == 0, F.lit(""))
              .when(pid % 3 == 1, F.concat(F.lit("_"), (pid % 4).cast("string")))
              .otherwise(F.concat(F.lit("_m"), (pid % 7).cast("string"))))
    return F.concat(F.regexp_extract("url", r"/([a-z]{2})/", 1), F.lit("/image"),
                    F.regexp_extract("url", r"/[a-z]{2}/(\d+)", 1), suffix, F.lit(".png"))


def _name_targets(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "pages").select("page_id", "url")
    own = p.select(F.format_string("q_%04d", "page_id").alias("question_ref"), F.lit(1).alias("target_pos"),
                   _page_path(F.col("page_id")).alias("path"))
    nxt = (p.filter(F.col("page_id") % 4 == 0).select(F.col("page_id").alias("qpid"))
           .join(p, F.col("page_id") == F.col("qpid") + 1, "inner")
           .select(F.format_string("q_%04d", "qpid").alias("question_ref"), F.lit(2).alias("target_pos"),
                   _page_path(F.col("page_id")).alias("path")))
    return own.unionByName(nxt)


PATH_SQL = """(regexp_extract(url, '/([a-z]{2})/', 1) || '/image' || regexp_extract(url, '/[a-z]{2}/(\\d+)', 1) ||
         CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '_' || CAST(page_id % 4 AS VARCHAR)
              ELSE '_m' || CAST(page_id % 7 AS VARCHAR) END || '.png')"""

TARGETS_SQL = f"""
SELECT printf('q_%04d', page_id) AS question_ref, 1 AS target_pos, {PATH_SQL} AS path FROM pages
UNION ALL
SELECT printf('q_%04d', a.page_id), 2, {PATH_SQL.replace('url', 'b.url').replace('page_id', 'b.page_id')}
FROM pages a JOIN pages b ON b.page_id = a.page_id + 1 WHERE a.page_id % 4 = 0"""


def parse_sql(name: str) -> dict[str, str]:
    part = f"regexp_extract({name}, '_([\\p{{L}}\\p{{N}}_]+)\\.', 1)"
    letters = f"regexp_extract({part}, '^([a-zA-Z]*)(\\d*)', 1)"
    return {
        "main": f"coalesce(TRY_CAST(nullif(regexp_extract({name}, 'image(\\d+)', 1), '') AS BIGINT), -1)",
        "sub": f"coalesce(TRY_CAST(nullif(regexp_extract({part}, '^([a-zA-Z]*)(\\d*)', 2), '') AS BIGINT), -1)",
        "letters": letters,
        "ls": f"coalesce(list_sum(list_transform(list_filter(string_split({letters}, ''), "
              f"lambda c_: c_ <> ''), lambda c_: ascii(c_))), 0)",
    }


def _named_sql() -> str:
    t, m = parse_sql("t.name"), parse_sql("m.name")
    return f"""
m AS ({MANIFEST_SQL}),
t0 AS ({TARGETS_SQL}),
t AS (SELECT question_ref, target_pos, path,
             CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/([^/]*)$', 1) ELSE '' END AS dir,
             CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/([^/]*)$', 2) ELSE path END AS name
      FROM t0),
qd AS (SELECT question_ref, dir FROM t WHERE target_pos = 1),
c AS (SELECT t.question_ref, m.path,
             round(min(abs({t['main']} - {m['main']}) + 0.01 * (abs({t['ls']} - {m['ls']}) + abs({t['sub']} - {m['sub']}))), 6)
               AS score
      FROM t JOIN qd ON t.question_ref = qd.question_ref JOIN m ON m.dir = qd.dir
      GROUP BY t.question_ref, m.path),
r AS (SELECT question_ref, CAST(row_number() OVER (PARTITION BY question_ref ORDER BY score, path) AS INTEGER) AS rank,
             path, CAST(score AS DOUBLE) AS score
      FROM c)"""


@register("nearest_named", "J8", lambda: f"WITH {_named_sql()} SELECT * FROM r WHERE rank <= {K}")
def q_nearest_named(spark: SparkSession, sf: str) -> DataFrame:
    r = context.nearest_named(_name_targets(spark, sf), _manifest(spark, sf), k=K)
    return r.select("question_ref", "rank", "path", F.round("score", 6).alias("score"))


@register("parse_asset", "X8", lambda: f"""
SELECT path, {parse_sql('name')['main']} AS main, {parse_sql('name')['letters']} AS letters,
       {parse_sql('name')['sub']} AS sub, CAST({parse_sql('name')['ls']} AS BIGINT) AS letter_sum
FROM ({MANIFEST_SQL})""")
def q_parse_asset(spark: SparkSession, sf: str) -> DataFrame:
    p = parse_asset(F.col("name"))
    return _manifest(spark, sf).select("path", p["main"].alias("main"), p["letters"].alias("letters"),
                                       p["sub"].alias("sub"), p["letter_sum"].alias("letter_sum"))


@register("natural_asset_order", "T5", lambda: f"""
SELECT dir, name, path, row_number() OVER (PARTITION BY dir ORDER BY {parse_sql('name')['main']},
       {parse_sql('name')['letters']}, {parse_sql('name')['sub']}, name) AS ordinal
FROM ({MANIFEST_SQL})""")
def q_natural_asset_order(spark: SparkSession, sf: str) -> DataFrame:
    return context.natural_asset_order(_manifest(spark, sf)).select("dir", "name", "path", "ordinal")


def _vec_targets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = read_table(spark, sf, "embeddings")
    vectors = e.select("vec_id", "embedding", F.col("label").cast("string").alias("dir"))
    targets = e.select(F.format_string("q_%04d", F.expr("vec_id div 2")).alias("question_ref"),
                       (F.col("vec_id") % 2 + 1).cast("int").alias("target_pos"), "vec_id")
    return targets, vectors


KNN_SQL = """
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
t AS (SELECT printf('q_%04d', vec_id // 2) AS question_ref, CAST(vec_id % 2 + 1 AS INTEGER) AS target_pos,
             vec_id FROM embeddings),
qd AS (SELECT t.question_ref, e.label FROM t JOIN e ON t.vec_id = e.vec_id WHERE t.target_pos = 1),
s AS (SELECT t.question_ref, t.target_pos, c.vec_id, round(list_inner_product(q.v, c.v), 9) AS score
      FROM t JOIN e q ON t.vec_id = q.vec_id JOIN qd ON t.question_ref = qd.question_ref
      JOIN e c ON c.label = qd.label),
r AS (SELECT question_ref, target_pos, vec_id, score,
             CAST(row_number() OVER (PARTITION BY question_ref, target_pos ORDER BY score DESC, vec_id) AS INTEGER) AS rank
      FROM s)"""


@register("knn_context", "J7", f"""
WITH {KNN_SQL}
SELECT question_ref, target_pos, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= {K}""")
def q_knn_context(spark: SparkSession, sf: str) -> DataFrame:
    r = context.knn_context(*_vec_targets(spark, sf), k=K)
    # The oracle rounds the same way: to nine places, then to six.
    return r.select("question_ref", "target_pos", "rank", "vec_id", F.round(F.round("score", 9), 6).alias("score"))


@register("interleave_ranked", "W9", f"""
WITH {KNN_SQL},
top AS (SELECT * FROM r WHERE rank <= {K}),
b AS (SELECT question_ref, vec_id, min((rank, target_pos)) AS best FROM top GROUP BY question_ref, vec_id),
o AS (SELECT question_ref, vec_id, CAST(row_number() OVER (PARTITION BY question_ref ORDER BY best) AS INTEGER) AS rank FROM b)
SELECT question_ref, rank, vec_id FROM o WHERE rank <= {K}""")
def q_interleave_ranked(spark: SparkSession, sf: str) -> DataFrame:
    r = context.knn_context(*_vec_targets(spark, sf), k=K)
    return context.interleave_ranked(r, k=K)


@register("append_contextual_by_vector", "J7/W9", f"""
WITH {KNN_SQL},
top AS (SELECT * FROM r WHERE rank <= {K}),
b AS (SELECT question_ref, vec_id, min((rank, target_pos)) AS best FROM top GROUP BY question_ref, vec_id),
o AS (SELECT question_ref, vec_id, row_number() OVER (PARTITION BY question_ref ORDER BY best) AS pos FROM b)
SELECT q.question_ref, CAST(q.miss AS INTEGER) AS missing_asset,
       CASE WHEN q.miss THEN 'CANNOT FIND IMAGE'
            ELSE (SELECT string_agg('v/' || vec_id, '|' ORDER BY pos) FROM o
                  WHERE o.question_ref = q.question_ref AND pos <= {K}) END AS contextual_urls
FROM (SELECT question_ref, bool_or(vec_id % 18 = 0) AS miss FROM t GROUP BY question_ref) q""")
def q_append_contextual_by_vector(spark: SparkSession, sf: str) -> DataFrame:
    """Every ninth question also names a target that has no vector."""
    targets, vectors = _vec_targets(spark, sf)
    path = F.concat(F.lit("v/"), F.col("vec_id").cast("string"))
    lost = F.when(F.max((F.col("vec_id") % 18 == 0).cast("int")) == 1, F.array(F.lit("v/none")))
    bank = targets.groupBy("question_ref").agg(F.concat(
        F.transform(F.array_sort(F.collect_list(F.struct("target_pos", path.alias("path")))), lambda s: s["path"]),
        F.coalesce(lost, F.array().cast("array<string>"))).alias("image_urls"))
    out = context.append_contextual_by_vector(bank, vectors.withColumn("path", path), k=K)
    return out.select("question_ref", F.col("missing_asset").cast("int").alias("missing_asset"),
                      F.array_join("contextual_urls", "|").alias("contextual_urls"))


def _asset_bank(spark: SparkSession, sf: str) -> DataFrame:
    t = _name_targets(spark, sf)
    p = read_table(spark, sf, "pages").select(F.format_string("q_%04d", "page_id").alias("question_ref"),
                                              "page_id")
    missing = p.filter(F.col("page_id") % 9 == 0).select(
        "question_ref", F.lit(3).alias("target_pos"), F.lit("zz/missing.png").alias("path"))
    allt = t.unionByName(missing)
    return allt.groupBy("question_ref").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("target_pos", "path"))), lambda s: s["path"])
        .alias("image_urls"))


ASSET_BANK_SQL = f"""
SELECT question_ref, list(path ORDER BY target_pos) AS image_urls FROM (
  {TARGETS_SQL}
  UNION ALL SELECT printf('q_%04d', page_id), 3, 'zz/missing.png' FROM pages WHERE page_id % 9 = 0)
GROUP BY question_ref"""


@register("check_assets", "J10", f"""
WITH b AS ({ASSET_BANK_SQL}), m AS ({MANIFEST_SQL}),
x AS (SELECT question_ref, unnest(image_urls) AS path FROM b),
miss AS (SELECT question_ref, count(*) AS n FROM x WHERE path NOT IN (SELECT path FROM m) GROUP BY question_ref)
SELECT b.question_ref, CAST(coalesce(miss.n, 0) AS BIGINT) AS n_missing,
       CAST(coalesce(miss.n, 0) > 0 AS INTEGER) AS missing_asset
FROM b LEFT JOIN miss ON b.question_ref = miss.question_ref""")
def q_check_assets(spark: SparkSession, sf: str) -> DataFrame:
    c = context.check_assets(_asset_bank(spark, sf), _manifest(spark, sf))
    return c.select("question_ref", "n_missing", F.col("missing_asset").cast("int").alias("missing_asset"))


@register("append_contextual", "J11", lambda: f"""
WITH b AS ({ASSET_BANK_SQL}), mm AS ({MANIFEST_SQL}),
x AS (SELECT question_ref, unnest(image_urls) AS path FROM b),
miss AS (SELECT DISTINCT question_ref FROM x WHERE path NOT IN (SELECT path FROM mm)),
{_named_sql()}
SELECT b.question_ref, CAST(miss.question_ref IS NOT NULL AS INTEGER) AS missing_asset,
       CASE WHEN miss.question_ref IS NOT NULL THEN 'CANNOT FIND IMAGE'
            ELSE (SELECT coalesce(string_agg(path, '|' ORDER BY rank), '') FROM r
                  WHERE r.question_ref = b.question_ref AND rank <= {K}) END AS contextual_urls
FROM b LEFT JOIN miss ON b.question_ref = miss.question_ref""")
def q_append_contextual(spark: SparkSession, sf: str) -> DataFrame:
    out = context.append_contextual(_asset_bank(spark, sf), _manifest(spark, sf), k=K)
    return out.select("question_ref", F.col("missing_asset").cast("int").alias("missing_asset"),
                      F.array_join("contextual_urls", "|").alias("contextual_urls"))


@register("asset_set", "G14", lambda: f"""
SELECT DISTINCT unnest(image_urls || contextual_urls) AS path FROM ({standins.bank_sql()})""")
def q_asset_set(spark: SparkSession, sf: str) -> DataFrame:
    return context.asset_set(standins.bank(spark, sf))


@register("nearest_named_exclusive", "J8/D1", lambda: f"""
WITH {_named_sql()},
rx AS (SELECT c.question_ref, c.path, c.score,
              CAST(row_number() OVER (PARTITION BY c.question_ref ORDER BY c.score, c.path) AS INTEGER) AS rank
       FROM c WHERE NOT EXISTS (SELECT 1 FROM t0 WHERE t0.question_ref = c.question_ref AND t0.path = c.path))
SELECT question_ref, rank, path, CAST(score AS DOUBLE) AS score FROM rx WHERE rank <= {K}""")
def q_nearest_named_exclusive(spark: SparkSession, sf: str) -> DataFrame:
    """``exclude_targets=True``: a question's own images never rank (D1 flag)."""
    r = context.nearest_named(_name_targets(spark, sf), _manifest(spark, sf), k=K, exclude_targets=True)
    return r.select("question_ref", "rank", "path", F.round("score", 6).alias("score"))
