"""Report stand-in queries: G8–G13, G16, P12, J3, J4, T2, T3, W7, W8, X13."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators import ordinals, report
from evalspark.plans import standins
from evalspark.plans.registry import register
from evalspark.plans.sqlfrag import q
from evalspark.session import read_table


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows: one per labelled document; ``quality`` is the verdict."""
    d = read_table(spark, sf, "documents").select("doc_id", "source")
    lab = read_table(spark, sf, "labels")
    return (d.join(lab, "doc_id", "inner")
            .select("doc_id", F.col("source").alias("model"),
                    standins._rel_at(F.col("doc_id")).alias("spatial_relationship"),
                    F.when(F.col("toxic") == 0, F.lit("all")).otherwise(F.lit("partial")).alias("tier"),
                    F.col("quality").alias("correct")))


LABELLED_SQL = f"""
SELECT d.doc_id, d.source AS model,
       {standins.rel_list()}[CAST(d.doc_id % 6 AS INTEGER) + 1] AS spatial_relationship,
       CASE WHEN l.toxic = 0 THEN 'all' ELSE 'partial' END AS tier, l.quality AS correct
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


@register("accuracy_by_relationship", "G8", lambda: "SELECT model, " + ", ".join(
    f"round(100.0 * avg(CASE WHEN spatial_relationship = {q(r)} THEN coalesce(correct, 0) END), 6) AS {r}"
    for r in report.RELATIONSHIPS) + f" FROM ({LABELLED_SQL}) GROUP BY model")
def q_accuracy_by_relationship(spark: SparkSession, sf: str) -> DataFrame:
    return report.accuracy_by_relationship(_labelled(spark, sf))


@register("accuracy_by_tier", "G9", f"""
SELECT model, count(*) AS n,
       round(100.0 * sum(CASE WHEN tier = 'all' THEN coalesce(correct, 0) ELSE 0 END) / count(*), 6) AS acc_all,
       round(100.0 * sum(CASE WHEN tier = 'partial' THEN coalesce(correct, 0) ELSE 0 END) / count(*), 6)
         AS acc_partial,
       round(100.0 * sum(coalesce(correct, 0)) / count(*), 6) AS acc_total
FROM ({LABELLED_SQL}) GROUP BY model""")
def q_accuracy_by_tier(spark: SparkSession, sf: str) -> DataFrame:
    return report.accuracy_by_tier(_labelled(spark, sf), by=["model"])


@register("bank_profile", "G10", """
SELECT lang AS spatial_relationship, source AS map_count, count(*) AS n,
       CAST(grouping(lang, source) AS BIGINT) AS level
FROM documents GROUP BY ROLLUP (lang, source)""")
def q_bank_profile(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").select(
        F.col("lang").alias("spatial_relationship"), F.col("source").alias("map_count"))
    return report.bank_profile(d)


@register("category_share", "G11", """
SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share,
       printf('%s' || chr(10) || '(%d)', event_type, count(*)) AS label
FROM events GROUP BY event_type""")
def q_category_share(spark: SparkSession, sf: str) -> DataFrame:
    return report.category_share(read_table(spark, sf, "events"), "event_type")


@register("log_scale", "X13", """
SELECT event_type, round(ln(count(*)), 6) AS ln_n, round(log10(count(*)), 6) AS log10_n
FROM events GROUP BY event_type""")
def q_log_scale(spark: SparkSession, sf: str) -> DataFrame:
    agg = read_table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return agg.select("event_type", F.round(report.log_scale(F.col("n")), 6).alias("ln_n"),
                      F.round(report.log_scale(F.col("n"), 10), 6).alias("log10_n"))


@register("country_counts", "G12", """
SELECT n.n_name, c.n, count(*) OVER () AS n_countries, CAST(sum(c.n) OVER () AS BIGINT) AS n_total
FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) c
JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def q_country_counts(spark: SparkSession, sf: str) -> DataFrame:
    return report.country_counts(read_table(spark, sf, "customer"), read_table(spark, sf, "nation"),
                                 "c_nationkey", "n_nationkey", "n_name")


@register("quantile_bins", "G13", """
SELECT round(unnest(list_distinct(quantile_cont(value, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))), 6) AS edge
FROM events WHERE value > 0""")
def q_quantile_bins(spark: SparkSession, sf: str) -> DataFrame:
    bins = report.quantile_bins(read_table(spark, sf, "events"), "value")
    return bins.select(F.round("edge", 6).alias("edge"))


@register("size_curve", "G16", f"""
SELECT p.p_size AS size, round(100.0 * avg(coalesce(s.correct, 0)), 6) AS accuracy, count(*) AS n
FROM (SELECT 'p' || CAST(doc_id % (SELECT count(*) FROM part) + 1 AS VARCHAR) AS model, correct FROM ({LABELLED_SQL})) s
JOIN (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS model, p_size FROM part) p ON s.model = p.model
GROUP BY p.p_size""")
def q_size_curve(spark: SparkSession, sf: str) -> DataFrame:
    n = standins.row_count(read_table(spark, sf, "part").select("p_partkey"))
    scored = _labelled(spark, sf).select(
        F.concat(F.lit("p"), (F.col("doc_id") % n + 1).cast("string")).alias("model"), "correct")
    models = read_table(spark, sf, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("model"), F.col("p_size").alias("size"))
    return report.size_curve(scored, models)


# The one rename the reference applies before its country join.
NAME_FIX = {"United States": "United States of America"}
_STANDIN_FIX = {"NATION_1": "United States", **NAME_FIX}


@register("harmonise_names", "P12", """
SELECT n_nationkey, CASE n_name WHEN 'NATION_1' THEN 'United States'
                                WHEN 'United States' THEN 'United States of America'
                                ELSE n_name END AS n_name
FROM nation""")
def q_harmonise_names(spark: SparkSession, sf: str) -> DataFrame:
    n = read_table(spark, sf, "nation").select("n_nationkey", "n_name")
    return report.harmonise_names(n, "n_name", _STANDIN_FIX)


@register("coverage", "J3", """
SELECT n.n_nationkey, n.n_name, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM nation n LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) c
  ON n.n_nationkey = c.c_nationkey""")
def q_coverage(spark: SparkSession, sf: str) -> DataFrame:
    n = read_table(spark, sf, "nation").select("n_nationkey", "n_name")
    return report.coverage(n, read_table(spark, sf, "customer"), "n_nationkey", "c_nationkey")


# Invented fallback coordinates for keys missing from the (filtered) dimension.
_FALLBACK = [(0, 12.25, 41.5), (5, -71.75, -13.125)]


@register("unmatched", "J4", f"""
SELECT k.c_nationkey, f.lon, f.lat
FROM (SELECT DISTINCT c_nationkey FROM customer) k
LEFT JOIN (VALUES {", ".join(f"({a}, CAST({b} AS DOUBLE), CAST({c} AS DOUBLE))" for a, b, c in _FALLBACK)}) f(c_nationkey, lon, lat)
  ON k.c_nationkey = f.c_nationkey
WHERE k.c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 0)""")
def q_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    nation = read_table(spark, sf, "nation").filter(F.col("n_regionkey") != 0)  # P14 drop_excluded
    fb = spark.createDataFrame(_FALLBACK, "c_nationkey int, lon double, lat double")
    return report.unmatched(read_table(spark, sf, "customer"), nation, "c_nationkey", "n_nationkey", fb)


@register("longest_first", "T2", """
SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS ordinal FROM documents""")
def q_longest_first(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").select("doc_id", "n_chars")
    return ordinals.global_ordinal(d, [F.col("n_chars").desc(), F.col("doc_id").asc()])


@register("top_n", "T3", """
SELECT n.n_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_name ORDER BY n DESC, n.n_name LIMIT 10""")
def q_top_n(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer")
    n = read_table(spark, sf, "nation")
    counts = (c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name")
              .agg(F.count(F.lit(1)).alias("n")))
    return report.top_n(counts, "n", "n_name", 10)


@register("arc_layout", "W7", """
WITH prof AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source),
par AS (SELECT lang, sum(n) AS p_n FROM prof GROUP BY lang),
pa AS (SELECT lang, p_n,
              90.0 - 360.0 * (sum(p_n) OVER (ORDER BY lang ROWS UNBOUNDED PRECEDING) - p_n) / sum(p_n) OVER ()
                AS p_start,
              90.0 - 360.0 * sum(p_n) OVER (ORDER BY lang ROWS UNBOUNDED PRECEDING) / sum(p_n) OVER () AS p_end
       FROM par)
SELECT prof.lang, prof.source, prof.n, round(p_start, 6) AS p_start, round(p_end, 6) AS p_end,
       round(p_start - (p_start - p_end) *
             (sum(prof.n) OVER (PARTITION BY prof.lang ORDER BY prof.source ROWS UNBOUNDED PRECEDING) - prof.n)
             / p_n, 6) AS c_start,
       round(p_start - (p_start - p_end) *
             sum(prof.n) OVER (PARTITION BY prof.lang ORDER BY prof.source ROWS UNBOUNDED PRECEDING) / p_n, 6)
         AS c_end
FROM prof JOIN pa ON prof.lang = pa.lang""")
def q_arc_layout(spark: SparkSession, sf: str) -> DataFrame:
    prof = read_table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return report.arc_layout(prof, "lang", "source")


@register("local_maxima", "W8", """
WITH c AS (SELECT CAST(ts AS DATE) AS day, round(avg(value), 6) AS y FROM events GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, y,
       CAST(y >= coalesce(lag(y) OVER (ORDER BY day), y) AND y >= coalesce(lead(y) OVER (ORDER BY day), y)
            AS INTEGER) AS is_local_max
FROM c""")
def q_local_maxima(spark: SparkSession, sf: str) -> DataFrame:
    curve = (read_table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"))
             .agg(F.round(F.avg("value"), 6).alias("y")))
    out = report.local_maxima(curve, "day", "y")
    return out.select(F.col("day").cast("string").alias("day"), "y",
                      F.col("is_local_max").cast("int").alias("is_local_max"))


# Fixed stand-in set for the membership flag (nations treated as "primary").
_MEMBERS = ["NATION_1", "NATION_4", "NATION_9", "NATION_16"]


@register("flag_membership", "P13", f"""
SELECT n_nationkey, n_name IN ({", ".join(q(m) for m in _MEMBERS)}) AS is_member FROM nation""")
def q_flag_membership(spark: SparkSession, sf: str) -> DataFrame:
    from evalspark.operators import basic
    n = read_table(spark, sf, "nation").select("n_nationkey", "n_name")
    return basic.flag_membership(n, "n_name", set(_MEMBERS)).select("n_nationkey", "is_member")


@register("drop_excluded", "P14", """
SELECT n_nationkey, n_name FROM nation WHERE n_name <> 'NATION_0' AND n_regionkey > 0""")
def q_drop_excluded(spark: SparkSession, sf: str) -> DataFrame:
    from evalspark.operators import basic
    n = read_table(spark, sf, "nation")
    return basic.drop_excluded(n, "n_name", "NATION_0", "n_regionkey").select("n_nationkey", "n_name")
