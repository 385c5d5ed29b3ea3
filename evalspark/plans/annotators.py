"""Annotator stand-in queries: W1–W6, P8, G15, X11, X12, P10, P11, G1–G6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.assets import add_ok, page_ref
from evalspark.operators import annotations, assign, ordinals, scoring, stats
from evalspark.plans import sqlfrag as S
from evalspark.plans import standins
from evalspark.plans.registry import register
from evalspark.session import read_table

N_BOOT = 1000


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders").select("o_orderkey")
    return ordinals.number_questions(o, ["o_orderkey"])


def _roster(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer")
    return c.select(F.format_string("%05d", "c_custkey").alias("user_id"),
                    F.col("c_name").alias("user_name"))


Q_SQL = """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS ordinal,
       printf('q_%04d', row_number() OVER (ORDER BY o_orderkey)) AS question_ref FROM orders"""

ASSIGN_SQL = f"""
WITH q AS ({Q_SQL}),
u AS (SELECT printf('%05d', c_custkey) AS user_id,
             row_number() OVER (ORDER BY printf('%05d', c_custkey)) - 1 AS idx FROM customer),
n AS (SELECT count(*) AS n FROM customer),
s AS (SELECT q.question_ref, q.ordinal, t.slot, ((q.ordinal - 1) * 2 + t.slot) % n.n AS idx
      FROM q, (VALUES (0), (1)) t(slot), n)
SELECT s.question_ref, s.ordinal, s.slot, u.user_id, false AS user_repeated
FROM s JOIN u ON s.idx = u.idx"""

PAGES_SQL = f"""
WITH a AS ({ASSIGN_SQL})
SELECT user_id, question_ref, ordinal, slot,
       row_number() OVER (PARTITION BY user_id ORDER BY ordinal, slot) AS page_idx,
       count(*) OVER (PARTITION BY user_id) AS n_pages,
       user_id || '_' || question_ref || '.html' AS page,
       printf('Q%d/%d', row_number() OVER (PARTITION BY user_id ORDER BY ordinal, slot),
              count(*) OVER (PARTITION BY user_id)) AS progress
FROM a"""


@register("number_questions", "W1", f"SELECT * FROM ({Q_SQL})")
def q_number_questions(spark: SparkSession, sf: str) -> DataFrame:
    return _questions(spark, sf).select("o_orderkey", "ordinal", "question_ref")


def _assignments(spark: SparkSession, sf: str) -> DataFrame:
    return assign.assign_round_robin(_questions(spark, sf), _roster(spark, sf), r=2)


@register("assign_round_robin", "W2", ASSIGN_SQL)
def q_assign_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return _assignments(spark, sf)


@register("page_ordinals", "W3", PAGES_SQL)
def q_page_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    return assign.page_ordinals(_assignments(spark, sf))


@register("next_page", "W4", f"""
SELECT user_id, page_idx, page,
       lead(page, 1, 'thankyou.html') OVER (PARTITION BY user_id ORDER BY page_idx) AS next_page
FROM ({PAGES_SQL})""")
def q_next_page(spark: SparkSession, sf: str) -> DataFrame:
    pages = assign.page_ordinals(_assignments(spark, sf))
    return assign.next_page(pages).select("user_id", "page_idx", "page", "next_page")


def _conv_pages(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = read_table(spark, sf, "conversations")
    a = c.select(F.format_string("u%04d", "conv_id").alias("user_id"),
                 F.format_string("q_%04d", "turn").alias("question_ref"),
                 F.col("turn").alias("ordinal"), F.lit(0).alias("slot"), "role")
    pages = assign.page_ordinals(a.drop("role"))
    answered = a.filter(F.col("role") == "assistant").select("user_id", "question_ref")
    users = (read_table(spark, sf, "customer").select(F.format_string("u%04d", "c_custkey").alias("user_id"))
             .unionByName(a.select("user_id")).distinct())
    return pages, answered, users


@register("resume_pointer", "W5", """
WITH p AS (
  SELECT printf('u%04d', conv_id) AS user_id, printf('q_%04d', turn) AS question_ref, role,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page_idx,
         count(*) OVER (PARTITION BY conv_id) AS n_pages,
         printf('u%04d', conv_id) || '_' || printf('q_%04d', turn) || '.html' AS page
  FROM conversations),
t AS (SELECT user_id, CASE WHEN max(CASE WHEN role = 'assistant' THEN page_idx END) IS NULL THEN 1
                          ELSE least(max(CASE WHEN role = 'assistant' THEN page_idx END) + 1, max(n_pages)) END
             AS page_idx FROM p GROUP BY user_id),
users AS (SELECT printf('u%04d', c_custkey) AS user_id FROM customer
          UNION SELECT printf('u%04d', conv_id) FROM conversations)
SELECT u.user_id, t.page_idx, coalesce(p.page, 'thankyou.html') AS resume_page
FROM users u LEFT JOIN t ON u.user_id = t.user_id
LEFT JOIN p ON t.user_id = p.user_id AND t.page_idx = p.page_idx""")
def q_resume_pointer(spark: SparkSession, sf: str) -> DataFrame:
    pages, answered, users = _conv_pages(spark, sf)
    return assign.resume_pointer(pages, answered, users)


@register("shard_rows", "P8", """
SELECT o_orderkey, o_totalprice FROM (
  SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
WHERE i >= 1000 AND i < 9000""")
def q_shard_rows(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ordinals.shard_rows(o, ["o_orderkey"], start=1000, last=9000)


@register("batch_id", "W6", """
SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 20) AS BIGINT) AS batch_id
FROM orders""")
def q_batch_id(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders").select("o_orderkey")
    return ordinals.batch_id(o, ["o_orderkey"], 20)


@register("workload", "G15", """
SELECT printf('%05d', c.c_custkey) AS user_id, CAST(coalesce(o.n, 0) AS BIGINT) AS n_pages
FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o
  ON c.c_custkey = o.o_custkey""")
def q_workload(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders").select(F.format_string("%05d", "o_custkey").alias("user_id"))
    return assign.workload(o, _roster(spark, sf))


@register("page_ref", "X11", """
SELECT o_orderkey,
       CASE WHEN contains(f, '_') THEN regexp_extract(f, '^[^_]*_(.*?)(\\.html)?$', 1) ELSE f END AS question_ref
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN printf('q%04d.html', o_orderkey)
                              ELSE printf('%05d_q_%04d.html', o_custkey, o_orderkey) END AS f
      FROM orders)""")
def q_page_ref(spark: SparkSession, sf: str) -> DataFrame:
    """Page names parsed back to references; every 10th name has no ``_``."""
    o = read_table(spark, sf, "orders")
    f = (F.when(F.col("o_orderkey") % 10 == 0, F.format_string("q%04d.html", "o_orderkey"))
         .otherwise(F.format_string("%05d_q_%04d.html", "o_custkey", "o_orderkey")))
    return o.select("o_orderkey", page_ref(f).alias("question_ref"))


@register("add_ok", "X12", """
SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'ok=1' AS redirect FROM pages""")
def q_add_ok(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages").select("page_id", add_ok("url").alias("redirect"))


def _reasons_sql() -> str:
    a = annotations
    inlist = lambda xs: "(" + ", ".join(S.q(x) for x in xs) + ")"
    checks = [
        f"CASE WHEN coalesce({S.ustrip(chr(34) + 'user' + chr(34))} = '', true) THEN 'user_missing' END",
        "CASE WHEN coalesce(question_ref = '', true) THEN 'question_ref_missing' END",
        f"CASE WHEN NOT coalesce(validity IN {inlist(a.VALIDITY)}, false) THEN 'validity' END",
        f"CASE WHEN NOT coalesce(map_count IN {inlist(a.MAP_COUNT)}, false) THEN 'map_count' END",
        f"CASE WHEN NOT coalesce(spatial_relationship IN {inlist(a.SPATIAL)}, false) "
        "THEN 'spatial_relationship' END",
        f"CASE WHEN necessary IS NOT NULL AND necessary <> '' AND necessary NOT IN {inlist(a.NECESSARY)} "
        "THEN 'necessary' END",
        f"CASE WHEN validity = {S.q(a.NOINFO)} AND coalesce({S.ustrip('noinfo_reason')}, '') = '' "
        "THEN 'noinfo_reason' END",
    ]
    for c, n in a.MAX_LEN.items():
        x = S.ustrip('"user"') if c == "user" else S.ustrip(c) if c == "question_ref" else c
        checks.append(f"CASE WHEN length({x}) > {n} THEN '{c}_too_long' END")
    return "list_filter([" + ", ".join(checks) + "], lambda r_: r_ IS NOT NULL)"


@register("validate_annotation", "P10", lambda: f"""
SELECT event_id, array_to_string(r, ',') AS reasons, CAST(len(r) = 0 AS INTEGER) AS accepted
FROM (SELECT event_id, {_reasons_sql()} AS r FROM ({standins.submissions_sql()}))""")
def q_validate_annotation(spark: SparkSession, sf: str) -> DataFrame:
    v = annotations.validate_annotation(standins.submissions(spark, sf))
    return v.select("event_id", F.array_join("reasons", ",").alias("reasons"),
                    F.col("accepted").cast("int").alias("accepted"))


@register("normalise_necessary", "P11", lambda: f"""
SELECT event_id, nullif(lower(trim(necessary)), '') AS necessary FROM ({standins.submissions_sql()})""")
def q_normalise_necessary(spark: SparkSession, sf: str) -> DataFrame:
    s = standins.submissions(spark, sf)
    return s.select("event_id", annotations.normalise_necessary("necessary").alias("necessary"))


@register("canonical_answers", "G1", lambda: f"""
SELECT question_ref, map_count, spatial_relationship, answer_type,
       array_to_string({S.split_answers('question_text')}, '|') AS expected_answer,
       CAST(len({S.split_answers('question_text')}) AS INTEGER) AS n_answers
FROM ({standins.bank_sql()})""")
def q_canonical_answers(spark: SparkSession, sf: str) -> DataFrame:
    b = standins.bank(spark, sf).drop("expected_answer").withColumnRenamed("question_text", "expected_answer")
    c = stats.canonical_answers(b)
    return c.select("question_ref", "map_count", "spatial_relationship", "answer_type",
                    F.array_join("expected_answer", "|").alias("expected_answer"),
                    F.size("expected_answer").alias("n_answers"))


def _spread_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    a = standins.answers(spark, sf).filter(F.col("answer_type") == "distance")
    li = read_table(spark, sf, "lineitem")
    ann = li.select(
        standins._numbered("d", F.col("l_orderkey")).alias("question_ref"),
        F.when(F.col("l_suppkey") % 13 == 0, F.lit("None"))
        .when(F.col("l_suppkey") % 17 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("about "), F.col("l_quantity").cast("string"), F.lit(" miles")))
        .alias("answer"))
    return a, ann


def _spread_values_sql() -> str:
    return f"""
a AS ({standins.answers_sql()}),
v AS (
  SELECT question_ref, {S.first_number('expected_answer')} AS x, true AS is_expected
  FROM a WHERE answer_type = 'distance' AND {S.first_number('expected_answer')} IS NOT NULL
  UNION ALL
  SELECT question_ref, x, false FROM (
    SELECT printf('d%07d', l_orderkey) AS question_ref,
           {S.first_number("'about ' || CAST(l_quantity AS VARCHAR) || ' miles'")} AS x
    FROM lineitem WHERE l_suppkey % 13 <> 0 AND l_suppkey % 17 <> 0)
  WHERE x IS NOT NULL AND question_ref IN (SELECT question_ref FROM a WHERE answer_type = 'distance'))"""


@register("annotator_spread", "G2", lambda: f"""
WITH {_spread_values_sql()}
SELECT question_ref, count(*) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median,
       round(stddev_samp(x), 6) AS std, max(CASE WHEN is_expected THEN x END) AS expected_value
FROM v GROUP BY question_ref""")
def q_annotator_spread(spark: SparkSession, sf: str) -> DataFrame:
    return stats.annotator_spread(*_spread_inputs(spark, sf))


@register("annotator_spread_rows", "G2", lambda: f"""
WITH {_spread_values_sql()}
SELECT question_ref, x, is_expected, count(*) OVER w AS n, round(avg(x) OVER w, 6) AS mean,
       round(median(x) OVER w, 6) AS median, round(stddev_samp(x) OVER w, 6) AS std,
       max(CASE WHEN is_expected THEN x END) OVER w AS expected_value
FROM v WINDOW w AS (PARTITION BY question_ref)""")
def q_annotator_spread_rows(spark: SparkSession, sf: str) -> DataFrame:
    return stats.spread_rows(*_spread_inputs(spark, sf))


@register("flag_spread_outliers", "G3", lambda: f"""
WITH {_spread_values_sql()},
st AS (SELECT question_ref, stddev_samp(x) AS sd, max(CASE WHEN is_expected THEN x END) AS e
       FROM v GROUP BY question_ref)
SELECT v.question_ref, CAST(coalesce(bool_or(abs(v.x - st.e) > 1.0 * st.sd), false) AS INTEGER) AS has_outlier
FROM v JOIN st ON v.question_ref = st.question_ref GROUP BY v.question_ref""")
def q_flag_spread_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return stats.flag_spread_outliers(*_spread_inputs(spark, sf))


@register("annotation_agreement", "G6", lambda: f"""
WITH a AS ({standins.answers_sql()}), r AS ({standins.responses_sql()}),
s AS (SELECT r.question_ref,
             {S.distance_correct(S.split_answers('r.response'), S.split_answers('a.expected_answer'))} AS correct
      FROM r JOIN a ON r.question_ref = a.question_ref WHERE a.answer_type = 'distance')
SELECT question_ref, count(*) AS n, CAST(sum(correct) AS BIGINT) AS n_agree,
       CASE WHEN sum(correct) = count(*) THEN 'all' WHEN sum(correct) > 0 THEN 'partial' ELSE 'none' END
         AS tier
FROM s GROUP BY question_ref""")
def q_annotation_agreement(spark: SparkSession, sf: str) -> DataFrame:
    a = standins.answers(spark, sf).filter(F.col("answer_type") == "distance").drop("answer_type")
    scored = scoring.score_distance(standins.responses(spark, sf).join(a, "question_ref", "inner"))
    return stats.annotation_agreement(scored)


def _mix_sql(seed: str, b: str, i: str, n: str) -> str:
    """DuckDB twin of ``stats.draw_indices``."""
    m = stats.MIX_MOD
    x0 = f"(({seed} + {b} * {stats.MIX_B} + {i} * {stats.MIX_I}) % {m})"
    x1 = f"(({x0} * {stats.MIX_A1} + {stats.MIX_C1}) % {m})"
    x2 = f"xor({x1}, {x1} >> 13)"
    x3 = f"(({x2} * {stats.MIX_A2} + {stats.MIX_C2}) % {m})"
    return f"(xor({x3}, {x3} >> 17) % {n})"


def _draws_sql(n_boot: int) -> str:
    return f"""
r AS (SELECT user_id, value AS x,
             row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS j,
             count(*) OVER (PARTITION BY user_id) AS n
      FROM events WHERE value IS NOT NULL),
s AS (SELECT DISTINCT user_id, n,
             ('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8))::BIGINT AS seed FROM r),
sb AS (SELECT user_id, n, seed, unnest(range({n_boot})) AS b FROM s),
d AS (SELECT user_id, n, seed, b, unnest(range(n)) AS i FROM sb),
dj AS (SELECT user_id, n, b, {_mix_sql('seed', 'b', 'i', 'n')} AS j FROM d),
dv AS (SELECT dj.user_id, dj.n, dj.b, r.x FROM dj JOIN r ON dj.user_id = r.user_id AND dj.j = r.j)"""


@register("bootstrap_se", "G4", lambda: f"""
WITH {_draws_sql(N_BOOT)},
m AS (SELECT user_id, n, b, sum(x) / n AS m FROM dv GROUP BY user_id, n, b)
SELECT user_id, n, round(stddev_samp(m), 6) AS se, 'bootstrap' AS method FROM m GROUP BY user_id, n""")
def q_bootstrap_se(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events").select("user_id", "value")
    return stats.bootstrap_se(e, "user_id", "value", n_boot=N_BOOT)


@register("winsorized_bootstrap", "G5", lambda: f"""
WITH {_draws_sql(N_BOOT)},
w AS (SELECT user_id, n, b, list_sort(list(x)) AS s, CAST(floor(0.25 * n) AS INTEGER) AS k
      FROM dv GROUP BY user_id, n, b),
m AS (SELECT user_id, n, b,
             list_sum(list_transform(s, lambda x: greatest(s[k + 1], least(s[n - k], x)))) / n AS m FROM w)
SELECT user_id, n, round(stddev_samp(m), 6) AS se, 'bootstrap' AS method FROM m GROUP BY user_id, n""")
def q_winsorized_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events").select("user_id", "value")
    return stats.winsorized_bootstrap(e, "user_id", "value", p=0.25, n_boot=N_BOOT)


@register("write_stats_csv", "S9", lambda: f"""
WITH {_spread_values_sql()}
SELECT question_ref, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std
FROM v GROUP BY question_ref""")
def q_write_stats_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Spread statistics written as CSV and read back with an explicit schema."""
    from evalspark.operators import basic
    from evalspark.session import scratch_path
    st = stats.annotator_spread(*_spread_inputs(spark, sf)).select("question_ref", "n", "mean", "std")
    path = basic.write_stats_csv(st, scratch_path(spark, "spread_csv"))
    return spark.read.schema("question_ref string, n bigint, mean double, std double").option("header", True).csv(path)


@register("drop_null_keys", "P9", """
SELECT event_id, printf('q_%04d', CAST(json_extract_string(props, '$.k') AS INTEGER)) AS question_ref
FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) < 90""")
def q_drop_null_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Submissions whose reference is unknown (k >= 90 -> null key) are dropped."""
    from evalspark.operators import basic
    e = read_table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    df = e.select("event_id", F.when(k < 90, F.format_string("q_%04d", k)).alias("question_ref"))
    return basic.drop_null_keys(df)


def _boot_sql(n_boot: int, src: str, g: str, x: str) -> str:
    """DuckDB twin of the grouped bootstrap over any ``src`` CTE (``g``, ``x``):
    defines ``br`` (ranked values), ``bdv`` (every draw with its value)."""
    return f"""
br AS (SELECT {g} AS g, {x} AS x, row_number() OVER (PARTITION BY {g} ORDER BY {x}) - 1 AS j,
              count(*) OVER (PARTITION BY {g}) AS n FROM {src} WHERE {x} IS NOT NULL),
bs AS (SELECT DISTINCT g, n, ('0x' || substr(md5(CAST(g AS VARCHAR)), 1, 8))::BIGINT AS seed FROM br),
bsb AS (SELECT g, n, seed, unnest(range({n_boot})) AS b FROM bs),
bd AS (SELECT g, n, seed, b, unnest(range(n)) AS i FROM bsb),
bdj AS (SELECT g, n, b, {_mix_sql('seed', 'b', 'i', 'n')} AS j FROM bd),
bdv AS (SELECT bdj.g, bdj.n, bdj.b, br.x FROM bdj JOIN br ON bdj.g = br.g AND bdj.j = br.j)"""


@register("spread_report", "G2-G5/D13", lambda: f"""
WITH {_spread_values_sql()},
{_boot_sql(N_BOOT, 'v', 'question_ref', 'x')},
mb AS (SELECT g, b, sum(x) / max(n) AS m FROM bdv GROUP BY g, b),
boot AS (SELECT g, round(stddev_samp(m), 6) AS boot_se FROM mb GROUP BY g),
w AS (SELECT g, n, b, list_sort(list(x)) AS s, CAST(floor(0.25 * n) AS INTEGER) AS k FROM bdv GROUP BY g, n, b),
mw AS (SELECT g, list_sum(list_transform(s, lambda y: greatest(s[k + 1], least(s[n - k], y)))) / n AS m FROM w),
wins AS (SELECT g, round(stddev_samp(m), 6) AS wins_se FROM mw GROUP BY g),
base AS (SELECT question_ref, count(*) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median,
                round(stddev_samp(x), 6) AS std, max(CASE WHEN is_expected THEN x END) AS expected_value
         FROM v GROUP BY question_ref)
SELECT base.*, boot.boot_se, wins.wins_se
FROM base LEFT JOIN boot ON base.question_ref = boot.g LEFT JOIN wins ON base.question_ref = wins.g""")
def q_spread_report(spark: SparkSession, sf: str) -> DataFrame:
    """Spread statistics with ``std``, ``boot_se`` and ``wins_se`` side by side."""
    return stats.spread_report(*_spread_inputs(spark, sf), n_boot=N_BOOT)
