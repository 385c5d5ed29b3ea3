"""Reports and asset helpers: G7–G12, G16, J3, J4, T2, T3, W8, X8–X13, P12."""

import math

from pyspark.sql import functions as F

from evalspark.functions import assets
from evalspark.functions.ring import ring_table
from evalspark.operators import report


def test_accuracy_dedupes_keys_and_counts_pending(spark):
    df = spark.createDataFrame([("q1", "m", 1), ("q1", "m", 1), ("q2", "m", 0), ("q3", "m", None)],
                               "question_ref string, model string, correct int")
    r = report.accuracy(df, ["model"], key=["question_ref", "model"]).first()
    assert (r["n"], r["n_correct"], r["n_pending"]) == (3, 1, 1) and abs(r["accuracy"] - 100 / 3) < 1e-5


def test_accuracy_by_relationship_and_tier(spark):
    df = spark.createDataFrame([("m", "Border", "all", 1), ("m", "Border", "partial", 0), ("m", "Within", "partial", 1),
                                ("m", "Distance", "all", 1)],
                               "model string, spatial_relationship string, tier string, correct int")
    rel = report.accuracy_by_relationship(df).first()
    assert rel["Border"] == 50.0 and rel["Within"] == 100.0 and rel["Equal"] is None
    tier = report.accuracy_by_tier(df, ["model"]).first()
    assert (tier["acc_all"], tier["acc_partial"], tier["acc_total"]) == (50.0, 25.0, 75.0)


def test_profile_share_and_counts(spark):
    df = spark.createDataFrame([("Border", "Single"), ("Border", "Multi"), ("Equal", "Multi")],
                               "spatial_relationship string, map_count string")
    prof = {(r["spatial_relationship"], r["map_count"]): (r["n"], r["level"]) for r in report.bank_profile(df).collect()}
    assert prof[(None, None)] == (3, 3) and prof[("Border", None)] == (2, 1) and prof[("Equal", "Multi")] == (1, 0)
    share = {r["map_count"]: (r["n"], r["share"], r["label"]) for r in report.category_share(df, "map_count").collect()}
    assert share["Multi"] == (2, round(2 / 3, 6), "Multi\n(2)")


def test_coverage_unmatched_top_n(spark):
    dim = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "k int, name string")
    facts = spark.createDataFrame([(1,), (1,), (2,), (9,)], "k int")
    cov = {r["k"]: r["n"] for r in report.coverage(dim, facts, "k", "k").collect()}
    assert cov == {1: 2, 2: 1, 3: 0}
    fb = spark.createDataFrame([(9, 1.5, 2.5)], "k int, lon double, lat double")
    assert [(r["k"], r["lon"]) for r in report.unmatched(facts, dim, "k", "k", fb).collect()] == [(9, 1.5)]
    counts = spark.createDataFrame([("B", 2), ("A", 2), ("C", 5)], "name string, n long")
    assert [r["name"] for r in report.top_n(counts, "n", "name", 2).collect()] == ["C", "A"]


def test_harmonise_size_curve_maxima_log(spark):
    df = spark.createDataFrame([("United States",), ("Chad",)], "c string")
    assert sorted(r["c"] for r in report.harmonise_names(df, "c", {"United States": "United States of America"})
                  .collect()) == ["Chad", "United States of America"]
    scored = spark.createDataFrame([("m1", 1), ("m1", 0), ("m2", 1)], "model string, correct int")
    sizes = spark.createDataFrame([("m1", 8), ("m2", 14)], "model string, size int")
    assert {r["size"]: r["accuracy"] for r in report.size_curve(scored, sizes).collect()} == {8: 50.0, 14: 100.0}
    curve = spark.createDataFrame([(1, 9.4), (2, 12.8), (3, 20.0), (4, 14.2), (5, 14.2)], "x int, y double")
    assert [r["is_local_max"] for r in report.local_maxima(curve, "x", "y").orderBy("x").collect()] == \
        [False, False, True, False, True]
    r = spark.createDataFrame([(100.0,)], "v double").select(report.log_scale(F.col("v")).alias("a"),
                                                            report.log_scale(F.col("v"), 10).alias("b")).first()
    assert abs(r["a"] - math.log(100)) < 1e-12 and abs(r["b"] - 2.0) < 1e-12


def test_asset_functions(spark):
    df = spark.createDataFrame([("maps/sub/image43_2.jpeg",), ("image25_m0.png",), ("a/b_c/image7_ab12.png",),
                                ("noimage.png",)], "p string")
    rows = df.select(assets.split_path("p").alias("s")).select("s.dir", "s.name").collect()
    assert (rows[0]["dir"], rows[0]["name"]) == ("maps/sub", "image43_2.jpeg") and rows[1]["dir"] == ""
    parsed = [r["a"] for r in df.select(assets.parse_asset(assets.split_path("p")["name"]).alias("a")).collect()]
    assert (parsed[0]["main"], parsed[0]["letters"], parsed[0]["sub"]) == (43, "", 2)
    assert (parsed[1]["main"], parsed[1]["letters"], parsed[1]["sub"], parsed[1]["letter_sum"]) == (25, "m", 0, 109)
    assert (parsed[2]["letters"], parsed[2]["sub"], parsed[2]["letter_sum"]) == ("ab", 12, 195)
    assert (parsed[3]["main"], parsed[3]["sub"]) == (-1, -1)
    urls = spark.createDataFrame([("https://x/p",), ("https://x/p?a=1",)], "u string")
    assert [r[0] for r in urls.select(assets.add_ok("u")).collect()] == ["https://x/p?ok=1", "https://x/p?a=1&ok=1"]


def test_ring_table_has_24_rows(spark):
    t = ring_table(spark)
    assert t.count() == 24 and t.filter("expected = 'North'").select("accepted").count() == 3
