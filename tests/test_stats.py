"""G1–G6, G13 and the bootstrap draws."""

import numpy as np
from pyspark.sql import functions as F

from evalspark.operators import report, stats


def test_canonical_answers(spark):
    bank = spark.createDataFrame([("q1", "Multi", "Border", "textual", " A ;B, C;")],
                                 "question_ref string, map_count string, spatial_relationship string, "
                                 "answer_type string, expected_answer string")
    assert stats.canonical_answers(bank).first()["expected_answer"] == ["A", "B, C", ""]


def _spread(spark, answers, expected):
    bank = spark.createDataFrame([("q", expected)], "question_ref string, expected_answer string")
    ann = spark.createDataFrame([("q", a) for a in answers], "question_ref string, answer string")
    return stats.annotator_spread(bank, ann).first()


def test_spread_values(spark):
    r = _spread(spark, ["38 km", "None", "", "42"], "40 ± 2")
    assert r["n"] == 3 and r["mean"] == 40.0 and r["median"] == 40.0 and r["expected_value"] == 40.0
    assert abs(r["std"] - 2.0) < 1e-9


def test_spread_n1_null_and_equal_zero(spark):
    assert _spread(spark, ["None"], "7")["std"] is None
    assert _spread(spark, ["7", "7"], "7")["std"] == 0.0


def test_outlier_flag(spark):
    bank = spark.createDataFrame([("q", "10"), ("p", "10")], "question_ref string, expected_answer string")
    ann = spark.createDataFrame([("q", "10"), ("q", "10"), ("q", "30"), ("p", "10"), ("p", "10")],
                                "question_ref string, answer string")
    got = {r["question_ref"]: r["has_outlier"] for r in stats.flag_spread_outliers(bank, ann).collect()}
    assert got == {"q": 1, "p": 0}


def test_agreement_tiers(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 0), ("c", 0), ("c", None)],
                               "question_ref string, correct int")
    got = {r["question_ref"]: r["tier"] for r in stats.annotation_agreement(df).collect()}
    assert got == {"a": "all", "b": "partial", "c": "none"}


def test_draws_are_deterministic_and_in_range():
    b = np.arange(5)[:, None]
    i = np.arange(9)[None, :]
    d1 = stats.draw_indices(stats.group_seed("g"), b, i, 9)
    d2 = stats.draw_indices(stats.group_seed("g"), b, i, 9)
    assert (d1 == d2).all() and d1.min() >= 0 and d1.max() < 9
    assert len(set(d1.ravel().tolist())) > 5


def whole_sample_means(v, draws, p):
    """Means of resamples given as ranks, winsorised by sorting each sample."""
    v, n = np.sort(v), len(v)
    k = int(p * n) if p else 0
    out = []
    for ranks in draws:
        x = np.sort(v[ranks])
        out.append(np.clip(x, x[k], x[n - 1 - k]).mean())
    return np.array(out)


def test_chunks_give_the_sample_of_all_their_draws():
    """Sums over chunks of any size equal those of the whole sample they draw."""
    rng = np.random.default_rng(5)
    v = np.sort(np.r_[rng.normal(size=95), rng.choice([0.0, 50.0], size=8)])
    for chunk in (7, 20, 103, 500):
        n, n_boot, levels = len(v), 40, (None, 0.25, 0.1)
        parts, draws = [], [[] for _ in range(n_boot)]
        for c in range(-(-n // chunk)):
            below, here = stats.chunk_draws(3, n, chunk, c, n_boot)
            own = v[c * chunk:(c + 1) * chunk]
            assert (below == [len(d) for d in draws]).all()
            for b in range(n_boot):
                at = stats.draw_indices(c, np.array([b]), np.arange(here[b]), len(own))
                draws[b].extend(at + c * chunk)
            parts.append(stats.chunk_sums(own, c, n, below, here, levels))
        assert all(len(d) == n for d in draws)
        for j, p in enumerate(levels):
            cut = int(p * n) if p else 0
            low, high = (np.nanmax([x[j][i] for x in parts], axis=0) for i in (1, 2))
            means = (sum(x[j][0] for x in parts) + cut * (low + high)) / n
            assert np.allclose(means, whole_sample_means(v, draws, p))


def test_bootstrap_is_one_definition_at_every_size(spark):
    rng = np.random.default_rng(2)
    big = np.r_[rng.normal(10, 2, size=24_980), np.full(20, 1e6)]  # a third of the rows, with outliers
    rows = [("big", float(x)) for x in big] + [(f"g{i % 3000}", float(i % 17)) for i in range(50_000)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(8)
    got = {r["g"]: r for r in stats.winsorized_bootstrap(df, "g", "x", n_boot=60).collect()}
    assert len(got) == 3001 and {r["method"] for r in got.values()} == {"bootstrap"}
    assert got["big"]["n"] == 25_000
    direct = whole_sample_means(big, rng.integers(0, 25_000, size=(60, 25_000)), 0.25)
    assert 0.6 < got["big"]["se"] / direct.std(ddof=1) < 1.6  # the winsorised statistic, not std / sqrt(n)
    one = {r["g"]: r["se"] for r in stats.winsorized_bootstrap(df.filter("g = 'g7'"), "g", "x", n_boot=60).collect()}
    assert one["g7"] == got["g7"]["se"]
    plain = stats.bootstrap_se(df.filter("g = 'big'"), "g", "x", n_boot=60).first()
    assert 0.6 < plain["se"] / (big.std() / 25_000 ** 0.5) < 1.6


def test_a_value_held_by_most_rows_is_ranked_by_many_tasks(spark):
    from evalspark.operators.ordinals import global_ordinal
    df = spark.range(60_000).select(F.when(F.col("id") % 3 < 2, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    o = global_ordinal(stats.salted(df), ["v", "_salt"], num_partitions=20, out="o")
    sizes = [r["n"] for r in o.groupBy(F.floor((F.col("o") - 1) / 3000)).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 3000
    counts = stats.salted(df).repartitionByRange(20, "v", "_salt").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in counts) < 2 * 60_000 / 20
    med = stats.exact_median(df.withColumn("k", F.lit("a")), "k", "v").first()["median"]
    assert med == float(np.median([5.0 if i % 3 < 2 else i for i in range(60_000)]))


def test_quantile_bins_fallbacks(spark):
    edges = lambda vals: sorted(r["edge"] for r in report.quantile_bins(
        spark.createDataFrame([(float(v),) for v in vals], "v double"), "v").collect())
    assert edges([0, -1]) == [0.0, 1.0]
    assert edges([5, 5, 5]) == [5.0]
    assert edges([1, 2, 3, 4, 5, 6]) == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]


def test_quantile_bins_approx_opt_in(spark):
    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("v"))
    exact = sorted(r["edge"] for r in report.quantile_bins(df, "v").collect())
    approx = sorted(r["edge"] for r in report.quantile_bins(df, "v", approx_accuracy=10000).collect())
    assert len(exact) == len(approx) == 6 and all(abs(a - b) <= 2 for a, b in zip(exact, approx))


def test_cluster_conf_keeps_checkpoint_dir_unset():
    from evalspark.session import cluster_conf
    conf = cluster_conf(1000, 8)
    assert conf["spark.sql.adaptive.enabled"] == "true" and "spark.checkpoint.dir" not in conf
    assert int(conf["spark.sql.shuffle.partitions"]) >= 2000


def test_spread_report_columns(spark):
    bank = spark.createDataFrame([("q", "10"), ("p", "5")], "question_ref string, expected_answer string")
    ann = spark.createDataFrame([("q", "9"), ("q", "11"), ("q", "30"), ("p", "None")], "question_ref string, answer string")
    r = {x["question_ref"]: x for x in stats.spread_report(bank, ann, n_boot=50).collect()}
    assert r["q"]["n"] == 4 and r["q"]["boot_se"] > 0 and r["q"]["wins_se"] >= 0 and r["q"]["std"] > 0
    assert r["p"]["n"] == 1 and r["p"]["std"] is None


def test_arc_layout_explicit_child_order(spark):
    prof = spark.createDataFrame([("Border", "Single", 41), ("Border", "Multi", 30), ("Equal", "Multi", 54)],
                                 "p string, c string, n long")
    rows = {(r["p"], r["c"]): r for r in report.arc_layout(prof, "p", "c", child_order=["Single", "Multi"]).collect()}
    b1, b2 = rows[("Border", "Single")], rows[("Border", "Multi")]
    assert b1["p_start"] == 90.0 and b1["c_start"] == 90.0 and b1["c_end"] == b2["c_start"]
    assert abs(b2["c_end"] - b1["p_end"]) < 1e-6 and abs(b1["p_end"] - (90 - 360 * 71 / 125)) < 1e-6


def test_rank_selection_equals_sorting(spark):
    rng = np.random.default_rng(1)
    groups = {"dense": rng.normal(size=500), "ties": rng.integers(0, 4, 800).astype(float), "one": np.array([3.5]),
              "wide": np.concatenate([rng.normal(size=50) * 10.0 ** rng.integers(-300, 300, 50), [1.7e308, -1.7e308]]),
              "same": np.full(300, -2.0), "near": 1.0 + np.arange(40) * 2.0 ** -52}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs]
    df = spark.createDataFrame(rows, "k string, x double").repartition(7)
    wanted = [(g, r) for g, xs in groups.items() for r in {1, len(xs), (len(xs) + 1) // 2, len(xs) // 3 + 1}]
    got = stats.select_ranks(df, spark.createDataFrame(wanted, "k string, rank bigint"), "k").collect()
    assert sorted((r["k"], r["rank"]) for r in got) == sorted(wanted)
    for r in got:
        assert r["x"] == np.sort(groups[r["k"]])[r["rank"] - 1]
    for whole in (0, 100, 10 ** 6):
        med = {r["k"]: r["median"] for r in stats.exact_median(df, "k", "x", whole=whole).collect()}
        assert med == {g: float(np.median(xs)) for g, xs in groups.items()}


def test_large_groups_do_not_sort_their_values(spark):
    df = spark.range(1000).selectExpr("'a' AS k", "cast(id % 7 AS double) AS x")
    plan = stats.exact_median(df, "k", "x", whole=10)
    assert plan.first()["median"] == 3.0


def test_null_groups_are_numbered_too(spark):
    from evalspark.operators.ordinals import group_ordinal
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), ("a", 3), ("b", 9)], "g string, v int")
    got = sorted(((r["g"] or "", r["v"], r["i"], r["n"]) for r in group_ordinal(df, ["g"], ["v"], "i", "n").collect()))
    assert got == [("", 1, 1, 2), ("", 2, 2, 2), ("a", 1, 1, 2), ("a", 3, 2, 2), ("b", 9, 1, 1)]


def test_small_groups_at_once_are_the_same_bootstrap():
    """Blocks of equally large groups give the errors that each group gives by itself."""
    rng = np.random.default_rng(2)
    sizes = [1, 2, 3, 4, 5, 5, 5, 8, 9, 16, 17, 40]
    names = [f"g{i}" for i in range(len(sizes))]
    offsets = np.r_[0, np.cumsum(sizes)]
    flat = np.concatenate([np.sort(rng.integers(0, 50, n).astype(float)) for n in sizes])
    got = stats.group_errors(names, offsets[:-1], np.diff(offsets), flat, 200, (None, 0.25, 0.1))
    for g, n, s, row in zip(names, sizes, offsets, got):
        none, all_ = np.zeros(200, dtype=np.int64), np.full(200, n, dtype=np.int64)
        sums = stats.chunk_sums(flat[s:s + n], stats.group_seed(g), n, none, all_, (None, 0.25, 0.1))
        want = [np.std((inner + int((w or 0) * n) * (low + high)) / n, ddof=1)
                for (inner, low, high), w in zip(sums, (None, 0.25, 0.1))]
        assert np.allclose(row, want, rtol=1e-12, atol=1e-12)


def test_spread_report_in_one_pass_equals_the_joined_one(spark, monkeypatch):
    rows = [("a", "1 km"), ("a", "3"), ("a", "None"), ("b", ""), ("c", "7"), ("x", "9"), (None, "4"), ("d", "2"), ("d", "2")]
    ann = spark.createDataFrame(rows, "question_ref string, answer string")
    bank = spark.createDataFrame([("a", "2"), ("b", "5 m"), ("c", None), ("d", "no"), ("d", "8"), ("e", None), (None, "1")],
                                 "question_ref string, expected_answer string")
    one = sorted(map(str, stats.spread_report(bank, ann, n_boot=60).collect()))
    monkeypatch.setattr(stats, "CHUNK_ROWS", 0)
    joined = stats.spread_report(bank, ann, n_boot=60)
    assert sorted(map(str, joined.collect())) == one
    assert [x.split("'")[1] for x in one] == ["a", "b", "c", "d"]
