"""Scalar expressions X1–X7, X14 and the Unicode strip."""

from pyspark.sql import functions as F

from evalspark.functions import text as T


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("r")).first()["r"]


def test_ustrip_tabs_newlines_nbsp(spark):
    assert one(spark, T.ustrip, "\t  North West \n　") == "North West"
    assert one(spark, T.ustrip, "   ") == ""
    assert one(spark, T.ustrip, None) is None


def test_split_keeps_commas_inside_items(spark):
    assert one(spark, T.split_answers, " Old Town ; Mill Quarter, East;") == ["Old Town", "Mill Quarter, East", ""]


def test_first_number(spark):
    assert one(spark, T.first_number, "38 ± 2 MILES") == 38.0
    assert one(spark, T.first_number, "1,600 m") == 1.0
    assert one(spark, T.first_number, "40.") == 40.0
    assert one(spark, T.first_number, "-5 km") == 5.0
    assert one(spark, T.first_number, "no number") is None


def test_all_numbers(spark):
    assert one(spark, T.all_numbers, "38 ± 2 MILES") == [38.0, 2.0]
    assert one(spark, T.all_numbers, "none") == []


def test_normalise_and_numeric(spark):
    df = spark.createDataFrame([(["1.5", " 2 ", "--"],), (["Old Town!", "Mill-Quarter"],)], "v array<string>")
    rows = df.select(T.normalise_list("v").alias("n"), T.is_numeric_list(T.normalise_list("v")).alias("num")).collect()
    assert rows[0]["n"] == ["15", "2"] and rows[0]["num"] is True
    assert rows[1]["n"] == ["oldtown", "millquarter"] and rows[1]["num"] is False


def test_final_answer_marker(spark):
    f = T.extract_final_answer
    assert one(spark, f, "reasoning ... Final answer:  North \n") == "North"
    assert one(spark, f, "Final answer: a Final answer: b") == "b"
    assert one(spark, f, "  just text ") == "just text"
    assert one(spark, f, None) is None


def test_yes_verdict(spark):
    assert one(spark, T.yes_verdict, "  Yes, correct") == 1
    assert one(spark, T.yes_verdict, "no") == 0


def test_symmetric_difference(spark):
    df = spark.createDataFrame([(["a", "b", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert df.select(T.symmetric_difference_size("a", "b").alias("n")).first()["n"] == 2


def test_page_ref_fallback(spark):
    from evalspark.functions.assets import page_ref
    assert one(spark, page_ref, "024_q_0007.html") == "q_0007"
    assert one(spark, page_ref, "thankyou.html") == "thankyou.html"
