"""Ordinals, round robin, navigation."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalspark.operators import assign, ordinals


def questions(spark, n):
    df = spark.createDataFrame([(i * 37 % 101, f"text {i}") for i in range(n)], "k int, question_text string")
    return ordinals.number_questions(df, ["k"])


def roster(spark, ids):
    return spark.createDataFrame([(u, f"name {u}") for u in ids], "user_id string, user_name string")


def test_global_ordinal_matches_row_number(spark):
    df = spark.range(0, 997).select((F.col("id") * 7919 % 997).alias("k")).repartition(5)
    o = ordinals.global_ordinal(df, ["k"], num_partitions=6)
    rows = sorted((r["k"], r["ordinal"]) for r in o.collect())
    assert [r[1] for r in rows] == list(range(1, 998))


def test_descending_ordinal(spark):
    df = spark.createDataFrame([(1,), (5,), (3,)], "k int")
    o = {r["k"]: r["ordinal"] for r in ordinals.global_ordinal(df, [F.col("k").desc()]).collect()}
    assert o == {5: 1, 3: 2, 1: 3}


def test_number_questions_format(spark):
    q = questions(spark, 3).orderBy("ordinal").collect()
    assert [r["question_ref"] for r in q] == ["q_0001", "q_0002", "q_0003"]


def test_round_robin_empty_roster_is_error(spark):
    with pytest.raises(ValueError):
        assign.assign_round_robin(questions(spark, 3), roster(spark, []), r=2)


def test_round_robin_slots(spark):
    a = assign.assign_round_robin(questions(spark, 3), roster(spark, ["024", "124", "200"]), r=2)
    got = [(r["question_ref"], r["slot"], r["user_id"]) for r in a.orderBy("ordinal", "slot").collect()]
    assert got == [("q_0001", 0, "024"), ("q_0001", 1, "124"), ("q_0002", 0, "200"),
                   ("q_0002", 1, "024"), ("q_0003", 0, "124"), ("q_0003", 1, "200")]


def test_single_user_repeats_and_reports(spark):
    a = assign.assign_round_robin(questions(spark, 2), roster(spark, ["007"]), r=2).collect()
    assert {r["user_id"] for r in a} == {"007"} and all(r["user_repeated"] for r in a)


@settings(max_examples=6, deadline=None)
@given(st.integers(min_value=1, max_value=25), st.integers(min_value=1, max_value=7))
def test_loads_differ_by_at_most_one(spark, n_q, n_users):
    a = assign.assign_round_robin(questions(spark, n_q), roster(spark, [f"{i:03d}" for i in range(n_users)]), r=2)
    w = [r["n_pages"] for r in assign.workload(a, roster(spark, [f"{i:03d}" for i in range(n_users)])).collect()]
    assert sum(w) == 2 * n_q and max(w) - min(w) <= 1


def test_pages_next_and_resume(spark):
    a = assign.assign_round_robin(questions(spark, 4), roster(spark, ["a", "b"]), r=1)
    pages = assign.page_ordinals(a)
    p = {(r["user_id"], r["page_idx"]): (r["page"], r["progress"]) for r in pages.collect()}
    assert p[("a", 1)] == ("a_q_0001.html", "Q1/2") and p[("b", 2)] == ("b_q_0004.html", "Q2/2")
    nxt = {(r["user_id"], r["page_idx"]): r["next_page"] for r in assign.next_page(pages).collect()}
    assert nxt[("a", 1)] == "a_q_0003.html" and nxt[("a", 2)] == "thankyou.html"
    answered = a.sparkSession.createDataFrame([("b", "q_0004")], "user_id string, question_ref string")
    users = a.sparkSession.createDataFrame([("a",), ("b",), ("c",)], "user_id string")
    res = {r["user_id"]: r["resume_page"] for r in assign.resume_pointer(pages, answered, users).collect()}
    # none answered -> first page; last answered -> itself; no pages -> thank-you page
    assert res == {"a": "a_q_0001.html", "b": "b_q_0004.html", "c": "thankyou.html"}


def test_resume_does_not_revisit_gaps(spark):
    a = assign.assign_round_robin(questions(spark, 3), roster(spark, ["a"]), r=1)
    pages = assign.page_ordinals(a)
    answered = spark.createDataFrame([("a", "q_0002")], "user_id string, question_ref string")
    res = assign.resume_pointer(pages, answered).first()
    assert res["resume_page"] == "a_q_0003.html"


def test_batch_and_shard(spark):
    df = spark.range(0, 45).withColumnRenamed("id", "k")
    b = {r["k"]: r["batch_id"] for r in ordinals.batch_id(df, ["k"], 20).collect()}
    assert b[0] == 0 and b[19] == 0 and b[20] == 1 and b[44] == 2
    s = sorted(r["k"] for r in ordinals.shard_rows(df, ["k"], 10, 15).collect())
    assert s == [10, 11, 12, 13, 14]
    assert ordinals.shard_rows(df, ["k"], 10, 0).count() == 45


def test_group_ordinal(spark):
    df = spark.createDataFrame([("x", 3), ("x", 1), ("y", 2), ("x", 2)], "g string, v int")
    got = sorted((r["g"], r["v"], r["o"], r["t"]) for r in ordinals.group_ordinal(df, ["g"], ["v"], "o", "t").collect())
    assert got == [("x", 1, 1, 3), ("x", 2, 2, 3), ("x", 3, 3, 3), ("y", 2, 1, 1)]


def test_group_ordinal_with_a_hot_group(spark):
    """One group holds a third of all rows: ordinals stay exact."""
    rows = [("hot", i) for i in range(3000)] + [(f"g{i % 50}", i) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(8)
    got = {(r["g"], r["v"]): (r["o"], r["t"]) for r in ordinals.group_ordinal(df, ["g"], ["v"], "o", "t").collect()}
    assert all(got[("hot", i)] == (i + 1, 3000) for i in range(3000))
    assert got[("g0", 0)] == (1, 120) and got[("g0", 5950)] == (120, 120)


def test_skewed_evaluate_matches_plain_full_outer(spark):
    from evalspark.operators import scoring
    responses = spark.createDataFrame([("hot", f"m{i}", "s", f"{i % 40} miles") for i in range(2000)]
                                      + [("q1", "m", "s", "North")], "question_ref string, model string, "
                                      "setting string, response string")
    answers = spark.createDataFrame([("hot", "distance", "20 ± 5"), ("q1", "cardinal", "North West"),
                                     ("q2", "textual", "x")], "question_ref string, answer_type string, "
                                     "expected_answer string")
    out = scoring.evaluate(responses, answers).cache()
    # 2001 runs, each measured against all three questions
    assert out.count() == 2001 * 3
    assert out.filter("response is not null").count() == 2001
    hot = out.filter("question_ref = 'hot' and response is not null")
    assert hot.count() == 2000 and hot.filter("correct = 1").count() == sum(15 <= i % 40 <= 25 for i in range(2000))
    assert out.filter("question_ref = 'q2' and correct is null").count() == 2001
    out.unpersist()
