"""E1–E5 on hand-written rows (FIXTURES §B edge cases) plus properties."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalspark.functions.ring import DIRECTIONS, accepted_for
from evalspark.operators import scoring


def score(spark, fn, pairs, **kw):
    df = spark.createDataFrame(pairs, "response string, expected_answer string")
    return [r["correct"] for r in fn(df, **kw).collect()]


def test_distance_tolerance(spark):
    got = score(spark, scoring.score_distance, [
        ("36", "38 ± 2 MILES"), ("40", "38 ± 2 MILES"), ("40.01", "38 ± 2 MILES"),
        ("no idea", "38 ± 2 MILES"), ("1,600 km", "1600 KM"), ("38 km", "38 MILES"),
        ("40.", "40"), ("about 38 miles", "38"), (None, "38"),
    ])
    assert got == [1, 1, 0, 0, 0, 1, 1, 1, 0]


def test_distance_without_plus_minus_ignores_second_number(spark):
    assert score(spark, scoring.score_distance, [("39", "38 to 40 MILES")]) == [0]


def test_cardinal_ring(spark):
    got = score(spark, scoring.score_cardinal, [
        ("North West", "North"), ("North East", "North"), ("West", "North"),
        ("North", "North West"), ("Up", "Up"), ("Down", "Up"), ("north", "North"),
    ])
    assert got == [1, 1, 0, 1, 1, 0, 0]


def test_cardinal_exact_only(spark):
    assert score(spark, scoring.score_cardinal, [("North West", "North")], exact_only=True) == [0]


def test_text_rules(spark):
    got = score(spark, scoring.score_text, [
        ("Mill Quarter; Old Town; Old Town", "Old Town;Mill Quarter"),   # order/dupes ignored
        ("3; 1", "1; 3"),                                                # numeric: ordered
        ("1.5", "15"),                                                   # D11: digit-wise
        ("Old-Town!", "old town"),                                       # punctuation
        ("Somewhere else", "Old Town"),                                  # undecided
        ("日本", "中国"),                                                 # non-Latin only: undecided
        ("", "  "),                                                      # blank vs blank
    ])
    assert got == [1, 0, 1, 1, None, None, 1]


def test_text_non_strict_empty(spark):
    assert score(spark, scoring.score_text, [("日本", "中国")], strict_empty=False) == [1]


def test_evaluate_dispatch_align_and_verdicts(spark):
    responses = spark.createDataFrame([
        ("q1", "m", "direct", "about 37 miles"), ("q2", "m", "direct", "North East"),
        ("q3", "m", "direct", "Somewhere"), ("q9", "m", "direct", "orphan"),
    ], "question_ref string, model string, setting string, response string")
    answers = spark.createDataFrame([
        ("q1", "distance", "38 ± 2 MILES"), ("q2", "cardinal", "North"), ("q3", "textual", "Old Town"),
        ("q4", "distance", "5"),
    ], "question_ref string, answer_type string, expected_answer string")
    verdicts = spark.createDataFrame([("q3", "m", "direct", "Yes.")],
                                     "question_ref string, model string, setting string, verdict string")
    out = {r["question_ref"]: r["correct"] for r in scoring.evaluate(responses, answers, verdicts).collect()}
    assert out == {"q1": 1, "q2": 1, "q3": 1, "q4": 0, "q9": 0}
    pending = scoring.judge_queue(scoring.evaluate(responses, answers))
    assert [r["question_ref"] for r in pending.collect()] == ["q3"]


def test_evaluate_accepts_list_answers(spark):
    responses = spark.createDataFrame([("q1", "b; a")], "question_ref string, response string")
    answers = spark.createDataFrame([("q1", "textual", ["a", " b"])],
                                    "question_ref string, answer_type string, expected_answer array<string>")
    assert scoring.evaluate(responses, answers).first()["correct"] == 1


def test_ring_symmetric():
    for i, d in enumerate(DIRECTIONS):
        for a in accepted_for(i):
            assert d in accepted_for(DIRECTIONS.index(a))


words = st.lists(st.sampled_from(["Old Town", "Mill", "Ridge", "Bay", "East Gate"]), min_size=1, max_size=5)


@settings(max_examples=15, deadline=None)
@given(words)
def test_text_invariant_to_order_and_duplicates(spark, items):
    shuffled = items[:]
    random.Random(len(items)).shuffle(shuffled)
    resp = "; ".join(shuffled + shuffled[:1])
    got = score(spark, scoring.score_text, [(resp, ";".join(items))])
    assert got == [1]


def test_judge_prompt_renders_lists_like_the_reference(spark):
    scored = spark.createDataFrame([("q7", "m", "s", "Old Town; Bay", "Ridge", None)],
                                   "question_ref string, model string, setting string, response string, "
                                   "expected_answer string, correct int")
    r = scoring.judge_queue(scored).first()
    assert r["expected"] == "['ridge']" and r["response"] == "['oldtown', 'bay']"
    assert r["prompt"] == ("Question reference: q7\nExpected answer: ['ridge']\nGiven response: ['oldtown', 'bay']"
                           "\n\nDoes the response correctly answer the question based on expected answer? "
                           "Answer strictly 'yes' or 'no'.")


def test_every_model_is_measured_against_every_question(spark):
    """A model that skipped questions keeps them in its denominator."""
    from evalspark.operators.report import accuracy
    answers = spark.createDataFrame([(f"q{i}", "cardinal", "North") for i in range(4)],
                                    "question_ref string, answer_type string, expected_answer string")
    rows = [(f"q{i}", "A", "direct", "North") for i in range(4)] + [("q0", "B", "direct", "North"),
                                                                   ("x", "B", "direct", "North")]
    responses = spark.createDataFrame(rows, "question_ref string, model string, setting string, response string")
    out = scoring.evaluate(responses, answers)
    got = {r["model"]: (r["n"], r["accuracy"])
           for r in accuracy(out.filter("answer_type is not null"), ["model"]).collect()}
    assert got == {"A": (4, 100.0), "B": (4, 25.0)}
    assert out.filter("question_ref = 'x'").count() == 1  # a response with no answer stays


def test_null_and_repeated_verdicts(spark):
    scored = spark.createDataFrame([("a", None), ("b", None), ("c", None), ("d", 0)],
                                   "question_ref string, correct int")
    verdicts = spark.createDataFrame([("a", None), ("b", "yes"), ("b", "Yes."), ("c", "yes"), ("c", "no"),
                                      ("c", None), ("d", "yes")], "question_ref string, verdict string")
    got = sorted((r["question_ref"], r["correct"]) for r in
                 scoring.apply_verdicts(scored, verdicts, ["question_ref"]).collect())
    assert got == [("a", None), ("b", 1), ("c", 0), ("d", 0)]


def test_judge_is_asked_about_answers_only(spark):
    answers = spark.createDataFrame([("q1", "textual", "a lake"), ("q2", "textual", "a river"), ("q3", "textual", "12"),
                                     ("q4", "distance", "5 km"), ("q5", "textual", "")],
                                    "question_ref string, answer_type string, expected_answer string")
    rows = [("q1", "A", "s", "the lake"), ("q2", "A", "s", "a river"), ("q3", "A", "s", "13"), ("q4", "A", "s", "9 km"),
            ("q5", "A", "s", "!"), ("q1", "B", "s", "pond"), ("q2", "B", "s", None), ("zz", "B", "s", "no such question"),
            (None, "B", "s", "x")]
    responses = spark.createDataFrame(rows, "question_ref string, model string, setting string, response string")
    whole = scoring.judge_queue(scoring.evaluate(responses, answers))
    direct = scoring.queue_responses(responses, answers)
    assert whole.columns == direct.columns
    for queue in (whole, direct):
        got = sorted((r["question_ref"], r["model"]) for r in queue.collect())
        assert got == [("q1", "A"), ("q1", "B"), ("q5", "A")]
        assert queue.filter("prompt is null or response is null").count() == 0
    assert sorted(map(str, whole.collect())) == sorted(map(str, direct.collect()))


def test_skipped_questions_can_be_queued(spark):
    """The registered queue holds every undecided row, those without a response too."""
    answers = spark.createDataFrame([("q1", "textual", "a lake"), ("q2", "textual", "a river"), ("q3", "distance", "5"),
                                     ("q2", "textual", "a brook"), (None, "textual", "x")],
                                    "question_ref string, answer_type string, expected_answer string")
    rows = [("q1", "A", "s", "the lake"), ("q2", "A", "s", "a river"), ("q3", "B", "s", "5"), ("q1", "B", "s", None),
            ("q2", None, "s", "pond"), ("q1", "A", "s", "pond"), ("zz", "C", "s", "no such question")]
    responses = spark.createDataFrame(rows, "question_ref string, model string, setting string, response string")
    scored = scoring.evaluate(responses, answers)
    whole = scoring.judge_queue(scored, skipped=True)
    direct = scoring.queue_responses(responses, answers, skipped=True)
    assert whole.columns == direct.columns
    assert sorted(map(str, whole.collect())) == sorted(map(str, direct.collect()))
    assert direct.count() == scored.filter("correct is null").count() > direct.filter("response is not null").count()


def test_skipped_runs_are_those_of_a_full_align(spark):
    """Null runs, repeated responses and answers, and more runs than one long has bits."""
    from evalspark.operators.shape import align
    rows = [(f"q{i % 3}", f"m{i}", "s", f"r{i}") for i in range(70)] + [
        ("q0", "m0", "s", "again"), ("q0", None, "s", "x"), ("q1", "m1", None, "y"), (None, "m1", "s", "z"), ("zz", "m2", "s", "w")]
    responses = spark.createDataFrame(rows, "question_ref string, model string, setting string, response string")
    answers = spark.createDataFrame([("q0", "textual", "a"), ("q1", "distance", "1"), ("q1", "cardinal", "North"),
                                     ("q9", "textual", "b"), (None, "textual", "c")],
                                    "question_ref string, answer_type string, expected_answer string")
    wanted = answers.select("question_ref").distinct().crossJoin(responses.select("model", "setting").distinct())
    plain = (align(responses, wanted, ["question_ref", "model", "setting"]).join(answers, "question_ref", "left")
             .filter("question_ref is not null"))
    got = scoring.evaluate(responses, answers)
    assert got.columns == [*plain.columns, "correct"]
    assert sorted(map(str, got.drop("correct").collect())) == sorted(map(str, plain.collect()))
    none = scoring.evaluate(responses.limit(0), answers)
    assert sorted(map(str, none.select("question_ref", "model", "response").collect())) == sorted(
        f"Row(question_ref='{q}', model=None, response=None)" for q in ("q0", "q1", "q1", "q9"))
