"""Answer scoring (E1–E5): one narrow expression pass per row.

The reference partitions the response table by answer type, runs a Python row
callback per partition and unions the parts.  Here the dispatch is a single
``CASE`` over ``answer_type`` evaluated in the same projection, so scoring a
table is one scan with no shuffle; the shuffles in :func:`evaluate` are those
of responses and answers by question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.ring import accepted_directions
from evalspark.operators.shape import align_skew_safe
from evalspark.functions.text import (
    NUMBER_PATTERN, first_answer, first_number, is_numeric_list, let, nonblank, normalise_list,
    same_set, split_answers, ustrip, yes_verdict,
)

DISTANCE, TEXTUAL, CARDINAL = "distance", "textual", "cardinal"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_answer_list(c) -> Column:
    """Accept a raw answer string or an already-split list."""
    return c if not isinstance(c, str) else split_answers(c)


def _first(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(1))


def _nth_number(nums: Column, i: int) -> Column:
    return F.try_element_at(nums, F.lit(i)).try_cast("double")


def distance_scalar(resp0: Column, exp0: Column) -> Column:
    """E1 on the first (stripped) answers: 1 iff the response's first number
    lies in ``e ± tol`` (inclusive).

    ``tol`` is the second number of the expected answer when it holds ``±``,
    else 0.  No number on either side -> 0.  Units are ignored (D10).  No
    higher-order function: stays in generated code.
    """
    nums = F.regexp_extract_all(exp0, F.lit(f"({NUMBER_PATTERN})"), F.lit(1))
    e = _nth_number(nums, 1)
    tol = F.when(exp0.contains("±"), F.coalesce(_nth_number(nums, 2), F.lit(0.0))).otherwise(F.lit(0.0))
    hit = first_number(resp0).between(e - tol, e + tol)
    return F.when(F.coalesce(hit, F.lit(False)), F.lit(1)).otherwise(F.lit(0))


def cardinal_scalar(resp0: Column, exp0: Column, exact_only: bool = False) -> Column:
    """Response is the expected direction or a ring neighbour of it."""
    ok = F.array_contains(accepted_directions(exp0, exact_only), resp0)
    return F.when(F.coalesce(ok, F.lit(False)), F.lit(1)).otherwise(F.lit(0))


def distance_correct(resp_list: Column, exp_list: Column) -> Column:
    """E1 on split answer lists (first elements are used, D8)."""
    return distance_scalar(_first(resp_list), _first(exp_list))


def cardinal_correct(resp_list: Column, exp_list: Column, exact_only: bool = False) -> Column:
    return cardinal_scalar(_first(resp_list), _first(exp_list), exact_only)


def text_correct(resp_list: Column, exp_list: Column, resp_raw: Column | None = None,
                 exp_raw: Column | None = None, strict_empty: bool = True) -> Column:
    """1/0 when decided by rule, null when it needs a judge.

    Both normalised lists all-numeric -> ordered equality decides 1 or 0.
    Otherwise equal sets -> 1; anything else is undecided (null).  With
    ``strict_empty`` two empty lists count only if both originals are blank
    (D11), otherwise they are undecided.  The two normalised lists are
    computed once (``let``) and shared by every branch.
    """
    if strict_empty and resp_raw is not None and exp_raw is not None:
        empty_ok = ~nonblank(resp_raw) & ~nonblank(exp_raw)
    else:
        empty_ok = F.lit(True)

    def body(p: Column) -> Column:
        r, e = p["r"], p["e"]
        both_numeric = is_numeric_list(r) & is_numeric_list(e)
        empty_both = (F.size(r) == 0) & (F.size(e) == 0)
        return (
            F.when(both_numeric, F.when(r == e, F.lit(1)).otherwise(F.lit(0)))
            .when(empty_both, F.when(empty_ok, F.lit(1)))
            .when(same_set(r, e), F.lit(1))
        )
    return let(F.struct(normalise_list(resp_list).alias("r"), normalise_list(exp_list).alias("e")), body)


def _first_of(df: DataFrame, c: str) -> Column:
    return first_answer(c) if dict(df.dtypes)[c] == "string" else ustrip(_first(F.col(c)))


def score_distance(df: DataFrame, response: str = "response",
                   expected: str = "expected_answer", out: str = "correct") -> DataFrame:
    return df.withColumn(out, distance_scalar(_first_of(df, response), _first_of(df, expected)))


def score_cardinal(df: DataFrame, response: str = "response", expected: str = "expected_answer",
                   out: str = "correct", exact_only: bool = False) -> DataFrame:
    return df.withColumn(out, cardinal_scalar(_first_of(df, response), _first_of(df, expected), exact_only))


def score_text(df: DataFrame, response: str = "response", expected: str = "expected_answer",
               out: str = "correct", strict_empty: bool = True) -> DataFrame:
    resp_raw = F.col(response)
    exp_raw = F.col(expected)
    exp_raw_s = exp_raw if dict(df.dtypes)[expected] == "string" else F.array_join(exp_raw, ";")
    return df.withColumn(out, text_correct(as_answer_list(response), as_answer_list(expected),
                                           resp_raw, exp_raw_s, strict_empty))


def score_expr(answer_type: Column, resp_raw: Column, exp_raw: Column, exp_list: Column,
               resp0: Column, exp0: Column, strict_empty: bool = True,
               exact_only: bool = False) -> Column:
    """E5 dispatch: distance / textual / anything else -> cardinal.

    ``CASE`` evaluates only the taken branch: distance and cardinal rows use
    the first answers as plain strings (generated code); only textual rows
    split and normalise whole lists.
    """
    return (
        F.when(answer_type == DISTANCE, distance_scalar(resp0, exp0))
        .when(answer_type == TEXTUAL, text_correct(split_answers(resp_raw), exp_list, resp_raw,
                                                   exp_raw, strict_empty))
        .otherwise(cardinal_scalar(resp0, exp0, exact_only))
    )


# The judge prompt's labels and closing instruction, verbatim.
JUDGE_LABELS = ("Question reference: ", "\nExpected answer: ", "\nGiven response: ")
JUDGE_INSTRUCTION = ("\n\nDoes the response correctly answer the question based on expected answer? "
                     "Answer strictly 'yes' or 'no'.")


def judge_prompt(question_ref: Column, expected: Column, response: Column) -> Column:
    """Prompt text for the yes/no judge."""
    q, e, r = JUDGE_LABELS
    return F.concat(F.lit(q), question_ref, F.lit(e), expected, F.lit(r), response, F.lit(JUDGE_INSTRUCTION))


def list_repr(arr: Column) -> Column:
    """Render a token list the way the reference's prompt shows it: ``['a', 'b']``.

    Normalised tokens are ``[a-z0-9]`` only, so no quote escaping is needed.
    """
    return F.concat(F.lit("["), F.array_join(F.transform(arr, lambda x: F.concat(F.lit("'"), x, F.lit("'"))),
                                             ", "), F.lit("]"))


def judge_queue(scored: DataFrame, key: list[str] | None = None,
                correct: str = "correct", skipped: bool = False) -> DataFrame:
    """Undecided rows -> judge input ``(keys.., expected, response, prompt)``.

    ``expected``/``response`` are the normalised token lists rendered as the
    reference's prompt renders them.  With ``skipped`` the queue holds every
    undecided row, questions that a model skipped too (null response and
    prompt); otherwise only rows with a response.
    """
    key = key or ["question_ref", "model", "setting"]
    exp = list_repr(normalise_list(as_answer_list("expected_answer")))
    resp = list_repr(normalise_list(as_answer_list("response")))
    queued = F.col(correct).isNull()
    if not skipped:
        queued = queued & F.col("response").isNotNull()
    return (scored.filter(queued)
            .select(*key, exp.alias("expected"), resp.alias("response"))
            .withColumn("prompt", judge_prompt(F.col("question_ref"), F.col("expected"),
                                               F.col("response"))))


def queue_responses(responses: DataFrame, answers: DataFrame, key: str = "question_ref",
                    response: str = "response", strict_empty: bool = True, skipped: bool = False) -> DataFrame:
    """The judge queue of :func:`evaluate`'s rows without evaluating the others:
    only textual questions can be undecided, so they alone are joined, scored
    and queued.  ``skipped``: also the questions that a run gave no response to."""
    run = [c for c in ("model", "setting") if c in responses.columns]
    asked = answers.filter(F.col("answer_type") == TEXTUAL).select(key, "answer_type", "expected_answer")
    given = responses if skipped else responses.filter(F.col(response).isNotNull())
    scored = score_text(given.join(asked, key), response, strict_empty=strict_empty)
    out = judge_queue(scored, [key, *run], skipped=skipped)
    if not skipped:
        return out
    # Rendered once per question, before it is repeated for every run that skipped it.
    if run:
        asked = _unanswered(responses, asked, key, run, responses.join(asked.select(key), key, "left_semi"))
    else:
        asked = asked.join(responses.select(key), key, "left_anti").filter(F.col(key).isNotNull())
    none = asked.withColumn(response, F.lit(None).cast("string"))
    none = judge_queue(score_text(none, response, strict_empty=strict_empty),
                       [key, *(["_skipped"] if run else [])], skipped=True)
    return out.unionByName(_per_run(none, run) if run else none)


def apply_verdicts(scored: DataFrame, verdicts: DataFrame, key: list[str] | None = None,
                   correct: str = "correct", verdict: str = "verdict") -> DataFrame:
    """Join judge verdict text back; undecided rows take ``yes`` -> 1 else 0.

    Rows with no verdict yet, or only null verdicts, stay null (still pending),
    so a partial verdict table never silently scores anything as wrong.
    Several verdicts of one key count as yes only if all of them say yes.
    """
    key = key or ["question_ref", "model", "setting"]
    v = verdicts.groupBy(*key).agg(F.min(yes_verdict(verdict)).alias("_judged"))
    return (scored.join(v, key, "left")
            .withColumn(correct, F.coalesce(F.col(correct), F.col("_judged")))
            .drop("_judged"))


RUN_BITS = 62  # runs in one long of a question's answered runs


def _unanswered(responses: DataFrame, answers: DataFrame, key: str, run: list[str],
                given: DataFrame | None = None) -> DataFrame:
    """``answers`` with ``_skipped``: the runs (models x settings that occur in
    ``responses``) that gave no response to the question.  ``given``: the
    responses to those questions, if they are fewer.

    The runs that answered are bits of a few longs, an aggregate that Spark
    hashes and combines on the map side.  A null in a run equals nothing, so
    such a run always skips.  Without any run a question stands once, with a
    null run."""
    runs = responses.groupBy(*run).agg(F.count(F.lit(1)))
    every = runs.agg(F.array_sort(F.collect_list(F.struct(*run)))).scalar()
    words = -(-runs.count() // RUN_BITS)
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), (i % RUN_BITS).cast("int"))
    word = lambda i: F.floor(i / RUN_BITS).cast("int")
    had = ((responses if given is None else given).select(key, *run).dropna()
           .select(key, (F.array_position(every, F.struct(*run)) - 1).alias("_at")).groupBy(key)
           .agg(*[F.bit_or(F.when(word(F.col("_at")) == w, bit(F.col("_at")))).alias(f"_w{w}") for w in range(words)],
                F.lit(True).alias("_had")))
    bits = F.array(*[F.coalesce(f"_w{w}", F.lit(0)) for w in range(words)] or [F.lit(0)])
    none = F.struct(*[F.lit(None).cast(responses.schema[c].dataType).alias(c) for c in run])
    rest = F.when(F.col("_had").isNull(), F.col("_every")).otherwise(
        F.filter("_every", lambda r, i: F.get("_bits", word(i)).bitwiseAND(bit(i)) == 0))
    return (answers.filter(F.col(key).isNotNull()).join(had, key, "left")
            .withColumn("_every", every).withColumn("_bits", bits)
            .withColumn("_skipped", F.when(F.size("_every") == 0, F.array(none)).otherwise(rest))
            .drop("_every", "_had", "_bits", *[f"_w{w}" for w in range(words)]))


def _per_run(unanswered: DataFrame, run: list[str]) -> DataFrame:
    """A row per skipped run.  (A plain ``explode`` makes Spark test the array's
    size first, which computes the array anew.)"""
    return (unanswered.withColumn("_run", F.explode_outer("_skipped")).filter(F.col("_run").isNotNull())
            .select(*[c for c in unanswered.columns if c != "_skipped"], *[F.col("_run")[c].alias(c) for c in run]))


def evaluate(responses: DataFrame, answers: DataFrame, verdicts: DataFrame | None = None,
             key: str = "question_ref", response: str = "response",
             strict_empty: bool = True, exact_only: bool = False) -> DataFrame:
    """E5: align responses with canonical answers, score in one pass.

    ``responses``: ``question_ref, [model, setting,] response`` (long form).
    ``answers``: ``question_ref, answer_type, expected_answer`` (string or list).
    Every model and setting is measured against *all* answers: a question
    that a model skipped is a row without a response.  Responses and answers
    are each shuffled by question only; what a run skipped follows from the
    set of runs that answered a question, is scored once per question and then
    repeated for those runs.  The set is combined on the map side and the
    responses' join is a left join, which AQE can split, so a question may
    have any number of responses.  Null keys are dropped (P9).  Rows whose
    response is missing score 0 except textual ones, which stay undecided.
    """
    run = [c for c in ("model", "setting") if c in responses.columns]
    exp_is_str = dict(answers.dtypes)["expected_answer"] == "string"
    if exp_is_str:
        exp_list = split_answers("expected_answer")
        exp0 = first_answer("expected_answer")
        exp_raw = F.col("expected_answer")
    else:
        exp_list = F.transform(F.col("expected_answer"), lambda x: ustrip(x))
        exp0 = ustrip(_first(F.col("expected_answer")))
        exp_raw = F.array_join("expected_answer", ";")
    correct = score_expr(F.col("answer_type"), F.col(response), exp_raw, exp_list,
                         first_answer(response), exp0, strict_empty, exact_only)
    if run:
        given = (responses.filter(F.col(key).isNotNull()).join(answers, key, "left")
                 .withColumn("correct", correct))
        order = [key, *run, *[c for c in given.columns if c not in (key, *run)]]
        none = (_unanswered(responses, answers, key, run)
                .withColumn(response, F.lit(None).cast(responses.schema[response].dataType))
                .withColumn("correct", correct))
        out = given.unionByName(_per_run(none, run), allowMissingColumns=True).select(*order)
    else:
        out = align_skew_safe(responses, answers, [key]).filter(F.col(key).isNotNull()).withColumn("correct", correct)
    if verdicts is not None:
        pk = [c for c in ("question_ref", "model", "setting") if c in out.columns]
        out = apply_verdicts(out, verdicts, pk)
    return out
