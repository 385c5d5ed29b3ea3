"""Annotator assignment and page navigation.

Ordinals come from :mod:`evalspark.operators.ordinals` (range-partitioned,
never an unpartitioned window).  Navigation (next page, resume pointer) is an
equi-join on ``(user, position)`` rather than a ``lead`` over a per-user
window, so a user holding a third of all pages is still spread over many
tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.assets import THANK_YOU_PAGE, page_name, progress_label
from evalspark.operators.ordinals import broadcast_if_small, global_ordinal, group_ordinal


def roster_ordinals(roster: DataFrame, order: list | None = None) -> tuple[DataFrame, int]:
    """Roster with 0-based ``user_idx`` in ``order`` (default ``user_id``) and its size."""
    n = roster.count()
    if n == 0:
        raise ValueError("roster is empty — need at least one user")
    r = global_ordinal(roster, order or ["user_id"], out="_o")
    return r.withColumn("user_idx", F.col("_o") - 1).drop("_o"), n


def assign_round_robin(questions: DataFrame, roster: DataFrame, r: int = 2,
                       ordinal: str = "ordinal", roster_order: list | None = None) -> DataFrame:
    """Slot ``k`` of question ``i`` (0-based) -> user ``(i*r + k) mod n``.

    ``questions`` must carry a 1-based ``ordinal`` (see ``number_questions``):
    numbering happens *before* slots are expanded.  With fewer users than
    slots a user repeats on one question (D21); ``user_repeated`` reports it.
    Output: ``question_ref, ordinal, slot, user_id, user_repeated``.
    """
    if r < 1:
        raise ValueError("r must be >= 1")
    users, n = roster_ordinals(roster, roster_order)
    slots = questions.select("question_ref", ordinal,
                             F.explode(F.sequence(F.lit(0), F.lit(r - 1))).alias("slot"))
    slots = slots.withColumn("user_idx", F.pmod((F.col(ordinal) - 1) * F.lit(r) + F.col("slot"), F.lit(n)))
    return (slots.join(broadcast_if_small(users.select("user_idx", "user_id")), "user_idx", "inner")
            .select("question_ref", F.col(ordinal).alias("ordinal"), "slot", "user_id",
                    F.lit(n < r).alias("user_repeated")))


def page_ordinals(assignments: DataFrame) -> DataFrame:
    """Per user, pages in question order: ``page_idx``, ``n_pages``, ``Qk/total``."""
    pages = group_ordinal(assignments, ["user_id"], ["ordinal", "slot"], out="page_idx",
                          total="n_pages")
    return pages.select(
        "user_id", "question_ref", "ordinal", "slot", "page_idx", "n_pages",
        page_name(F.col("user_id"), F.col("question_ref")).alias("page"),
        progress_label(F.col("page_idx"), F.col("n_pages")).alias("progress"))


def next_page(pages: DataFrame, base_url: str | None = None) -> DataFrame:
    """The next page in the user's order, else the thank-you page."""
    nxt = pages.select("user_id", (F.col("page_idx") - 1).alias("page_idx"), F.col("page").alias("_next"))
    out = pages.join(nxt, ["user_id", "page_idx"], "left").withColumn(
        "next_page", F.coalesce(F.col("_next"), F.lit(THANK_YOU_PAGE))).drop("_next")
    if base_url:
        out = out.withColumn("next_url", F.concat(F.lit(base_url.rstrip("/") + "/"), F.col("next_page")))
    return out


def resume_pointer(pages: DataFrame, answered: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Where a returning user lands.

    One after the *last answered* page (gaps are not revisited); nothing
    answered -> first page; last page answered -> that page; a user without
    pages -> the thank-you page.  ``answered`` holds ``(user_id, question_ref)``.
    """
    done = pages.join(answered.select("user_id", "question_ref").distinct(),
                      ["user_id", "question_ref"], "left_semi")
    last = done.groupBy("user_id").agg(F.max("page_idx").alias("_last"))
    per_user = pages.groupBy("user_id").agg(F.max("n_pages").alias("_n"))
    target = (per_user.join(last, "user_id", "left")
              .select("user_id", F.when(F.col("_last").isNull(), F.lit(1))
                      .otherwise(F.least(F.col("_last") + 1, F.col("_n"))).cast("bigint").alias("page_idx")))
    landed = target.join(pages.select("user_id", "page_idx", "page"), ["user_id", "page_idx"], "inner")
    if users is not None:
        landed = users.select("user_id").distinct().join(landed, "user_id", "left")
    return landed.select("user_id", "page_idx",
                         F.coalesce(F.col("page"), F.lit(THANK_YOU_PAGE)).alias("resume_page"))


def workload(assignments: DataFrame, roster: DataFrame) -> DataFrame:
    """Pages per user including users with none (aggregate, then join)."""
    per = assignments.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_pages"))
    return (roster.select("user_id").join(per, "user_id", "left")
            .withColumn("n_pages", F.coalesce(F.col("n_pages"), F.lit(0)).cast("bigint")))
