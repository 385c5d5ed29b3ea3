"""Annotation validation, normalisation and de-duplication (P10, P11, R2 core)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.text import ustrip

# The accepted form vocabularies and field lengths of the store.
VALIDITY = ["Can be answered", "Map doesn't contain information to answer the question"]
NOINFO = VALIDITY[1]
MAP_COUNT = ["Single", "Multi"]
SPATIAL = ["Border", "Distance", "Equal", "Orientation", "Intersect", "Within"]
NECESSARY = ["yes", "no"]
MAX_LEN = {"user": 64, "question_ref": 64, "validity": 128, "map_count": 8,
           "spatial_relationship": 16, "necessary": 3}


def normalise_necessary(c) -> Column:
    """``Yes``/``yes`` -> ``yes``; '' -> null (older exports)."""
    x = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.trim(x)), F.lit(""))


def rejection_reasons(df: DataFrame) -> Column:
    """P10: array of reason codes; empty array = accepted.

    Required in-domain ``validity``, ``map_count``, ``spatial_relationship``;
    optional ``necessary`` in (yes, no, '', null); a reason is mandatory with
    "no information" (D20); field lengths; non-blank trimmed ``user`` and
    ``question_ref``.
    """
    def bad(cond: Column, code: str) -> Column:
        return F.when(F.coalesce(cond, F.lit(True)), F.lit(code))

    user, ref = ustrip(F.col("user")), ustrip(F.col("question_ref"))
    checks = [
        bad(user == "", "user_missing"),
        bad(ref == "", "question_ref_missing"),
        F.when(~F.coalesce(F.col("validity").isin(VALIDITY), F.lit(False)), F.lit("validity")),
        F.when(~F.coalesce(F.col("map_count").isin(MAP_COUNT), F.lit(False)), F.lit("map_count")),
        F.when(~F.coalesce(F.col("spatial_relationship").isin(SPATIAL), F.lit(False)),
               F.lit("spatial_relationship")),
        F.when(F.col("necessary").isNotNull() & (F.col("necessary") != "")
               & ~F.col("necessary").isin(NECESSARY), F.lit("necessary")),
        F.when((F.col("validity") == NOINFO)
               & (F.coalesce(ustrip(F.col("noinfo_reason")), F.lit("")) == ""), F.lit("noinfo_reason")),
    ]
    for c, n in MAX_LEN.items():
        x = {"user": user, "question_ref": ref}.get(c, F.col(c))
        checks.append(F.when(F.length(x) > n, F.lit(f"{c}_too_long")))
    return F.array_compact(F.array(*checks))


def validate_annotation(df: DataFrame) -> DataFrame:
    """Adds ``reasons`` and ``accepted``; ``user`` and ``question_ref`` stripped."""
    return (df.withColumn("reasons", rejection_reasons(df))
            .withColumn("accepted", F.size("reasons") == 0)
            .withColumn("user", ustrip(F.col("user")))
            .withColumn("question_ref", ustrip(F.col("question_ref"))))


def first_write_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Within one batch: keep the earliest row per key, flag the rest.

    Adds ``duplicate`` (bool).  The earliest row per key is found with a
    ``min(struct(order.., row))`` aggregate (combined map-side), not a window,
    so a key flooded with posts is never sorted inside one task.
    """
    rowed = df.withColumn("_row", F.monotonically_increasing_id())
    best = rowed.groupBy(*key).agg(F.min(F.struct(*[F.col(c) for c in order], F.col("_row"))).alias("_b"))
    return (rowed.join(best.select(*key, F.col("_b._row").alias("_win")), key, "inner")
            .withColumn("duplicate", F.col("_row") != F.col("_win")).drop("_row", "_win"))
