"""Named forms of the survey's "free" rows.

Each is a single built-in; they exist so a pipeline reads like the
reference's steps.  Filters and projections here push down into scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_answer_type(df: DataFrame, answer_type: str, col: str = "answer_type") -> DataFrame:
    """Rows of one answer type (pushed to the scan as a data filter)."""
    return df.filter(F.col(col) == F.lit(answer_type))


def drop_null_keys(df: DataFrame, key: str | list[str] = "question_ref") -> DataFrame:
    """Drop rows whose key is null."""
    return df.dropna(subset=[key] if isinstance(key, str) else key)


def flag_membership(df: DataFrame, col: str, values: set[str] | list[str], out: str = "is_member") -> DataFrame:
    """Boolean membership in a fixed set (an ``IN`` list, no join)."""
    return df.withColumn(out, F.coalesce(F.col(col).isin(sorted(values)), F.lit(False)))


def drop_excluded(df: DataFrame, name_col: str, excluded: str, positive_col: str) -> DataFrame:
    """``name != excluded and positive > 0``."""
    return df.filter((F.col(name_col) != F.lit(excluded)) & (F.col(positive_col) > 0))


def sort_by_ref(df: DataFrame, key: str = "question_ref") -> DataFrame:
    """Order by the question reference."""
    return df.orderBy(F.col(key).asc())


def write_stats_csv(df: DataFrame, path: str) -> str:
    """Statistics table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path
