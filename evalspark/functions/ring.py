"""Compass-direction ring used by the cardinal scorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The eight directions in ring order, as the reference lists them.
DIRECTIONS = ["North", "North East", "East", "South East",
              "South", "South West", "West", "North West"]


def accepted_for(index: int, exact_only: bool = False) -> list[str]:
    """The direction itself, then its two ring neighbours."""
    n = len(DIRECTIONS)
    if exact_only:
        return [DIRECTIONS[index]]
    return [DIRECTIONS[index], DIRECTIONS[(index + n - 1) % n], DIRECTIONS[(index + 1) % n]]


def ring_map(exact_only: bool = False) -> Column:
    """``map<string, array<string>>`` literal: expected -> accepted answers.

    Eight keys; a literal map is constant-folded into the projection, so the
    lookup costs no join at all.
    """
    kv = []
    for i, d in enumerate(DIRECTIONS):
        kv += [F.lit(d), F.array(*[F.lit(x) for x in accepted_for(i, exact_only)])]
    return F.create_map(*kv)


def accepted_directions(expected, exact_only: bool = False) -> Column:
    """Accepted answers for ``expected``; unknown -> ``[expected]``."""
    e = F.col(expected) if isinstance(expected, str) else expected
    return F.coalesce(F.try_element_at(ring_map(exact_only), e), F.array(e))


def ring_table(spark: SparkSession, exact_only: bool = False) -> DataFrame:
    """The 24-row (expected, accepted) table (8 rows when exact only)."""
    rows = [(d, a) for i, d in enumerate(DIRECTIONS) for a in accepted_for(i, exact_only)]
    return spark.createDataFrame(rows, "expected string, accepted string")
