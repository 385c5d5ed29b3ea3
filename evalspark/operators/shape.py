"""Table shaping: align joins, unpivot, diagonal union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESPONSE_SUFFIX = "_response"


def _q(name: str) -> str:
    """Backtick-quote a column name (``vlm2.5_response`` holds a dot)."""
    return "`" + name.replace("`", "``") + "`"


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in set(right.columns)]


def align(left: DataFrame, right: DataFrame, on: list[str] | None = None,
          sort: bool = False) -> DataFrame:
    """Full outer equi-join on all shared column names, keys coalesced.

    SQL null semantics: a null key matches nothing (D12).  ``sort=True`` adds
    the reference's final sort by key (a range shuffle; leave it off when the
    consumer does not need ordered output).
    """
    keys = on or shared_columns(left, right)
    if not keys:
        raise ValueError("align needs at least one shared column")
    out = left.join(right, on=keys, how="full")
    return out.orderBy(*keys) if sort else out


def align_skew_safe(facts: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
    """Full outer align of a (possibly skewed) fact side with a one-row-per-key
    side, as a left join plus the unmatched keys.

    AQE can split a skewed key's partition for a left outer join (the fact
    side) but not for a full outer join; the unmatched ``dim`` rows come from
    an anti join against the *distinct* fact keys (partially aggregated, so a
    hot key is one row).  Same rows as ``join(how="full")``.
    """
    matched = facts.join(dim, on=on, how="left")
    unmatched = dim.join(facts.select(*on).distinct(), on=on, how="left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def align_left(left: DataFrame, right: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Left join on all shared column names."""
    keys = on or shared_columns(left, right)
    if not keys:
        raise ValueError("align_left needs at least one shared column")
    return left.join(right, on=keys, how="left")


def response_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith(RESPONSE_SUFFIX)]


def resolve_response_column(df: DataFrame, name: str | None = None,
                            out: str = "_response") -> DataFrame:
    """P5: use ``name`` if present, else the first ``*_response`` column.

    Schema inspection only (driver-side metadata, no data read).
    """
    col = name if name and name in df.columns else next(iter(response_columns(df)), None)
    if col is None:
        raise ValueError("No response column found matching pattern '*_response'")
    return df.withColumnRenamed(col, out)


def melt_responses(df: DataFrame, ids: list[str] | None = None, model: str = "model",
                   value: str = "response") -> DataFrame:
    """Every ``<model>_response`` column -> long ``(ids.., model, response)``.

    ``unpivot`` is a narrow ``Expand``: no shuffle.  The model name is the
    column name without the suffix.
    """
    cols = response_columns(df)
    if not cols:
        raise ValueError("no *_response columns to melt")
    ids = ids or [c for c in df.columns if c not in cols]
    names = [c[: -len(RESPONSE_SUFFIX)] for c in cols]
    renamed = df.select(*[F.col(_q(c)) for c in ids],
                        *[F.col(_q(c)).cast("string").alias(n) for c, n in zip(cols, names)])
    return renamed.unpivot(ids, [F.col(_q(n)) for n in names], model, value)


def diagonal_union(frames: list[DataFrame]) -> DataFrame:
    """Union by name over a list, missing columns -> null (one plan, no loop-append of data)."""
    if not frames:
        raise ValueError("nothing to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_contextual(bank: DataFrame, variants: dict[str, DataFrame], key: str = "question_ref",
                     column: str = "contextual_urls") -> DataFrame:
    """One full bank copy per distractor variant, long form with ``variant``.

    Each variant table is ``(key, contextual_urls)``.  Like the reference's
    per-variant ``align``, every bank question appears once per variant (null
    list when the variant lacks it) and variant-only questions are kept.  The
    bank is expanded by the (few, fixed) variant names and full-outer joined
    with all variants at once on ``(key, variant)``: one shuffle, not one per
    variant.  Any stale ``contextual_urls`` on the bank side is replaced.
    """
    base = bank.drop(column) if column in bank.columns else bank
    names = list(variants)
    expanded = base.withColumn("variant", F.explode(F.array(*[F.lit(n) for n in names])))
    parts = [v.select(key, column).withColumn("variant", F.lit(name)) for name, v in variants.items()]
    return align(expanded, diagonal_union(parts), on=[key, "variant"])
