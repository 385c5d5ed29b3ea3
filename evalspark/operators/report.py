"""Reports over scored rows and the bank.

Every report aggregates first and only then touches anything driver-side;
the windows here run over *aggregated* rows (a handful of categories), never
over fact-sized data, which is why an unpartitioned window is acceptable in
:func:`category_share` and :func:`arc_layout`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The six spatial relationships, in the reference's report order.
RELATIONSHIPS = ["Border", "Distance", "Equal", "Intersect", "Orientation", "Within"]


def _dedupe_keys(df: DataFrame, key: list[str] | None) -> DataFrame:
    return df.dropDuplicates(key) if key else df


def accuracy(scored: DataFrame, by: list[str], correct: str = "correct",
             key: list[str] | None = None) -> DataFrame:
    """100·mean(correct) per group; undecided rows count as not correct.

    ``n_pending`` reports undecided rows so a missing verdict is visible.
    Denominators are computed, never assumed; pass ``key`` to de-duplicate
    rows first (a resumed run may hold a question twice, §8-D15).
    """
    df = _dedupe_keys(scored, key)
    c = F.col(correct)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias("n_correct"),
        (F.count(F.lit(1)) - F.count(c)).cast("bigint").alias("n_pending"),
        F.round(F.lit(100.0) * F.sum(F.coalesce(c, F.lit(0))) / F.count(F.lit(1)), 6).alias("accuracy"),
    )


def accuracy_by_relationship(scored: DataFrame, by: str = "model",
                             relationship: str = "spatial_relationship",
                             correct: str = "correct", values: list[str] | None = None) -> DataFrame:
    """One row per ``by``, one column per relationship (fixed list → no
    extra pass to discover pivot values)."""
    vals = values or RELATIONSHIPS
    return (scored.groupBy(by).pivot(relationship, vals)
            .agg(F.round(F.lit(100.0) * F.avg(F.coalesce(F.col(correct), F.lit(0))), 6)))


def accuracy_by_tier(scored: DataFrame, by: list[str], tier: str = "tier",
                     correct: str = "correct", tiers: tuple[str, str] = ("all", "partial")) -> DataFrame:
    """Stacked accuracy — correct-in-tier-A and correct-in-tier-B, both
    divided by the *same* total so the stack sums to overall accuracy."""
    c = F.coalesce(F.col(correct), F.lit(0))
    total = F.count(F.lit(1))
    a, b = tiers
    return scored.groupBy(*by).agg(
        total.alias("n"),
        F.round(F.lit(100.0) * F.sum(F.when(F.col(tier) == a, c).otherwise(0)) / total, 6)
        .alias(f"acc_{a}"),
        F.round(F.lit(100.0) * F.sum(F.when(F.col(tier) == b, c).otherwise(0)) / total, 6)
        .alias(f"acc_{b}"),
        F.round(F.lit(100.0) * F.sum(c) / total, 6).alias("acc_total"),
    )


def bank_profile(bank: DataFrame, parent: str = "spatial_relationship",
                 child: str = "map_count") -> DataFrame:
    """Counts per (parent, child) with parent subtotals and a grand total."""
    return (bank.rollup(parent, child)
            .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level")))


def category_share(df: DataFrame, col: str, label_sep: str = "\n") -> DataFrame:
    """Count, share of total and a ``name\\n(n)`` label per category.

    The total is a scalar subquery over the per-category counts (evaluated
    once, no window over a single partition, no join).
    """
    agg = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = agg.agg(F.sum("n")).scalar()
    return agg.select(
        col, "n",
        F.round(F.col("n") / total, 6).alias("share"),
        F.format_string(f"%s{label_sep}(%d)", F.col(col), F.col("n")).alias("label"))


def country_counts(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str,
                   name: str) -> DataFrame:
    """Rows per country plus the number of countries and the total."""
    per = facts.groupBy(fact_key).agg(F.count(F.lit(1)).alias("n"))
    named = per.join(dim.select(F.col(dim_key).alias(fact_key), name), fact_key, "inner")
    return named.select(name, "n", named.agg(F.count(F.lit(1))).scalar().alias("n_countries"),
                        named.agg(F.sum("n")).scalar().alias("n_total"))


def coverage(dim: DataFrame, facts: DataFrame, dim_key: str, fact_key: str) -> DataFrame:
    """Every dimension row with its fact count; missing -> 0.

    Facts are aggregated *before* the join, so only one row per key crosses
    the shuffle (map-side partial aggregation does the rest).
    """
    per = facts.groupBy(F.col(fact_key).alias(dim_key)).agg(F.count(F.lit(1)).alias("n"))
    return dim.join(per, dim_key, "left").withColumn("n", F.coalesce(F.col("n"), F.lit(0)).cast("bigint"))


def unmatched(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str,
              fallback: DataFrame | None = None) -> DataFrame:
    """Fact keys with no dimension row, with an optional fallback lookup."""
    keys = facts.select(fact_key).distinct()
    miss = keys.join(dim.select(F.col(dim_key).alias(fact_key)), fact_key, "left_anti")
    if fallback is None:
        return miss
    return miss.join(fallback, fact_key, "left")


def top_n(df: DataFrame, value: str, name: str, n: int | None = 10) -> DataFrame:
    """Descending by value, ties by name; ``n=None`` = full order."""
    out = df.orderBy(F.col(value).desc(), F.col(name).asc())
    return out.limit(n) if n is not None else out


def longest_first(df: DataFrame, length: Column, tie: str) -> DataFrame:
    """Descending length with an explicit tie-break (Spark sorts are not stable)."""
    return df.orderBy(length.desc(), F.col(tie).asc())


def harmonise_names(df: DataFrame, col: str, mapping: dict[str, str], out: str | None = None) -> DataFrame:
    """Rename only the listed values; others pass through."""
    if not mapping:
        return df.withColumn(out or col, F.col(col))
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v)]
    return df.withColumn(out or col, F.coalesce(F.try_element_at(F.create_map(*kv), F.col(col)), F.col(col)))


def size_curve(scored: DataFrame, models: DataFrame, model: str = "model",
               size: str = "size", correct: str = "correct") -> DataFrame:
    """Accuracy per model size (models is a small dimension table)."""
    return (scored.join(models.select(model, size), model, "inner")
            .groupBy(size).agg(F.round(F.lit(100.0) * F.avg(F.coalesce(F.col(correct), F.lit(0))), 6)
                               .alias("accuracy"), F.count(F.lit(1)).alias("n")))


def local_maxima(curve: DataFrame, x: str, y: str, partition: list[str] | None = None) -> DataFrame:
    """Y >= both neighbours; a missing neighbour compares to itself."""
    w = Window.partitionBy(*(partition or [])).orderBy(x)
    prev_y = F.coalesce(F.lag(y).over(w), F.col(y))
    next_y = F.coalesce(F.lead(y).over(w), F.col(y))
    return curve.withColumn("is_local_max", (F.col(y) >= prev_y) & (F.col(y) >= next_y))


def _rank_in(col: str, order: list[str] | None) -> Column:
    """Sort key: position in an explicit list (unlisted values last), else the value."""
    if not order:
        return F.col(col)
    kv = []
    for i, v in enumerate(order):
        kv += [F.lit(v), F.lit(i)]
    return F.coalesce(F.try_element_at(F.create_map(*kv), F.col(col)), F.lit(len(order)))


def arc_layout(profile: DataFrame, parent: str, child: str, n: str = "n", start: float = 90.0,
               parent_order: list[str] | None = None, child_order: list[str] | None = None) -> DataFrame:
    """Clockwise start/end angles (degrees) for parents, children split
    their parent's span.  Input is the small (parent, child, n) profile.

    Parents and children follow ``parent_order``/``child_order`` when given
    (the reference lists Single before Multi), else their names.
    """
    parents = profile.groupBy(parent).agg(F.sum(n).alias("p_n"))
    wp = Window.orderBy(_rank_in(parent, parent_order), F.col(parent)) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("p_n").over(Window.partitionBy())
    parents = parents.select(
        parent, "p_n",
        (F.lit(start) - F.lit(360.0) * (F.sum("p_n").over(wp) - F.col("p_n")) / total).alias("p_start"),
        (F.lit(start) - F.lit(360.0) * F.sum("p_n").over(wp) / total).alias("p_end"))
    wc = Window.partitionBy(parent).orderBy(_rank_in(child, child_order), F.col(child)) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    span = F.col("p_start") - F.col("p_end")
    return (profile.join(parents, parent, "inner").select(
        parent, child, F.col(n).alias("n"),
        F.round("p_start", 6).alias("p_start"), F.round("p_end", 6).alias("p_end"),
        F.round(F.col("p_start") - span * (F.sum(n).over(wc) - F.col(n)) / F.col("p_n"), 6)
        .alias("c_start"),
        F.round(F.col("p_start") - span * F.sum(n).over(wc) / F.col("p_n"), 6).alias("c_end")))


def log_scale(c: Column, base: float | None = None) -> Column:
    """Natural log by default; the base is explicit."""
    return F.ln(c) if base is None else F.log(float(base), c)


def exact_quantiles(values: DataFrame, col: str, probs: tuple[float, ...]) -> list[float]:
    """Exact linear-interpolation quantiles without gathering the column.

    Only the (at most ``2·len(probs)``) values at the needed ranks reach the
    driver; they are found over counted values (:func:`stats.select_ranks`).
    """
    from evalspark.operators.stats import select_ranks
    v = values.select(F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    n = v.count()
    if n == 0:
        return []
    pos = [(n - 1) * p for p in probs]
    need = sorted({int(math.floor(h)) + 1 for h in pos} | {int(math.ceil(h)) + 1 for h in pos})
    wanted = values.sparkSession.createDataFrame([(0, r) for r in need], "_k int, rank bigint")
    at = {r["rank"]: r["_v"] for r in select_ranks(v.withColumn("_k", F.lit(0)), wanted, "_k", "_v").collect()}
    out = []
    for h in pos:
        lo, hi = at[int(math.floor(h)) + 1], at[int(math.ceil(h)) + 1]
        out.append(lo + (hi - lo) * (h - math.floor(h)))
    return out


def quantile_bins(values: DataFrame, col: str,
                  probs: tuple[float, ...] = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0),
                  approx_accuracy: int | None = None) -> DataFrame:
    """Bin edges over positive values, one row per edge (``edge``).

    Exact linear interpolation (numpy's default), distinct edges; when at most
    two distinct edges remain the distinct positive values are the edges
    instead; ``[0, 1]`` when there are no positives.  Quantiles come from a
    distributed rank selection (:func:`exact_quantiles`), so no task ever holds the
    whole column; the fallback edges stay a distributed ``distinct``.
    ``approx_accuracy`` opts into ``percentile_approx`` (one pass, bounded
    sketch) instead; never the default.
    """
    spark = values.sparkSession
    pos = values.filter(F.col(col) > 0).select(F.col(col).cast("double").alias("edge"))
    if approx_accuracy:
        row = pos.agg(F.percentile_approx("edge", list(probs), approx_accuracy).alias("q"),
                      F.count(F.lit(1)).alias("n")).first()
        q = list(row["q"]) if row["n"] else []
    else:
        q = exact_quantiles(pos, "edge", probs)
    if not q:
        return spark.createDataFrame([(0.0,), (1.0,)], "edge double")
    uniq = sorted(set(q))
    if len(uniq) > 2:
        return spark.createDataFrame([(float(x),) for x in uniq], "edge double")
    return pos.distinct()
