"""Distributed ordinals (W1, W6, P8) and a size-checked broadcast.

An unpartitioned ``row_number()`` window pulls every row into one task.  Here
a global ordinal is computed the way ``zipWithIndex`` does it, but on
DataFrames: range-partition on the order key, sort within partitions, count
rows per partition (one tiny row per partition), turn the counts into
offsets, broadcast the offsets (bounded by the partition count) and add the
within-partition position.  The staged frame is checkpointed to the shared
checkpoint folder so the range bounds are sampled exactly once and a lost
executor cannot reshuffle rows between the count and the numbering.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.session import cut_lineage

_LOW_BITS = 33  # monotonically_increasing_id: partition id << 33 | record number
DEFAULT_BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only if it provably has at most ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows; above the bound the plain
    frame is returned and the join shuffles (AQE may still convert it from
    measured sizes, and splits skewed partitions).
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def _cols(order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def global_ordinal(df: DataFrame, order: list, out: str = "ordinal",
                   num_partitions: int | None = None) -> DataFrame:
    """1-based position of each row in ``order`` (keys should be unique)."""
    order_cols = _cols(order)
    # Without an explicit count AQE may coalesce *adjacent* range partitions
    # by measured size (order is kept); the checkpoint fixes the result.
    ranged = (df.repartitionByRange(num_partitions, *order_cols) if num_partitions
              else df.repartitionByRange(*order_cols))
    staged = (ranged.sortWithinPartitions(*order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    staged = cut_lineage(staged)
    counts = staged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: the window runs over at most ``n`` rows.
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), _LOW_BITS)
    return (staged.join(F.broadcast(offsets), "_pid", "inner")
            .withColumn(out, (F.col("_off") + pos + 1).cast("bigint"))
            .drop("_pid", "_mid", "_off"))


def group_ordinal(df: DataFrame, group: list[str], order: list, out: str = "ordinal",
                  total: str | None = None) -> DataFrame:
    """1-based position within each group, skew-safe; null groups are groups too.

    The global ordinal over ``(group, order)`` spreads a hot group across many
    range partitions; each group's first ordinal and size come from one
    aggregate (map-side combined) joined back on the group key.
    """
    g = global_ordinal(df, [*group, *order], out="_g")
    starts = g.groupBy(*[F.col(c).alias(f"_of_{c}") for c in group]).agg(
        F.min("_g").alias("_start"), F.count(F.lit(1)).alias("_total"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group])
    # one row per group: AQE broadcasts it when small, else splits skewed keys
    res = (g.join(starts, same, "inner").drop(*[f"_of_{c}" for c in group])
           .withColumn(out, F.col("_g") - F.col("_start") + 1))
    if total:
        res = res.withColumnRenamed("_total", total)
    return res.drop("_g", "_start", "_total")


def number_questions(df: DataFrame, order: list, start: int = 1, fmt: str = "q_%04d",
                     out: str = "question_ref") -> DataFrame:
    """``q_%04d`` numbering in ``order`` starting at ``start``."""
    o = global_ordinal(df, order, out="_ord")
    return (o.withColumn(out, F.format_string(fmt, F.col("_ord") + F.lit(start - 1)))
            .withColumnRenamed("_ord", "ordinal"))


def batch_id(df: DataFrame, order: list, size: int, out: str = "batch_id") -> DataFrame:
    """Fixed-size chunks in ``order``: ``floor((ordinal-1)/size)``."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    o = global_ordinal(df, order, out="_ord")
    return o.withColumn(out, F.floor((F.col("_ord") - 1) / F.lit(size)).cast("bigint")).drop("_ord")


def shard_rows(df: DataFrame, order: list, start: int = 0, last: int | None = None) -> DataFrame:
    """Rows ``start <= i < last`` (0-based) of the stable order; falsy ``last`` = all.

    The reference slices by position; a stable ordinal replaces position, so a
    shard is the same rows on every run and never relies on ``limit/offset``.
    """
    if not last:
        return df
    o = global_ordinal(df, order, out="_ord")
    return o.filter((F.col("_ord") > start) & (F.col("_ord") <= last)).drop("_ord")
