"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.session import ensure_checkpoint_dir, scratch_path

# What a Python worker keeps between tasks; the next operator's tasks clear it.
KEPT: dict = {}

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_arrow_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound the bytes of an Arrow batch, so that a Python worker's memory does
    not follow the row width.  One row larger than the bound still travels
    alone."""
    spark.conf.set(ARROW_BYTES, size)


def written(df: DataFrame, name: str) -> str:
    """Write ``df`` as Parquet to a fresh place in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts the lineage and
    survives lost executors, like ``checkpoint()``, but columnar)."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


@contextmanager
def session_conf(spark: SparkSession, **settings: str):
    """Set session options for one action and put the old values back."""
    keys = {k.replace("__", "."): v for k, v in settings.items()}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def crc_fold(doc_id: str, mod: int) -> Column:
    """``crc32`` of the id's decimal text, modulo ``mod``; a null id is fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(mod), F.lit(0))


def running_total(df: DataFrame, group: list[str], cell: str, order: list, value: str | None,
                  out: str) -> DataFrame:
    """Exclusive running sum of ``value`` (None: a 0-based row number) within
    each ``group``, in the order (``cell``, ``order``).

    Two levels keep every task small: a window per (group, cell), and a window
    over the cell sums of a group.  Callers choose about sqrt(rows) cells, so a
    group with a third of all rows is spread over that many tasks.  The join
    back reuses the (group, cell) partitioning of the first window.
    """
    key = [*group, cell]
    amount = F.lit(1).cast("bigint") if value is None else F.col(value)
    within = (Window.partitionBy(*key).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_in", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    sums = df.groupBy(*key).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(cell) if group else Window.orderBy(cell)
    sums = sums.select(
        *[F.col(c).alias(f"_k_{c}") for c in key],
        F.coalesce(F.sum("_sum").over(before.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"))
    same = None
    for c in key:
        eq = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        same = eq if same is None else same & eq
    return (rows.join(sums, same, "left")
            .withColumn(out, (F.col("_before") + F.col("_in")).cast("bigint"))
            .drop("_before", "_in", *[f"_k_{c}" for c in key]))


def unit_uniform(*cols) -> Column:
    """A reproducible number in [0, 1) from a 64-bit hash of the columns."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double")
            * F.lit(2.0 ** -53))
