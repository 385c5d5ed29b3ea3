"""A store of answered keys that grows without slowing down its readers.

``AnsweredKeys`` keeps the keys of stored answers apart from the answers, as a
table bucketed and sorted by key.  A batch asks which of its keys are stored:
the batch is dealt like the buckets, and the history is read as it lies,
without a shuffle.  A batch of few keys reads the buckets of its own keys
only.  The number of buckets follows the table: once a bucket would hold more
than ``per_bucket`` keys on average, the table is written anew with four times
as many.

Each number of buckets has its own folder, and the largest whole one counts,
so a rewrite that dies half-way leaves the old table in force.  Keys may be
stored twice (a replayed batch); asking does not mind.  Null keys are never
stored and never answered.  The session's catalog gets an entry for the folder,
which holds nothing that the folder does not.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.session import read_if_exists

FEW_KEYS = 1_000   # keys of a batch that are named in the scan's filter, at most
GROWTH = 4


class AnsweredKeys:
    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...] = ("question_ref",), types: tuple[str, ...] = ("string",),
                 buckets: int = 8, per_bucket: int = 1_000_000):
        self.spark, self.path, self.key, self.types = spark, path.rstrip("/"), list(key), list(types)
        self.first, self.per_bucket = buckets, per_bucket

    def _log(self) -> DataFrame | None:
        return read_if_exists(self.spark, f"{self.path}/log")

    def _state(self) -> tuple[int, int]:
        """(buckets of the table in force, keys written to it)."""
        log = self._log()
        if log is None:
            return self.first, 0
        row = log.groupBy("buckets").agg(F.sum("keys").alias("n")).orderBy(F.col("buckets").desc()).first()
        return row["buckets"], row["n"]

    def _note(self, buckets: int, keys: int) -> None:
        self.spark.createDataFrame([(buckets, keys)], "buckets int, keys bigint").coalesce(1) \
            .write.mode("append").parquet(f"{self.path}/log")

    def _table(self, buckets: int) -> str:
        """The name of the bucketed table, declared in this session if need be."""
        where = f"{self.path}/buckets_{buckets}"
        name = f"answered_{hashlib.md5(where.encode()).hexdigest()[:16]}"
        columns = ", ".join(f"`{c}` {t}" for c, t in zip(self.key, self.types))
        by = ", ".join(f"`{c}`" for c in self.key)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
                       f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{where}'")
        self.spark.catalog.refreshTable(name)  # another session may have added files
        return name

    def table(self) -> DataFrame:
        return self.spark.table(self._table(self._state()[0]))

    def add(self, rows: DataFrame) -> None:
        """Store the keys of ``rows``."""
        keys = rows.select(*self.key).dropna().distinct()
        buckets, n = self._state()
        name = self._table(buckets)
        before = self.spark.table(name)
        path = f"{self.path}/batches"
        keys.write.mode("overwrite").parquet(path)  # counted and stored as one
        keys = self.spark.read.parquet(path)
        more = keys.count()
        if n + more > buckets * self.per_bucket:
            while n + more > buckets * self.per_bucket:
                buckets *= GROWTH
            self._write(before.unionByName(keys).distinct(), buckets, "overwrite")
            self._note(buckets, n + more)
        elif more:
            self._write(keys, buckets, "append")
            self._note(buckets, more)

    def _write(self, keys: DataFrame, buckets: int, mode: str) -> None:
        name = self._table(buckets)
        dealt = keys.repartition(buckets, *self.key)  # one file per bucket and batch
        (dealt.write.mode(mode).bucketBy(buckets, *self.key).sortBy(*self.key).format("parquet")
         .option("path", f"{self.path}/buckets_{buckets}").saveAsTable(name))

    def stored(self, batch: DataFrame) -> DataFrame:
        """The distinct keys of ``batch`` that are stored."""
        asked = batch.select(*self.key).dropna().distinct()
        known = self.table()
        few = asked.limit(FEW_KEYS + 1).collect() if len(self.key) == 1 else None
        if few is not None and len(few) <= FEW_KEYS:
            known = known.filter(F.col(self.key[0]).isin([r[0] for r in few]))
        return asked.join(known.hint("merge"), self.key, "left_semi")

    def pending(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` whose key is not stored (a null key never is)."""
        return batch.join(self.stored(batch), self.key, "left_anti")
