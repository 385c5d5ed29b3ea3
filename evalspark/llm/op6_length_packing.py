"""Packing documents into batches from optimal length buckets.

A histogram of lengths is aggregated over all documents.  A dynamic programme
over it picks the bucket bounds with the least padding, exactly, when each
document is padded to its bucket's bound.  Inside a bucket documents are
numbered in a pseudorandom order and cut into batches of as many as the token
budget holds.

The histogram is exact while it has at most ``Settings.cells`` distinct
lengths.  Beyond, lengths are rounded up to the most significant bits that
keep it within that (at least 12, exact up to 4096), so the padding is then the
least among bounds at such lengths; this bounds what the driver holds.  The
numbering uses two-level running totals, so a bucket with a third of all rows
is spread over about sqrt(rows) cells.

The query measures lengths in tokens.  Documents of length 0 or null need no
batch: their bucket, batch and slot are null.  A document longer than the
budget is alone in its batch.  Equal rows get different slots.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import materialise, running_total, table
from evalspark.llm.op4_token_counts import count_tokens, vocabulary

QUERY = "op6_length_packing"
DIGITS = 12  # least significant bits of a length in the histogram


@dataclass(frozen=True)
class Settings:
    buckets: int = 16
    budget: int = 16_384  # tokens of a batch, padding included
    cells: int = 65_536   # distinct lengths of an exact histogram
    seed: int = 23


def histogram_cell(length: Column, digits: int = DIGITS) -> Column:
    """``length`` rounded up to so many significant bits."""
    shift = F.greatest(F.length(F.bin(length)) - digits, F.lit(0))
    unit = F.pow(F.lit(2.0), shift).cast("bigint")
    return (F.ceil(length / unit) * unit).cast("bigint")


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """Rising bucket bounds with the least total padding, and that padding
    (measured from ``lengths``, rising and distinct).

    With C the running count, a bucket over cells i..j-1 costs
    lengths[j-1] * (C[j] - C[i]) less the lengths themselves.  The best start i
    never falls as j rises (the costs have the Monge property), so each layer
    is filled by halving the range of j.
    """
    n = len(lengths)
    if not n:
        return [], 0
    total = np.concatenate([[0], np.cumsum(counts, dtype=object)])
    bound = [int(x) for x in lengths]
    best = [0] + [bound[j - 1] * int(total[j]) for j in range(1, n + 1)]
    total_f, picks = total.astype(np.float64), []
    exact = int(total[-1]) * bound[-1] < 2 ** 53
    count = np.array(total, dtype=np.int64) if exact else total_f
    layer = np.array(best, dtype=count.dtype)
    for _ in range(1, min(buckets, n)):
        fresh, start = layer.copy(), np.zeros(n + 1, dtype=np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            cost = layer[i] + bound[j - 1] * (count[j] - count[i])
            at = int(np.argmin(cost))
            fresh[j], start[j] = cost[at], i[at]
            todo += [(lo, j - 1, first, int(i[at])), (j + 1, hi, int(i[at]), last)]
        picks.append(start)
        layer = fresh
    bounds, j = [], n
    for start in reversed(picks):
        bounds.append(bound[j - 1])
        j = int(start[j])
        if j == 0:
            break
    if j:
        bounds.append(bound[j - 1])
    real = int(sum(int(x) * int(c) for x, c in zip(lengths, counts)))
    return sorted(bounds), int(layer[n]) - real


def histogram(docs: DataFrame, length: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rising lengths and their counts: exact if there are at most ``most``."""
    exact = materialise(docs.filter(F.col(length) > 0).groupBy(F.col(length).cast("bigint").alias("cell"))
                        .agg(F.count(F.lit(1)).alias("n")), "pack-histogram")
    rows, digits = exact, 24
    while rows.limit(most + 1).count() > most and digits >= DIGITS:
        rows = exact.groupBy(histogram_cell(F.col("cell"), digits).alias("cell")).agg(F.sum("n").alias("n"))
        digits -= 4
    rows = rows.orderBy("cell").collect()
    return (np.array([r["cell"] for r in rows], dtype=np.int64),
            np.array([r["n"] for r in rows], dtype=np.int64))


def order_hash(order: list, settings: Settings = Settings()) -> Column:
    return F.xxhash64(*order, F.lit(settings.seed))


def pack(docs: DataFrame, length: str, order: list, settings: Settings = Settings(),
         hashed: Column | None = None) -> DataFrame:
    """``docs`` with bucket (its bound), batch (unique over all buckets, from 0),
    slot (from 0 within the batch) and padding; they replace input columns of
    these names.  ``order`` (hashed) numbers the documents of a bucket.  All
    columns are shuffled, so wide ones are better joined afterwards; ``hashed``
    is an ``order_hash`` taken while they were there."""
    s = settings
    docs = docs.drop("bucket", "batch", "slot", "padding")
    lengths, counts = histogram(docs, length, s.cells)
    bounds, _ = optimal_bounds(lengths, counts, s.buckets)
    if not bounds:
        return docs.select("*", *[F.lit(None).cast("bigint").alias(c)
                                  for c in ("bucket", "batch", "slot", "padding")])
    bucket = F.lit(bounds[-1])
    for b in reversed(bounds[:-1]):  # at most Settings.buckets bounds
        bucket = F.when(F.col(length) <= b, F.lit(b)).otherwise(bucket)
    rows = docs.withColumn("bucket", F.when(F.col(length) > 0, bucket.cast("bigint")))
    cells = max(1, int(counts.sum() ** 0.5))
    ends = np.searchsorted(lengths, bounds, side="right")
    sizes = {b: int(counts[i:j].sum()) for b, i, j in zip(bounds, [0, *ends[:-1]], ends)}
    each, before, at = {}, {}, 0
    for b in bounds:
        each[b] = max(1, s.budget // b)
        before[b] = at
        at += -(-sizes[b] // each[b])
    pick = lambda d: F.create_map(*[F.lit(x).cast("bigint") for kv in d.items() for x in kv])[F.col("bucket")]
    numbered = running_total(
        rows.filter("bucket is not null")
        .withColumn("_h", order_hash(order, s) if hashed is None else hashed)
        .withColumn("_cell", F.pmod("_h", F.lit(cells))),
        ["bucket"], "_cell", ["_h", *order], None, "_n").withColumn("_each", pick(each))
    packed = numbered.select(
        *docs.columns, "bucket", (pick(before) + F.expr("_n div _each")).alias("batch"),
        F.expr("_n % _each").alias("slot"), (F.col("bucket") - F.col(length)).alias("padding"))
    rest = rows.filter("bucket is null").select(
        *docs.columns, "bucket", *[F.lit(None).cast("bigint").alias(c) for c in ("batch", "slot", "padding")])
    return packed.unionByName(rest)


def token_lengths(docs: DataFrame, out: str = "n_tokens") -> DataFrame:
    """``docs`` with the tokens of ``text`` (null: 0), as ``op4`` counts them."""
    return count_tokens(docs, F.coalesce("text", F.lit("")), vocabulary(), out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = token_lengths(table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = materialise(docs.select("doc_id", "n_tokens"), "pack-lengths")
    return pack(docs, "n_tokens", ["doc_id", "n_tokens"])
