import itertools
import random
from collections import Counter

import numpy as np
import pytest
from llm_cases import no_docs, odd_docs
from pyspark.sql import functions as F

from evalspark.llm import op6_length_packing as op


def test_bounds_are_optimal():
    r = random.Random(2)
    for _ in range(300):
        n, k = r.randint(1, 9), r.randint(1, 6)
        lengths, counts = sorted(r.sample(range(1, 60), n)), [r.randint(1, 20) for _ in range(n)]

        def padding(bounds):
            return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))
        best = min(padding((*some, lengths[-1])) for m in range(min(k, n))
                   for some in itertools.combinations(lengths[:-1], m))
        bounds, cost = op.optimal_bounds(np.array(lengths), np.array(counts), k)
        assert padding(bounds) == cost == best and len(bounds) <= k


def test_histogram_cells(spark):
    lengths = [1, 2, 4095, 4096, 4097, 8191, 8192, 8193, 10 ** 9, 3 * 10 ** 12 + 1]
    df = spark.createDataFrame([(x,) for x in lengths], "n bigint").select("n", op.histogram_cell(F.col("n")).alias("c"))
    for r in df.collect():
        assert r["n"] <= r["c"] <= r["n"] * (1 + 2 ** -11)
        assert r["n"] > 4096 or r["c"] == r["n"]


def test_long_lengths_are_exact_and_compressed_only_beyond_the_cells(spark):
    lengths = [5000 + 7 * i for i in range(400)] + [20_000 + i * i for i in range(50)]
    df = spark.createDataFrame([(x,) for x in lengths], "n bigint")
    got, counts = op.histogram(df, "n", 450)
    assert got.tolist() == lengths and set(counts.tolist()) == {1}
    want, padding = op.optimal_bounds(np.array(lengths), np.ones(450, dtype=int), 16)
    rows = op.pack(df, "n", ["n"]).collect()
    assert sorted({r["bucket"] for r in rows}) == want and sum(r["padding"] for r in rows) == padding
    for most in (449, 100):
        cells, counts = op.histogram(df, "n", most)
        assert counts.sum() == 450 and (len(cells) <= most or len(cells) <= 3 * 2048)
        assert all(r["padding"] >= 0 for r in op.pack(df, "n", ["n"], op.Settings(cells=most)).collect())


@pytest.mark.parametrize("budget", [50, 1000])
def test_batches_hold_the_budget(spark, budget):
    df = spark.range(3000).select(F.col("id").alias("doc_id"),
                                  F.when(F.col("id") % 3 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(90)))
                                  .cast("bigint").alias("n"))
    s = op.Settings(buckets=5, budget=budget)
    rows = op.pack(df, "n", ["doc_id"], s).collect()
    assert len(rows) == 3000
    packed = [r for r in rows if r["n"] > 0]
    assert all(r["batch"] is None for r in rows if r["n"] == 0)
    counts = Counter(r["n"] for r in packed)
    bounds = op.optimal_bounds(np.array(sorted(counts)), np.array([counts[x] for x in sorted(counts)]), 5)[0]
    groups = {}
    for r in packed:
        assert r["bucket"] == min(b for b in bounds if b >= r["n"]) and r["padding"] == r["bucket"] - r["n"]
        groups.setdefault(r["batch"], []).append(r)
    assert sorted(groups) == list(range(len(groups)))
    short = Counter()
    for own in groups.values():
        size = max(1, budget // own[0]["bucket"])
        assert len({r["bucket"] for r in own}) == 1 and sorted(r["slot"] for r in own) == list(range(len(own)))
        assert len(own) <= size
        short[own[0]["bucket"]] += len(own) < size
    assert max(short.values()) <= 1  # only a bucket's last batch may be short
    again = op.pack(df.repartition(7), "n", ["doc_id"], s).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, rows), key=str)


def test_odd_rows(spark):
    docs = op.token_lengths(odd_docs(spark), "n")
    rows = op.pack(docs, "n", ["doc_id", "text"]).collect()
    assert len(rows) == docs.count()
    assert all((r["batch"] is None) == (r["n"] == 0) for r in rows)
    assert len({(r["batch"], r["slot"]) for r in rows if r["n"]}) == sum(r["n"] > 0 for r in rows)
    assert op.pack(docs.filter("n = 0"), "n", ["doc_id"]).filter("batch is not null").count() == 0
    assert op.pack(no_docs(spark).withColumn("n", F.lit(1)), "n", ["doc_id"]).count() == 0
    nulls = docs.withColumn("n", F.lit(None).cast("bigint"))
    assert op.pack(nulls, "n", ["doc_id"]).filter("batch is null").count() == docs.count()
