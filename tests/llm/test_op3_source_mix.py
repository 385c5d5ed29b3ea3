import re

import pytest
from llm_cases import SF, no_docs, odd_docs
from pyspark.sql import functions as F

from evalspark.llm import op3_source_mix as op


def water(sizes):
    """Targets by plain resharing."""
    names = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + [None] * (None in sizes)
    weight = {k: i % 3 + 1 for i, k in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [k for k in names if k not in capped]
        left = total - sum(3 * sizes[k] for k in capped)
        rate = left / sum(weight[k] for k in free) if free else 0
        more = {k for k in free if rate * weight[k] > 3 * sizes[k]}
        if not more:
            return {k: 3 * sizes[k] if k in capped else rate * weight[k] for k in names}
        capped |= more


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 500, "c": 7, None: 90}, {"x": 5}, {"a": 1, "b": 1, "c": 10_000},
                                   {"a": 0, "b": 3, "é": 4, "Z": 100}])
def test_targets_match_plain_resharing(spark, sizes):
    got = {r["source"]: r["target"] for r in op.targets(
        spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
    assert got == pytest.approx(water(sizes))


@pytest.mark.parametrize("size", [1, 2, 7, 100, 1023])
def test_permutation(spark, size):
    x = spark.range(size).select(op.permuted(F.col("id"), F.lit(size), F.lit(3), rounds=16).alias("x"))
    got = [r["x"] for r in x.collect()]
    assert sorted(got) == list(range(size))
    assert size < 100 or got != sorted(got)


def test_mix_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = op.mix(docs, carry=("n_chars",))
    rows = op.taken_words(mixed).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    sizes = {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) and r["taken"] <= 3 * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = water(sizes)
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        assert all(r["target"] == pytest.approx(want[s]) for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) < 0.05 * want[s] + 5
    again = {r["doc_id"]: r["taken"] for r in op.taken_words(op.mix(docs.repartition(5))).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    # No block is used twice in a pass, and shards are equally large but for the last.
    spans = mixed.spans.select("slot", "shard").distinct().groupBy("shard").count().collect()
    assert max(r["count"] for r in spans) - sorted(r["count"] for r in spans)[1] <= 1


def test_texts_hold_the_words_taken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("key", F.col("doc_id"))
    mixed = op.mix(docs, carry=("key",))
    texts = op.taken_texts(mixed, docs, "key").withColumn("w", op.word_count(F.col("text")))
    got = {r["doc_id"]: r["w"] for r in texts.groupBy("doc_id").agg(F.sum("w").alias("w")).collect()}
    want = {r["doc_id"]: r["taken"] for r in op.taken_words(mixed).collect() if r["taken"]}
    assert got == want
    whole = texts.join(docs.select("key", F.col("text").alias("old")), "key")
    assert whole.filter("length(text) > length(old)").count() == 0
    assert whole.filter("length(text) = length(old) and text <> old").count() == 0


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = op.taken_words(op.mix(docs)).collect()
    assert len(rows) == docs.count()
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert op.taken_words(op.mix(no_docs(spark))).collect() == []
    assert [r["taken"] for r in op.taken_words(op.mix(docs.filter("text is null"))).collect()] == [0]
