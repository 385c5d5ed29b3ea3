import hashlib

from llm_cases import folder, no_docs, odd_docs
from pyspark.sql import functions as F

from evalspark.llm import op8_stream_dedup as op


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def expect(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(lower(text), []).append(doc_id)
    return sorted(((d, max(g, key=lambda x: (x is not None, x or 0)), len(g), hashlib.sha256(t.encode()).hexdigest())
                   for t, g in groups.items() for d in g), key=str)


def test_groups_by_brute_force(spark, tmp_dir):
    texts = ["abc", "ABC", "aBc", "É", "é", "", None, "x" * 9000, "X" + "x" * 8999, "ß", "İ", "i"]
    rows = [(i, texts[i * 7 % len(texts)]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    path = folder(spark, tmp_dir, documents=df)
    got = op.query(spark, path).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == expect(rows)
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_digest_collisions_are_told_apart(spark, tmp_dir):
    rows = [(i, f"text {i // 2 % 40}") for i in range(160)]
    path = folder(spark, tmp_dir, documents=spark.createDataFrame(rows, "doc_id bigint, text string"))
    short = lambda t: F.substring(F.sha2(t, 256), 1, 1)
    got = op.stream_dedup(spark, f"{path}/documents.parquet", digest=short).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == expect(rows)


def test_state_goes_on_from_the_checkpoint(spark, tmp_dir):
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id bigint, text string")
    path, ck = tmp_dir + "/d.parquet", tmp_dir + "/ck"
    first.write.parquet(path)
    run = lambda: {r["digest"]: (r["keep"]["doc_id"], r["n"]) for r in op.run_state(
        spark, path, "doc_id", "text", lambda t: t, 2, ck).collect()}
    assert run() == {"a": (2, 2), "b": (3, 1)}
    spark.createDataFrame([(9, "A"), (4, "c")], "doc_id bigint, text string").write.mode("append").parquet(path)
    assert run() == {"a": (9, 3), "b": (3, 1), "c": (4, 1)}


def test_odd_rows(spark, tmp_dir):
    docs = odd_docs(spark)
    got = op.query(spark, folder(spark, tmp_dir, documents=docs)).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == expect(rows)
    assert sum(r["kept"] for r in got) == len({lower(t) for _, t in rows})  # one of two equal rows
    assert op.query(spark, folder(spark, tmp_dir, "e", documents=no_docs(spark))).collect() == []


def test_no_python_in_the_plan(spark, tmp_dir):
    df = op.query(spark, folder(spark, tmp_dir, documents=odd_docs(spark)))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
