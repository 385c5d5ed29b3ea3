"""S1, S3–S8, S10, S12, J1, J2, P5, P6, U1 on fixtures."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import FIXTURES
from evalspark.operators import shape
from evalspark.sources import bank as io


def test_read_bank_multiline(spark):
    b = io.read_bank(spark, os.path.join(FIXTURES, "bank.json"))
    rows = {r["question_ref"]: r for r in b.collect()}
    assert len(rows) == 3 and rows["q_0002"]["image_urls"] == ["city/image7_a2.png", "city/image7_b1.png"]
    assert rows["q_0001"]["contextual_urls"] is None
    c = io.read_bank(spark, os.path.join(FIXTURES, "bank_contextual.json"), columns=["question_ref", "contextual_urls"])
    assert c.columns == ["question_ref", "contextual_urls"] and len(c.first()["contextual_urls"]) == 4


def test_read_annotations_quotes_newlines_and_old_schema(spark):
    a = io.read_annotations(spark, os.path.join(FIXTURES, "annotations.csv"))
    rows = {r["id"]: r for r in a.collect()}
    assert len(rows) == 3
    assert rows[1]["question_text"] == 'How far, roughly, is "the pier"?' and rows[1]["necessary"] == "yes"
    assert rows[2]["question_text"] == "Two\nlines" and rows[2]["answer"] == "None" and rows[2]["necessary"] is None
    assert rows[1]["timestamp"] is not None and rows[1]["user_id"] == "007" and rows[1]["count"] == 3
    old = io.read_annotations(spark, os.path.join(FIXTURES, "annotations_old.csv")).first()
    assert old["question_ref"] == "q_0002" and old["noinfo_reason"] is None and old["id"] is None


def test_read_roster(spark, tmp_dir):
    r = io.read_roster(spark, os.path.join(FIXTURES, "users.csv")).collect()
    assert [x["user_id"] for x in r] == ["007", "012", "100"] and r[1]["user_name"] is None
    empty = os.path.join(tmp_dir, "empty.csv")
    with open(empty, "w") as f:
        f.write("user_id,user_name\n")
    with pytest.raises(ValueError):
        io.read_roster(spark, empty)


def test_asset_manifest_lists_files(spark, tmp_dir):
    for rel in ["a/image1.png", "a/image2_m0.jpg", "b/c/image3.jpeg", "b/notes.txt"]:
        p = os.path.join(tmp_dir, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        open(p, "wb").write(b"x")
    m = sorted((r["dir"], r["name"]) for r in io.asset_manifest(spark, tmp_dir).collect())
    assert m == [("a", "image1.png"), ("a", "image2_m0.jpg"), ("b/c", "image3.jpeg")]


def test_responses_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([("q1", "m", "direct", "a"), ("q1", "m", "contextual", "b")],
                               "question_ref string, model string, setting string, response string")
    path = io.write_responses(df, os.path.join(tmp_dir, "resp"))
    assert spark.read.parquet(path).filter(F.col("setting") == "direct").count() == 1
    assert io.response_file_tag(True) == "w_contextual"


def test_batch_requests_and_results(spark, tmp_dir):
    df = spark.createDataFrame([("q1", "Which way?", ["files/a", "files/b"])], "key string, q string, uris array<string>")
    req = df.select(io.batch_request_column(F.col("key"), F.lit("sys"), F.col("q"), F.col("uris"),
                                            F.transform("uris", lambda u: F.lit("image/png"))).alias("request_json"))
    path = io.write_batch_requests(req, os.path.join(tmp_dir, "req"))
    r = io.read_batch_requests(spark, path).first()
    assert r["request"]["contents"][0]["text"] == "Which way?"
    assert [c["file_data"]["file_uri"] for c in r["request"]["contents"][1:]] == ["files/a", "files/b"]
    res = os.path.join(tmp_dir, "res.jsonl")
    with open(res, "w") as f:
        f.write('{"key": "q1", "response": {"text": "North"}}\n{"key": "q2", "error": "quota"}\n'
                '{"key": "q3", "response": {"candidates": []}}\n')
    keys = spark.createDataFrame([("q1",), ("q2",), ("q3",), ("q4",)], "key string")
    out = {r["key"]: (r["status"], r["text"]) for r in io.read_batch_results(spark, res, keys).collect()}
    assert out == {"q1": ("ok", "North"), "q2": ("error", None), "q3": ("raw", '{"candidates":[]}'),
                   "q4": ("missing", None)}
    assert io.read_batch_results(spark, res, job_state="JOB_STATE_FAILED").count() == 0


def test_align_melt_union(spark):
    left = spark.createDataFrame([("q1", 1), (None, 2)], "question_ref string, a int")
    right = spark.createDataFrame([("q1", "x"), ("q2", "y")], "question_ref string, b string")
    assert shape.align(left, right).count() == 3
    assert shape.align_left(left, right).count() == 2
    wide = spark.createDataFrame([("q1", "a", "b")], "question_ref string, alpha_response string, `beta2.5_response` string")
    long = {r["model"]: r["response"] for r in shape.melt_responses(wide).collect()}
    assert long == {"alpha": "a", "beta2.5": "b"}
    assert shape.resolve_response_column(wide).columns[1] == "_response"
    assert shape.resolve_response_column(wide, "beta2.5_response").columns[2] == "_response"
    u = shape.diagonal_union([left, right])
    assert sorted(u.columns) == ["a", "b", "question_ref"] and u.count() == 4


def test_merge_contextual(spark):
    b = spark.createDataFrame([("q1", "t"), ("q2", "u")], "question_ref string, question_text string")
    v1 = spark.createDataFrame([("q1", ["c1"])], "question_ref string, contextual_urls array<string>")
    v2 = spark.createDataFrame([("q1", ["c2"]), ("q2", ["c3"])], "question_ref string, contextual_urls array<string>")
    m = shape.merge_contextual(b, {"names": v1, "vectors": v2})
    got = sorted((r["question_ref"], r["variant"], r["contextual_urls"]) for r in m.collect())
    # one full bank copy per variant; a question missing from a variant keeps a null list
    assert got == [("q1", "names", ["c1"]), ("q1", "vectors", ["c2"]), ("q2", "names", None),
                   ("q2", "vectors", ["c3"])]


def test_write_responses_keeps_earlier_answers(spark, tmp_dir):
    schema = "question_ref string, model string, setting string, response string"
    path = os.path.join(tmp_dir, "resp")
    for rows in ([("q1", "m", "direct", "a")], [("q2", "m", "direct", "b")],
                 [("q1", "m", "direct", "again"), ("q3", "m", "direct", "c")]):
        io.write_responses(spark.createDataFrame(rows, schema), path)
    got = sorted((r["question_ref"], r["response"]) for r in spark.read.parquet(path).collect())
    assert got == [("q1", "a"), ("q2", "b"), ("q3", "c")]


def test_annotation_folder_with_two_headers(spark, tmp_dir):
    for name, text in (("a", "id,question_ref,answer,validity\n1,q1,\"x,\ny\",ok\n"),
                       ("b", "question_id,id,validity,answer\nq2,2,fine,z\n"), ("c", "id,question_ref,answer,validity\n3,q3,w,ok\n")):
        with open(os.path.join(tmp_dir, name + ".csv"), "w") as f:
            f.write(text)
    got = sorted((r["id"], r["question_ref"], r["answer"], r["validity"])
                 for r in io.read_annotations(spark, tmp_dir).collect())
    assert got == [(1, "q1", "x,\ny", "ok"), (2, "q2", "z", "fine"), (3, "q3", "w", "ok")]


def test_asset_manifest_takes_uri_roots(spark, tmp_dir):
    os.makedirs(os.path.join(tmp_dir, "a"))
    open(os.path.join(tmp_dir, "a", "x.png"), "wb").write(b"x")
    for root in (tmp_dir, tmp_dir + "/", "file:" + tmp_dir, "file://" + tmp_dir):
        assert [tuple(r) for r in io.asset_manifest(spark, root).collect()] == [("a", "x.png", "a/x.png")]


def test_batch_results_repeats_bad_lines_and_nested_text(spark, tmp_dir):
    path = os.path.join(tmp_dir, "r.jsonl")
    with open(path, "w") as f:
        f.write('{"key": "a", "error": "quota"}\n{"key": "a", "response": {"text": "yes"}}\nnot json\n\n'
                '{"key": "b", "response": {"candidates": [{"content": {"parts": [{"text": "no"}, {"text": "rth"}]}}]}}\n')
    got = sorted(((r["key"], r["status"], r["text"]) for r in io.read_batch_results(spark, path).collect()), key=str)
    assert got == [("a", "ok", "yes"), ("b", "ok", "north"), (None, "bad_line", "not json")]
    keys = spark.createDataFrame([("a",), ("z",)], "key string")
    assert {r["status"] for r in io.read_batch_results(spark, path, keys).collect()} == {"ok", "missing", "bad_line"}


def test_csv_cut_anywhere_equals_the_whole_file(spark, tmp_dir):
    """Cells with commas, quotes, line breaks and only blanks; ranges that end inside them."""
    import csv as writer
    import random
    rng = random.Random(1)
    cells = ["plain", "a,b", 'say "hi"', "two\nlines", "\n", ",\n\"\n,", "", " ", "x" * 300, "é\n" * 40, "5 km", '""', "q\r\nr"]
    for k in range(2):
        with open(os.path.join(tmp_dir, f"f{k}.csv"), "w", newline="") as f:
            w = writer.writer(f, lineterminator="\r\n" if k else "\n")
            w.writerow(["id", "question_ref", "answer", "noinfo_reason"])
            for i in range(100):
                w.writerow([k * 1000 + i, f"q{i}", rng.choice(cells), rng.choice(cells)])
    read = lambda: sorted((r["id"], r["question_ref"], r["answer"] or "", (r["noinfo_reason"] or "").replace("\r\n", "\n"))
                          for r in io.read_annotations(spark, tmp_dir).collect())
    fix = lambda rows: [(a, b, c.replace("\r\n", "\n"), d) for a, b, c, d in rows]
    whole = (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(tmp_dir)
             .selectExpr("cast(id AS bigint) AS id", "question_ref", "answer", "noinfo_reason"))
    want = sorted((r[0], r[1], (r[2] or "").replace("\r\n", "\n"), (r[3] or "").replace("\r\n", "\n")) for r in whole.collect())
    assert len(want) == 200 and fix(read()) == want
    with small_ranges(spark, 1000):
        from evalspark.sources.pieces import read_pieces
        ranges = read_pieces(spark, os.path.join(tmp_dir, "f0.csv"), "\n").select("range").distinct().count()
        assert ranges >= 8
        assert fix(read()) == want
    with small_ranges(spark, 400):
        assert fix(read()) == want


class small_ranges:
    """Files are cut in ranges of about so many bytes."""

    def __init__(self, spark, size):
        self.spark, self.new = spark, {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}

    def __enter__(self):
        self.old = {k: self.spark.conf.get(k) for k in self.new}
        for k, v in self.new.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.old.items():
            self.spark.conf.set(k, v)


def test_empty_annotation_files(spark, tmp_dir):
    for name, text in (("a", ""), ("b", "id,question_ref,answer\n"), ("c", "\n\n")):
        with open(os.path.join(tmp_dir, name + ".csv"), "w") as f:
            f.write(text)
    assert io.read_annotations(spark, tmp_dir).collect() == []


def test_json_array_cut_anywhere_equals_the_whole_file(spark, tmp_dir):
    import json
    import random
    rng = random.Random(2)
    texts = ["plain", "a } b", "{[", '"}', "\\", "\\\\\"}", "two\nlines", "", "é🙂}" * 30, "]}, {", None]
    rows = [{"question_ref": f"q{i}", "question_text": rng.choice(texts), "expected_answer": rng.choice(texts),
             "image_urls": [t for t in rng.sample(texts, rng.randrange(3)) if t is not None]} for i in range(80)]
    one, pretty, none = (os.path.join(tmp_dir, n) for n in ("one.json", "pretty.json", "none.json"))
    for path, value, style in ((one, rows, {}), (pretty, rows, {"indent": 2}), (none, [], {})):
        with open(path, "w") as f:
            json.dump(value, f, ensure_ascii=path == one, **style)
    key = lambda df: sorted(map(str, df.collect()))
    for path in (one, pretty):
        want = key(io.read_bank(spark, path))
        assert len(want) == 80
        assert key(io.read_bank(spark, path, split=True)) == want
        for size in (800, 400):
            with small_ranges(spark, size):
                assert key(io.read_bank(spark, path, split=True)) == want
                from evalspark.sources.pieces import read_pieces
                assert read_pieces(spark, path, "}").select("range").distinct().count() >= 8
    assert key(io.read_bank(spark, none, split=True)) == []
    assert io.read_bank(spark, one, split=True, columns=["question_ref"]).columns == ["question_ref"]


def test_listing_walks_folders_in_tasks(spark, tmp_dir):
    from evalspark.sources.listing import walk_files
    names = [f"d{i}/e{i % 3}/f/x{i}.png" for i in range(30)] + ["top.png", "_hidden/a.png", ".b.png", "k=1/c.jpg", "d0/n.txt", "_p=2/z.png"]
    for rel in names:
        os.makedirs(os.path.dirname(os.path.join(tmp_dir, rel)) or tmp_dir, exist_ok=True)
        open(os.path.join(tmp_dir, rel), "wb").close()
    got = sorted(r[0] for r in walk_files(spark, tmp_dir).collect())
    assert got == sorted(n for n in names if n not in ("_hidden/a.png", ".b.png"))
    assert [r[0] for r in walk_files(spark, tmp_dir, recursive=False).collect()] == ["top.png"]
    assert io.asset_manifest(spark, tmp_dir).count() == 33
    assert [r["path"] for r in io.asset_manifest(spark, tmp_dir, ("jpg",)).collect()] == ["k=1/c.jpg"]
    with pytest.raises(FileNotFoundError):
        walk_files(spark, os.path.join(tmp_dir, "none"))


def test_answered_keys_are_joined_without_moving_the_history(spark, tmp_dir):
    from evalspark.sources import answered
    keys = answered.AnsweredKeys(spark, os.path.join(tmp_dir, "keys"), buckets=4, per_bucket=50)
    named = lambda a, b: spark.range(a, b).selectExpr("concat('q', id) AS question_ref", "id")
    assert keys.pending(named(0, 5)).count() == 5
    keys.add(named(0, 100))
    keys.add(named(0, 10))  # a replay stores them again
    assert keys._state()[0] == 4
    batch = named(90, 2500)
    assert keys.stored(batch).count() == 10 and keys.pending(batch).count() == 2400
    plan = keys.stored(batch)._jdf.queryExecution().executedPlan().toString()
    history = plan[plan.index("FileScan"):] if plan.count("FileScan") == 1 else plan
    above = plan[:plan.index("FileScan")].splitlines()
    # Between the join and the history's scan: no exchange (a one-sided one deals the batch).
    right = [line for line in above if ":" not in line.split("-")[0] or line.strip().startswith("+-")]
    assert "Bucketed: true" in history and "SelectedBucketsCount: 4 out of 4" in history
    assert not any("Exchange" in line for line in right[next(i for i, x in enumerate(right) if "SortMergeJoin" in x):])
    few = keys.stored(named(99, 101))
    assert [r[0] for r in few.collect()] == ["q99"]
    assert "SelectedBucketsCount" in few._jdf.queryExecution().executedPlan().toString()
    keys.add(named(100, 900))  # outgrows its buckets
    assert keys._state()[0] == 64
    again = answered.AnsweredKeys(spark, os.path.join(tmp_dir, "keys"), buckets=4, per_bucket=50)
    assert sorted(r["id"] for r in again.pending(named(0, 2000)).collect()) == list(range(900, 2000))
    odd = spark.createDataFrame([(None, 1), ("q1", 2), ("x", 3)], "question_ref string, id int")
    assert sorted(r["id"] for r in again.pending(odd).collect()) == [1, 3]
