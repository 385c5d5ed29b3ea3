"""Same input in 1 vs N files, and across a restart, gives equal tables."""

import os

from pyspark.sql import functions as F

from evalspark import schemas
from evalspark.plans.providers import RuleProvider
from evalspark.streaming import annotations as sa
from evalspark.streaming import inference as si
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), *schemas.SUBMISSION.fields])
NOINFO = "Map doesn't contain information to answer the question"


def posts(spark):
    rows = [
        (1, "007", "q_0001", "t", "Single", "Distance", "5 km", "Can be answered", None, None),
        (2, "007", "q_0001", "t", "Single", "Distance", "6 km", "Can be answered", None, None),  # duplicate
        (3, " 012 ", "q_0001", "t", "Single", "Distance", "", NOINFO, None, None),            # no reason
        (4, "012", "q_0002", "t", "Multi", "Border", "x", "Can be answered", "Yes", None),     # bad necessary
        (5, "012", "q_0003", "t", "Multi", "Nearby", "x", "Can be answered", "yes", None),     # bad relation
        (6, "013", "q_0002", "t", "Multi", "Border", "x", NOINFO, "no", "legend cut"),
        (7, "007", "q_0002", "t", "Multi", "Border", "y", "Can be answered", "", None),
    ]
    return spark.createDataFrame(
        [(i, u, q, t, m, s, a, v, n, r, None) for i, u, q, t, m, s, a, v, n, r in rows], SCHEMA
    ).withColumn("timestamp", F.timestamp_seconds(F.col("event_id")))


def run(spark, tmp_dir, n_files, tag):
    src = os.path.join(tmp_dir, f"src_{tag}")
    si.write_slices(posts(spark), src, n_files, ["event_id"])
    out = os.path.join(tmp_dir, f"out_{tag}")
    sa.ingest_annotations(spark, src, out, os.path.join(tmp_dir, f"ckpt_{tag}"), SCHEMA,
                          max_files_per_trigger=si.FILES_PER_SLICE, order=("event_id",))
    acc = sorted(r["event_id"] for r in sa.read_accepted(spark, out).collect())
    q = {r["event_id"]: sorted(r["reasons"]) for r in sa.read_quarantine(spark, out).collect()}
    users = sorted(r["user_id"] for r in sa.read_users(spark, out).collect())
    return acc, q, users, src, out


def test_ingest_one_vs_many_files(spark, tmp_dir):
    a1, q1, u1, _, _ = run(spark, tmp_dir, 1, "one")
    a3, q3, u3, src, out = run(spark, tmp_dir, 3, "three")
    assert a1 == a3 == [1, 6, 7]
    assert q1 == q3
    assert q1[2] == ["duplicate"] and q1[3] == ["noinfo_reason"] and q1[4] == ["necessary"]
    assert q1[5] == ["spatial_relationship"]
    assert u1 == u3 == ["007", "013"]
    # restart with the same checkpoint and no new files: nothing changes
    sa.ingest_annotations(spark, src, out, os.path.join(tmp_dir, "ckpt_three"), SCHEMA)
    assert sa.read_accepted(spark, out).count() == 3


def test_duplicate_across_batches_is_quarantined(spark, tmp_dir):
    _, q, _, _, _ = run(spark, tmp_dir, 7, "seven")
    assert q[2] == ["duplicate"]


def test_bounded_first_write_wins(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src_b")
    si.write_slices(posts(spark), src, 2, ["event_id"])
    stream = spark.readStream.schema(SCHEMA).json(src)
    out = os.path.join(tmp_dir, "out_b")
    q = (sa.first_write_wins_bounded(stream).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(tmp_dir, "ckpt_b")).trigger(availableNow=True).start())
    q.awaitTermination()
    keys = [(r["user"], r["question_ref"]) for r in spark.read.parquet(out).collect()]
    assert len(keys) == len(set(keys))


def test_resumable_inference_restart_and_retry(spark, tmp_dir):
    bank = spark.createDataFrame(
        [(f"q_{i:04d}", "x" * (97 if i == 3 else 10 + i), None, ["a/i.png"], "Single", "Distance", None, None)
         for i in range(8)], schemas.BANK)
    src, out, ckpt = (os.path.join(tmp_dir, n) for n in ("bank", "resp", "ckpt"))
    si.write_slices(bank, src, 4, ["question_ref"], which=range(0, 2))
    si.resumable_inference(spark, src, out, ckpt, RuleProvider("rule", fail_every=97), schemas.BANK,
                           max_files_per_trigger=si.FILES_PER_SLICE)
    assert si.responses_table(spark, out).count() == 3          # q_0003 failed
    si.write_slices(bank, src, 4, ["question_ref"], which=range(2, 4))
    si.resumable_inference(spark, src, out, ckpt, RuleProvider("rule", fail_every=97), schemas.BANK,
                           max_files_per_trigger=si.FILES_PER_SLICE)
    assert si.responses_table(spark, out).count() == 7          # still pending: q_0003
    si.retry_pending(spark.read.schema(schemas.BANK).json(src), RuleProvider("rule"), out)
    got = si.responses_table(spark, out)
    assert got.count() == 8 and got.select("question_ref").distinct().count() == 8


def test_progress(spark, tmp_dir):
    src, ckpt = os.path.join(tmp_dir, "src_p"), os.path.join(tmp_dir, "ckpt_p")
    si.write_slices(posts(spark), src, 2, ["event_id"])
    pages = spark.createDataFrame([("007", "q_0001", 1), ("007", "q_0002", 2), ("013", "q_0002", 1), ("007", "q_9", 9)],
                                  "user_id string, question_ref string, page_idx long")
    got = lambda: {r["user_id"]: r["last_idx"] for r in sa.read_progress(spark, ckpt).collect()}
    assert got() == {}
    sa.run_progress(spark, src, pages, SCHEMA, ckpt)
    assert got() == {"007": 2, "013": 1}
    feed(spark, src, [(20, "007", "q_9", "1 km"), (21, "014", "q_9", "1 km")])
    sa.run_progress(spark, src, pages, SCHEMA, ckpt)
    assert got() == {"007": 9, "013": 1}
    assert sa.read_progress(spark, ckpt).count() == 2  # one row per user, however many batches


def test_first_write_wins_batch_helper(spark):
    from evalspark.operators.annotations import first_write_wins
    df = spark.createDataFrame([("u", "q", 3), ("u", "q", 1), ("u", "p", 2), ("v", "q", 5)],
                               "user string, question_ref string, ts int")
    got = sorted((r["user"], r["question_ref"], r["ts"], r["duplicate"])
                 for r in first_write_wins(df, ["user", "question_ref"], ["ts"]).collect())
    assert got == [("u", "p", 2, False), ("u", "q", 1, False), ("u", "q", 3, True), ("v", "q", 5, False)]


def test_retries_and_replays_keep_every_answer(spark, tmp_dir):
    rows = [(f"q_{i}", "x" * n, None, ["a/i.png"], "Single", "Distance", None, None)
            for i, n in enumerate([10, 11, 12, 13, 14])]
    bank, out = spark.createDataFrame(rows, schemas.BANK), os.path.join(tmp_dir, "resp")
    stored = lambda: sorted(r["question_ref"] for r in si.responses_table(spark, out).collect())
    si.answer_batch(bank, RuleProvider("rule", fail_every=2), out, 0)      # odd lengths answered
    assert stored() == ["q_1", "q_3"]
    si.answer_batch(bank, RuleProvider("rule", fail_every=3), out, 0)      # a replay that fails elsewhere
    assert stored() == ["q_0", "q_1", "q_3", "q_4"]
    si.retry_pending(bank, RuleProvider("rule", fail_every=4), out)
    assert stored() == ["q_0", "q_1", "q_3", "q_4"]
    si.retry_pending(bank, RuleProvider("rule"), out)
    assert stored() == ["q_0", "q_1", "q_2", "q_3", "q_4"]
    si.answer_batch(bank, RuleProvider("rule"), out, 1)                    # listed again in the stream
    assert stored() == ["q_0", "q_1", "q_2", "q_3", "q_4"]


def feed(spark, src, rows):
    """Append one file of (event_id, user, question_ref, answer) posts."""
    df = spark.createDataFrame(
        [(i, u, q, "t", "Single", "Distance", a, "Can be answered", None, None, None) for i, u, q, a in rows], SCHEMA)
    df.withColumn("timestamp", F.timestamp_seconds(F.col("event_id"))).coalesce(1).write.mode("append").json(src)


def test_a_trigger_reads_no_earlier_output(spark, tmp_dir):
    """Ten triggers, with all earlier output out of the way: the state alone knows the winners."""
    src, out, ckpt = (os.path.join(tmp_dir, n) for n in ("src", "out", "ckpt"))
    rows_read = []
    for n in range(10):
        feed(spark, src, [(10 * n, "u0", "q_0", f"{n} km"), (10 * n + 1, f"u{n}", f"q_{n}", "1 km"),
                          (10 * n + 2, "u0", f"new_{n}", "2 km")])
        mine = os.path.join(out, str(n))
        q = sa.ingest_annotations(spark, src, mine, ckpt, SCHEMA, order=("event_id",))
        rows_read.append(sum(s["numInputRows"] for p in q.recentProgress for s in p["sources"]))
        got = sorted(r["event_id"] for r in sa.read_accepted(spark, mine).collect())
        lost = sorted(r["event_id"] for r in sa.read_quarantine(spark, mine).collect())
        assert got == ([0, 2] if n == 0 else [10 * n + 1, 10 * n + 2])
        assert lost == ([1] if n == 0 else [10 * n])
    assert rows_read[9] <= rows_read[1]


def lose_commit(ckpt, stream):
    commits = os.path.join(ckpt, stream, "commits")
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for f in (str(last), f".{last}.crc"):
        if os.path.exists(os.path.join(commits, f)):
            os.remove(os.path.join(commits, f))


def test_restart_after_a_lost_commit_repeats_the_batch(spark, tmp_dir, monkeypatch):
    """A crash between a write and its commit: the replay replaces its own output, in any of the streams."""
    src, out, ckpt = (os.path.join(tmp_dir, n) for n in ("src", "out", "ckpt"))
    ingest = lambda: sa.ingest_annotations(spark, src, out, ckpt, SCHEMA, order=("event_id",))
    read = lambda: [sorted(map(str, f(spark, out).collect()))
                    for f in (sa.read_accepted, sa.read_quarantine, sa.read_users)]
    feed(spark, src, [(1, "a", "q", "1 km"), (2, "a", "q", "2 km")])
    ingest()
    feed(spark, src, [(3, "a", "q", "3 km"), (4, "b", "q", "4 km")])
    with monkeypatch.context() as m:  # the posts are written, then the driver dies
        m.setattr(sa, "upsert_users", lambda *a: None)
        ingest()
    lose_commit(ckpt, "posts")
    ingest()
    before = read()
    assert sorted(r["event_id"] for r in sa.read_accepted(spark, out).collect()) == [1, 4]
    assert [r["user_id"] for r in sa.read_users(spark, out).orderBy("user_id").collect()] == ["a", "b"]
    lose_commit(ckpt, "users")  # and once more, after the users were written
    ingest()
    assert read() == before


def test_a_flooded_key_keeps_its_first_post(spark, tmp_dir):
    """Almost all posts are for one key: the least is found before the shuffle, none is lost."""
    src, out, ckpt = (os.path.join(tmp_dir, n) for n in ("src", "out", "ckpt"))
    feed(spark, src, [(i, "hot", "q", f"{i} km") for i in range(3000, 0, -1)] + [(5000 + i, f"u{i}", "q", "1 km") for i in range(20)])
    q = sa.ingest_annotations(spark, src, out, ckpt, SCHEMA, order=("event_id",))
    acc = {r["user"]: r["event_id"] for r in sa.read_accepted(spark, out).collect()}
    assert acc["hot"] == 1 and len(acc) == 21
    assert sa.read_quarantine(spark, out).count() == 2999
    assert sa.read_users(spark, out).count() == 21
    assert sum(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress[-1:]) == 22  # and one mark


def test_order_within_a_batch(spark, tmp_dir):
    """Nulls come first, ties fall by content, whichever way the rows lie."""
    df = posts(spark).filter("event_id in (1, 2)").withColumn("timestamp", F.lit(None).cast("timestamp"))
    late = posts(spark).filter("event_id = 1").withColumn("event_id", F.lit(99).cast("bigint"))
    wins = set()
    for i, frame in enumerate((df.unionByName(late), late.unionByName(df).orderBy(F.desc("event_id")))):
        out = os.path.join(tmp_dir, str(i))
        sa.process_batch(frame.coalesce(1), 0, out)
        wins |= {r["event_id"] for r in sa.read_accepted(spark, out).collect()}
        assert sa.read_quarantine(spark, out).count() == 2
    assert len(wins) == 1 and wins <= {1, 2}


def test_blank_and_padded_keys(spark, tmp_dir):
    rows = posts(spark).filter("event_id = 1").drop("user", "question_ref")
    variants = spark.createDataFrame([("\t", "q_1"), ("u", "  "), ("u", " q_1"), ("u", "q_1\u3000")],
                                     "user string, question_ref string")
    df = rows.withColumn("_j", F.lit(1)).join(variants.withColumn("_j", F.lit(1)), "_j").drop("_j")
    sa.process_batch(df, 0, tmp_dir, ("event_id",))
    acc = sa.read_accepted(spark, tmp_dir).collect()
    assert [(r["user"], r["question_ref"]) for r in acc] == [("u", "q_1")]
    why = sorted(r["reasons"][0] for r in sa.read_quarantine(spark, tmp_dir).collect())
    assert why == ["duplicate", "question_ref_missing", "user_missing"]
