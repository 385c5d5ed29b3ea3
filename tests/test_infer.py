"""P1–P4, P15, J5, J6, G17, I1."""

from pyspark.sql import functions as F


from evalspark.plans.providers import EchoProvider, RuleProvider
from evalspark.operators import infer
from evalspark.operators.infer import ProviderBase


def bank(spark):
    return spark.createDataFrame([
        ("q1", "Which way?", ["a/t1.png"], ["a/c1.png", "a/c2.png"]),
        ("q2", "x" * 97, ["a/t2.png", "a/t3.png"], []),
    ], "question_ref string, question_text string, image_urls array<string>, contextual_urls array<string>")


def test_image_lists_and_cap(spark):
    b = infer.build_image_list(bank(spark), distractor=True)
    got = {r["question_ref"]: r["image_lists"] for r in b.collect()}
    assert got["q1"] == ["a/c1.png", "a/c2.png", "a/t1.png"]
    capped = b.select(infer.cap_images("image_lists", 1).alias("c"), infer.cap_images("image_lists", 1, False)
                      .alias("s")).orderBy(F.size("c").desc()).first()
    assert len(capped["c"]) == 2 and len(capped["s"]) == 1
    assert infer.build_image_list(bank(spark), distractor=False).first()["image_lists"] == ["a/t1.png"]


def test_prompt_styles(spark):
    b = infer.build_image_list(bank(spark), distractor=True).filter("question_ref = 'q1'")
    r = b.select(*[infer.render_content(infer.prompt_content(F.col("question_text"), F.col("image_lists"), s))
                   .alias(s) for s in infer.PROMPT_STYLES]).first()
    assert r["prefixed"].startswith("Answer in English only.\n<image:a/c1.png>") and r["prefixed"].endswith("Which way?. ")
    assert r["text_last"].endswith("<image:a/t1.png>\nWhich way?")
    assert r["numbered"] == "Answer in English only.\nImage 1: <image>\nImage 2: <image>\nImage 3: <image>\nWhich way?"
    assert r["text_first"].startswith("Which way?\n<image:")


def test_infer_failure_isolation_and_pending(spark):
    b = infer.build_image_list(bank(spark), distractor=True)
    out = {r["question_ref"]: r for r in infer.infer(b, RuleProvider("rule", fail_every=97)).collect()}
    assert out["q1"]["rule_response"] == "10 miles" and out["q1"]["q_answered"]
    assert out["q2"]["rule_response"] is None and not out["q2"]["q_answered"]
    answered = infer.infer(b, RuleProvider("rule", fail_every=97))
    todo = infer.pending(bank(spark), answered, response="rule_response")
    assert [r["question_ref"] for r in todo.collect()] == ["q2"]


def test_infer_batches_fail_together(spark):
    b = infer.build_image_list(bank(spark), distractor=False).coalesce(1)
    out = infer.infer(b, RuleProvider("rule", fail_every=97), batch_size=2)
    assert all(r["rule_response"] is None for r in out.collect())


def test_drop_failed(spark):
    df = spark.createDataFrame([("a", "ok"), ("b", "None"), ("c", None)], "k string, r string")
    assert [r["k"] for r in infer.drop_failed_responses(df, "r").collect()] == ["a"]


def test_resolve_assets_reports_missing(spark):
    b = infer.build_image_list(bank(spark), distractor=True)
    uri = spark.createDataFrame([("a/c1.png", "u1"), ("a/t1.png", "u3"), ("a/t2.png", "u4")], "path string, uri string")
    out = {r["question_ref"]: r for r in infer.resolve_assets(b, uri).collect()}
    assert out["q1"]["uris"] == ["u1", None, "u3"] and out["q1"]["missing_paths"] == ["a/c2.png"]
    assert out["q2"]["missing_paths"] == ["a/t3.png"]


def test_length_buckets(spark):
    b = infer.build_image_list(bank(spark), distractor=True)
    got = {r["question_ref"]: (r["n_images"], r["batch_in_bucket"]) for r in infer.length_buckets(b, "image_lists", 1).collect()}
    assert got == {"q1": (3, 0), "q2": (2, 0)}


def test_provider_protocol():
    assert isinstance(RuleProvider(), infer.Provider)
    p = EchoProvider()
    assert p.temperature == 0.0 and p.max_new_tokens == 2048 and repr(p) == "echo"


def test_upload_assets_and_echo_flag(spark):
    class Prefix(infer.ProviderBase):
        image_prefix = "https://img.example/base"

        def respond(self, requests):
            return ["Final answer: x Final answer: y" for _ in requests]

    p = Prefix("prefix")
    paths = spark.createDataFrame([("a/1.png",), ("a/1.png",), ("b/2.png",), (None,)], "path string")
    got = {r["path"]: r["uri"] for r in infer.upload_assets(paths, p).collect()}
    assert got == {"a/1.png": "https://img.example/base/a/1.png", "b/2.png": "https://img.example/base/b/2.png"}
    out = infer.infer(infer.build_image_list(bank(spark), False), p).collect()
    assert all(r["flag_echo"] and r["prefix_response"] == "y" for r in out)


def test_pending_and_answered_partition_the_bank(spark):
    """Property: pending ∪ answered = bank, disjoint."""
    b = bank(spark)
    answered = infer.infer(infer.build_image_list(b, False), RuleProvider("rule", fail_every=97))
    ok = infer.drop_failed_responses(answered, "rule_response").select("question_ref")
    todo = infer.pending(b, answered, response="rule_response").select("question_ref")
    assert ok.join(todo, "question_ref").count() == 0
    assert sorted(r[0] for r in ok.union(todo).collect()) == sorted(r[0] for r in b.select("question_ref").collect())


def test_a_call_holds_one_image_count(spark):
    # A local class, so that workers need not import this file.
    class CountingProvider(ProviderBase):
        """Answers with the image counts of its call; fails on a call that mixes them."""

        def respond(self, requests):
            counts = sorted({len(r["image_lists"]) for r in requests})
            if len(requests) > 4 or len(counts) > 1:
                raise ValueError(f"mixed {counts}")
            return [f"{counts[0]}/{len(requests)}" for _ in requests]

    df = spark.range(500).select(
        F.format_string("q_%03d", "id").alias("question_ref"), F.lit("t").alias("question_text"),
        F.transform(F.sequence(F.lit(1), F.col("id") % 3 + 1), lambda i: F.lit("a.png")).alias("image_lists"))
    b = infer.length_buckets(df, "image_lists", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        good = infer.infer(b, CountingProvider("c"), batch_size=4, batch_key="batch_key").collect()
        mixed = infer.infer(b, CountingProvider("c"), batch_size=4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(good) == 500 and all(r["error"] is None and r["q_answered"] for r in good)
    assert sum(r["raw_response"].endswith("/4") for r in good) >= 490  # full calls but for a bucket's last
    assert any(r["error"] and r["error"].startswith("ValueError: mixed") for r in mixed)
