"""Skew probe: one key holds about a third of all rows.

Runs the skew-sensitive jobs on synthetic data derived from ``range`` and
prints timings plus the largest per-partition row count of each result's
final stage (a proxy for the biggest task).  Not a registered query; a tool
to check that hot keys are spread over tasks.

Usage: python tools/skew_probe.py [n_rows]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from evalspark.operators import context, ordinals, scoring  # noqa: E402
from evalspark.session import build_session  # noqa: E402


def max_partition_rows(df) -> int:
    counts = df.groupBy(F.spark_partition_id().alias("p")).count()
    return counts.agg(F.max("count")).first()[0]


def timed(name, df):
    t0 = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    print(f"{name}: {time.perf_counter() - t0:.2f}s", flush=True)


def main() -> None:
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 300_000
    # Byte-based partition sizing as on a cluster, scaled down: AQE coalesces
    # range partitions to ~256 KB here (256 MB with ``cluster_conf``).
    spark = build_session("local[8]", 64, extra={
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k"})
    ids = spark.range(n)
    hot = F.col("id") % 3 == 0
    # --- group ordinal: a third of all pages belong to one user
    # a 64-byte incompressible payload so partition sizing sees real bytes
    pages = ids.select(F.when(hot, F.lit("hot")).otherwise(F.format_string("u%05d", F.col("id") % 5000))
                       .alias("user_id"), F.col("id").alias("ordinal"),
                       F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    g = ordinals.group_ordinal(pages, ["user_id"], ["ordinal"], "page_idx", "n_pages")
    timed("group_ordinal", g)
    print("  largest range partition of the hot user:",
          max_partition_rows(ordinals.global_ordinal(pages.filter("user_id = 'hot'"), ["ordinal"])), "of", n // 3)
    # --- evaluate: a third of all responses answer one question
    resp = ids.select(F.when(hot, F.lit("qhot")).otherwise(F.format_string("q%06d", F.col("id") % 50000))
                      .alias("question_ref"), F.format_string("m%d", F.col("id") % 7).alias("model"),
                      F.lit("direct").alias("setting"), F.format_string("%d miles", F.col("id") % 60).alias("response"))
    ans = spark.range(50000).select(F.format_string("q%06d", "id").alias("question_ref"),
                                    F.lit("distance").alias("answer_type"), F.lit("30 ± 5").alias("expected_answer")) \
        .unionByName(spark.createDataFrame([("qhot", "distance", "30 ± 5")], "question_ref string, "
                                           "answer_type string, expected_answer string"))
    timed("evaluate (skew-safe outer align)", scoring.evaluate(resp, ans))
    # --- blocked top-k: one folder holds a third of all files
    m = n // 10
    files = spark.range(m).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.format_string("f%03d", F.col("id") % 200)).alias("dir"),
        F.format_string("image%d_%d.png", F.col("id"), F.col("id") % 9).alias("name"))
    files = files.select("dir", "name", F.concat_ws("/", "dir", "name").alias("path"))
    targets = files.filter(F.abs(F.hash("path")) % 40 == 0) \
        .select(F.concat(F.lit("q_"), F.col("path")).alias("question_ref"), F.lit(1).alias("target_pos"), "path")
    top = context.nearest_named(targets, files, k=10, block=2048)
    timed(f"nearest_named ({m} files, hot folder {m // 3}, {targets.count()} questions)", top)
    spark.stop()


if __name__ == "__main__":
    main()
