"""Plan checks: no Python UDF outside inference, scans pruned and pushed."""

import pytest

from conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["evaluate", "accuracy", "score_text", "annotator_spread", "page_ordinals",
                                  "validate_annotation", "bank_profile", "align"])
def test_no_python_in_sql_jobs(spark, name):
    import __spark_entry__ as E
    p = plan(E.queries()[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_align_prunes_text_column(spark):
    import __spark_entry__ as E
    p = plan(E.queries()["align"](spark, SF_SMALL))
    docs = [line for line in p.splitlines() if "documents" in line and "ReadSchema" in line]
    assert docs and all("text" not in line.split("ReadSchema")[1] for line in docs)


def test_filters_pushed_to_scan(spark):
    from pyspark.sql import functions as F
    df = spark.read.parquet(f"{SF_SMALL}/labels.parquet").filter(F.col("quality") == 1).select("doc_id")
    p = plan(df)
    assert "PushedFilters: [IsNotNull(quality), EqualTo(quality,1)]" in p


def test_scoring_is_one_pass(spark):
    """E5 dispatches with one CASE in a projection, never filter-per-type + union."""
    import __spark_entry__ as E
    p = plan(E.queries()["evaluate"](spark, SF_SMALL))
    filters = [line for line in p.splitlines() if "Filter" in line and "answer_type" in line]
    assert not filters
    assert "CASE WHEN (answer_type" in p


def test_bank_slice_prunes_partitions(spark, tmp_dir):
    import os
    from evalspark.plans import standins
    from evalspark.sources import bank as io
    path = io.write_bank_partitioned(standins.bank(spark, SF_SMALL).drop("doc_id"), os.path.join(tmp_dir, "b"),
                                     ["answer_type", "spatial_relationship"])
    df = io.read_bank_slice(spark, path, spatial_relationship="Border")
    p = plan(df)
    assert "PartitionFilters: [isnotnull(spatial_relationship" in p and "Border" in p
    assert df.count() == standins.bank(spark, SF_SMALL).filter("spatial_relationship = 'Border'").count()


def test_ordinal_windows_run_over_partition_counts_only(spark):
    """SURVEY §5(e): no single-partition window over fact rows."""
    import __spark_entry__ as E
    for name in ["number_questions", "page_ordinals", "longest_first", "batch_id"]:
        p = plan(E.queries()[name](spark, SF_SMALL))
        windows = [line for line in p.splitlines() if "Window [" in line]
        assert windows and all("_n#" in line for line in windows), name


def test_ship_package_zips_into_checkpoint_folder(spark):
    import os
    import zipfile
    from evalspark.session import CHECKPOINT_CONF, ship_package, _SHIPPED
    _SHIPPED.discard(spark.sparkContext.applicationId)
    ship_package(spark)
    ship_package(spark)  # idempotent
    folder = os.path.join(spark.conf.get(CHECKPOINT_CONF).replace("file:", "", 1), "evalspark-pyfiles")
    zips = [f for f in os.listdir(folder) if f.endswith(".zip")]
    assert zips
    names = zipfile.ZipFile(os.path.join(folder, zips[0])).namelist()
    assert "evalspark/operators/infer.py" in names and "evalspark/__init__.py" in names


@pytest.mark.parametrize("master,allowed", [("local[4]", True), ("yarn", False), ("local-cluster[2,1,1024]", False)])
def test_checkpoint_folder_must_be_named_off_local_masters(master, allowed):
    from types import SimpleNamespace
    from evalspark.session import ensure_checkpoint_dir
    conf = {"spark.master": master}
    context = SimpleNamespace(getCheckpointDir=lambda: None, setCheckpointDir=lambda p: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(
        get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__))
    if allowed:
        assert ensure_checkpoint_dir(session) == conf["spark.checkpoint.dir"]
    else:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            ensure_checkpoint_dir(session)


def test_a_damaged_table_is_not_an_empty_one(spark, tmp_dir):
    import os
    from evalspark.session import read_if_exists
    assert read_if_exists(spark, os.path.join(tmp_dir, "none")) is None
    with open(os.path.join(tmp_dir, "part-0.parquet"), "wb") as f:
        f.write(b"not a parquet file")
    with pytest.raises(Exception, match="FAILED_READ_FILE|not a Parquet|CANNOT_READ"):
        read_if_exists(spark, tmp_dir).count()
