"""Every registered query against its DuckDB oracle on the smallest tables."""

import os
import sys

import pytest

from conftest import SF_SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import TABLES, digest, type_mismatches  # noqa: E402

from evalspark.plans.registry import all_queries  # noqa: E402

SQL = E.oracle_sql()
NAMES = sorted(all_queries())


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_oracle():
    assert set(NAMES) <= set(SQL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert type_mismatches(df, res.description) == []
    sc, sh, _ = digest(df.columns, srows)
    dc, dh, _ = digest(dcols, drows)
    assert sc == dc
    assert len(srows) == len(drows)
    assert sh == dh


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "accuracy" in df.columns
