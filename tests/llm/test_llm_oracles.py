"""Queries whose rows SQL can express, on the smallest tables."""

import os
import sys

import pytest
from llm_cases import SF

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))

from oracle_check import TABLES, digest, type_mismatches  # noqa: E402

from evalspark.llm import registry  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = registry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(registry.oracle_sql()[name])
    cols, want = [d[0] for d in res.description], res.fetchall()
    assert type_mismatches(df, res.description) == []
    assert len(rows) == len(want)
    assert digest(df.columns, rows)[:2] == digest(cols, want)[:2]


def test_operators_are_registered():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{i}" for i in range(1, 14)]
