"""Registry of stand-in queries (Spark callable + DuckDB oracle text).

Query keys are SURVEY §2 operator names so coverage can be ticked off row by
row.  A query without oracle text is a rows-only check (non-SQL operators).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    op_id: str


_REGISTRY: dict[str, Query] = {}


def register(name: str, op_id: str, sql: str | Callable[[], str] | None = None):
    """Decorator: register ``fn(spark, sf_dir)`` under ``name``."""
    def deco(fn: QueryFn) -> QueryFn:
        text = sql() if callable(sql) else sql
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Query(name, fn, text, op_id)
        return fn
    return deco


def _load_all() -> None:
    # Importing the plan modules populates the registry.
    from evalspark.plans import (  # noqa: F401
        annotators, bank, context, inference, reports, scoring, streams,
    )


def all_queries() -> dict[str, Query]:
    _load_all()
    return dict(_REGISTRY)
