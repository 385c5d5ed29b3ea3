"""Queries of this subpackage, by name, with the oracle text of those SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("op1_tool_calls", "op2_warc_chunks", "op3_source_mix", "op4_token_counts",
           "op5_order_fingerprint", "op6_length_packing", "op7_toxicity_neighbours",
           "op8_stream_dedup", "op9_order_near_dups", "op10_language_id", "op11_prefix_trie", "op12_pii_spans",
           "op13_collocations")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {}
    for name in MODULES:
        module = importlib.import_module(f"evalspark.llm.{name}")
        found[module.QUERY] = module.query
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in MODULES:
        module = importlib.import_module(f"evalspark.llm.{name}")
        if getattr(module, "SQL", None):
            found[module.QUERY] = module.SQL
    return found
