"""Registry of the p1_ to p8_ queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import canon, crosssplit, leak, neardup, pairs, residue, spans, tokens

MODULES = (pairs, neardup, canon, spans, crosssplit, tokens, leak, residue)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in MODULES:
        found.update(module.QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found.update(module.ORACLES)
    return found
