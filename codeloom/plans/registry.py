"""All core queries and their SQL, gathered from the query modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.plans import (
    advanced_queries,
    algorithm_queries,
    dataset_queries,
    feedback_queries,
    golden_queries,
    report_queries,
    source_queries,
    syntax_queries,
    text_queries,
    text_rule_queries,
)

Query = Callable[[SparkSession, str], DataFrame]


MODULES = (feedback_queries, dataset_queries, text_queries, text_rule_queries, algorithm_queries, syntax_queries, golden_queries, source_queries, report_queries, advanced_queries)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in MODULES:
        found.update(module.QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found.update(module.ORACLES)
    return found
