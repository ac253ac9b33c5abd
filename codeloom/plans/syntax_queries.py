"""Syntax-level queries: no SQL can parse code, so these are tested on hand-counted snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import rewrite, syntax, text
from codeloom.sources.tables import table


def _codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "optimization_result").select("result_id", "original_code", "optimized_code")


def syntax_features(spark: SparkSession, d: str) -> DataFrame:
    """Mean syntax features per predicted technique."""
    found = syntax.features(table(spark, d, "feedback"), "id", "original_code", ("predicted_technique",))
    return found.groupBy("predicted_technique").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("n_valid"), *[F.round(F.avg(n), 4).alias(n) for n in syntax.NUMBERS]
    )


def feature_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The 30 features of the technique classifier and its confidence, per feedback row."""
    found = syntax.features(table(spark, d, "feedback"), "id", "original_code", ("original_code", "predicted_technique"))
    own = syntax.features30(F.col("original_code"))
    return found.where("original_code IS NOT NULL").select("id", "predicted_technique", F.array(*own.values()).alias("features"))


def complexity_estimators(spark: SparkSession, d: str) -> DataFrame:
    """Rows per combination of the estimators, which disagree on purpose."""
    found = syntax.features(_codes(spark, d), "result_id", "original_code", ("original_code",))
    named = syntax.complexities(F.col("original_code"))
    return found.groupBy(*[c.alias(n) for n, c in named.items()]).agg(F.count(F.lit(1)).alias("n"))


def structural_patterns(spark: SparkSession, d: str) -> DataFrame:
    code = F.col("original_code")
    found = syntax.features(_codes(spark, d), "result_id", "original_code", ("original_code",))
    return found.groupBy(syntax.pattern(code).alias("pattern"), syntax.algorithm_pattern(code, text.algorithm_type(code)).alias("algorithm")).agg(
        F.count(F.lit(1)).alias("n")
    )


def valid_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Result rows by whether either code parses."""
    a = syntax.validity(_codes(spark, d), "result_id", "original_code", "original_valid", ("optimized_code",))
    b = syntax.validity(a, "result_id", "optimized_code", "optimized_valid", ("original_valid",))
    return b.groupBy("original_valid", "optimized_valid").agg(F.count(F.lit(1)).alias("n"))


def token_features(spark: SparkSession, d: str) -> DataFrame:
    return syntax.tokens(_codes(spark, d), "result_id", "optimized_code")


def token_types(spark: SparkSession, d: str) -> DataFrame:
    return syntax.token_counts(_codes(spark, d), "result_id", "optimized_code").groupBy("type").agg(F.sum("n").alias("n"))


def symbols_used(spark: SparkSession, d: str) -> DataFrame:
    """Names read and constants over all snippets, and in how many each stands."""
    found = syntax.symbols_used(_codes(spark, d), "result_id", "optimized_code")
    return found.groupBy("kind", "value").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_rows"))


def functions_defined(spark: SparkSession, d: str) -> DataFrame:
    return syntax.functions(table(spark, d, "feedback"), "id", "original_code")


def security_issues(spark: SparkSession, d: str) -> DataFrame:
    found = syntax.security(table(spark, d, "optimization_candidate"), "candidate_id", "optimized_code")
    return found.groupBy("severity", "what").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("candidate_id").alias("n_candidates"))


def node_types(spark: SparkSession, d: str) -> DataFrame:
    return syntax.nodes(_codes(spark, d), "result_id", "optimized_code").groupBy("node").agg(F.sum("n").alias("n"))


def rewrites_applied(spark: SparkSession, d: str) -> DataFrame:
    found = rewrite.rewrites(_codes(spark, d), "result_id", "original_code")
    return found.select(F.explode("rules").alias("rule"), "result_id").groupBy("rule").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("result_id").alias("n_rows")
    )


QUERIES = {
    f.__name__: f
    for f in (
        syntax_features, complexity_estimators, structural_patterns, valid_pairs, functions_defined, security_issues, node_types, rewrites_applied,
        feature_vectors, token_features, token_types, symbols_used,
    )
}
ORACLES: dict[str, str] = {}
