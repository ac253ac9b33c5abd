"""Explanations of a technique decision: weighted feature contributions and a rationale."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import code_patterns

# Weight of a feature in the decision for a technique; any other weighs 0.01.
WEIGHTS = {
    "hash_map": {"nested_loops": 0.35, "sum_pattern": 0.25, "comparison_pattern": 0.20, "pair_pattern": 0.15, "for_loops": 0.05},
    "hash_set": {"nested_loops": 0.30, "duplicate_pattern": 0.25, "comparison_pattern": 0.20, "membership_testing": 0.15, "has_nested_loops": 0.10},
    "dynamic_programming": {"nested_loops": 0.25, "max_pattern": 0.20, "sum_pattern": 0.20, "lines_of_code": 0.15, "conditional_complexity": 0.20},
    "two_pointers": {"nested_loops": 0.30, "sorting_usage": 0.25, "comparison_pattern": 0.20, "pair_pattern": 0.15, "for_loops": 0.10},
    "sliding_window": {"nested_loops": 0.25, "substring_pattern": 0.25, "max_pattern": 0.20, "conditional_complexity": 0.15, "for_loops": 0.15},
}
DEFAULT_WEIGHT, LEAST, SHOWN = 0.01, 0.01, 5


def weight(technique: Column, feature: Column) -> Column:
    table = {f"{t}|{f}": w for t, own in WEIGHTS.items() for f, w in own.items()}
    key = F.concat_ws("|", technique, feature)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), key), F.lit(DEFAULT_WEIGHT))


def impact(contribution: Column) -> Column:
    return F.when(contribution > 0.15, "High").when(contribution > 0.05, "Medium").otherwise("Low")


def contributions(df: DataFrame, key: str, technique: str, features: list[str]) -> DataFrame:
    """The greatest SHOWN contributions over LEAST of each row, ties by feature name.

    Ranked inside the row by an array sort: no shuffle.
    """
    parts = [
        F.struct(
            F.lit(name).alias("feature"),
            F.col(name).cast("double").alias("value"),
            F.round(F.col(name) * weight(F.col(technique), F.lit(name)), 6).alias("contribution"),
        )
        for name in features
    ]
    greatest = F.slice(F.expr("array_sort(parts, (a, b) -> CASE WHEN a.contribution > b.contribution THEN -1 WHEN a.contribution < b.contribution THEN 1 WHEN a.feature < b.feature THEN -1 ELSE 1 END)"), 1, SHOWN)
    kept = df.withColumn("parts", F.filter(F.array(*parts), lambda p: p["contribution"] > LEAST))
    return kept.select(key, F.posexplode(greatest).alias("place", "p")).select(
        key, (F.col("place") + 1).cast("long").alias("place"), "p.feature", "p.contribution", impact(F.col("p.contribution")).alias("impact")
    )


def rationale(technique: Column, before: Column, after: Column, confidence: Column) -> Column:
    """One sentence on the decision; unknown parts are left out."""
    title = F.initcap(F.replace(technique, F.lit("_"), F.lit(" ")))
    band = F.when(confidence > 0.7, "High").when(confidence > 0.4, "Medium").otherwise("Low")
    return F.concat_ws("; ", F.concat(title, F.lit(" was chosen")), F.concat(before, F.lit(" becomes "), after), F.concat(band, F.lit(" confidence")))


# Notes of the rule-based explanation.
NOTES = {
    "complexity": "- **Algorithmic Improvement**: The time/space complexity has been improved, resulting in better performance for larger inputs.",
    "loop": "- **Loop Optimization**: The loops have been optimized for better efficiency.",
    "unused": "- **Code Cleanup**: Unnecessary code has been removed, improving readability and maintenance.",
    "algorithm": "- **Algorithm Selection**: A more efficient algorithm has been selected for the task.",
}


def rule_based(rules: Column, before: Column, after: Column, lines_before: Column, lines_after: Column) -> Column:
    """An explanation in Markdown from the applied rules, both classes and both sizes; a missing class is unknown."""
    said = F.lower(F.coalesce(F.array_join(rules, " "), F.lit("")))
    says = lambda *words: reduce(Column.__or__, [said.contains(w) for w in words])
    note = lambda holds, name: F.when(holds, F.lit(NOTES[name] + "\n")).otherwise("")
    known = lambda c: F.coalesce(c, F.lit("unknown"))
    return F.concat(
        F.lit("# Code Optimization Explanation\n\n## Optimization Techniques Applied\n\n"),
        F.coalesce(F.array_join(F.transform(rules, lambda r: F.concat(F.lit("- "), r, F.lit("\n"))), ""), F.lit("")),
        F.lit("\n## Complexity Analysis\n\n- Original code complexity: "), known(before),
        F.lit("\n- Optimized code complexity: "), known(after),
        F.lit("\n- Original code size: "), lines_before.cast("string"), F.lit(" lines\n- Optimized code size: "), lines_after.cast("string"),
        F.lit(" lines\n\n## Improvements\n\n"),
        note(before != after, "complexity"), note(says("loop"), "loop"), note(says("dead code", "unused"), "unused"), note(says("algorithm", "pattern"), "algorithm"),
    )


def alternatives(depth: Column, compares: Column) -> Column:
    """Other techniques for nested loops: an array of (technique, applicability, reason), empty for depth below 2."""
    rows = (("Hash Map", F.when(compares > 0, "High").otherwise("Medium"), "lookups instead of nested loops"), ("Hash Set", F.lit("Medium"), "membership and duplicates"), ("Two Pointers", F.lit("Medium"), "sorted data"))
    some = F.array(*[F.struct(F.lit(t).alias("technique"), a.alias("applicability"), F.lit(r).alias("reason")) for t, a, r in rows])
    return F.when(depth >= 2, some).otherwise(F.slice(some, 1, 0))


def explanation(code: Column, technique: Column, confidence: Column, features: list[str]) -> Column:
    """One struct: summary, top contributions, patterns of the text, alternatives and the impact.

    ``features`` names the columns of the feature vector, among them nested_loops and comparison_pattern.
    """
    band = F.when(confidence > 0.7, "High").when(confidence > 0.4, "Medium").otherwise("Low")
    title = F.initcap(F.replace(technique, F.lit("_"), F.lit(" ")))
    parts = F.array(*[F.struct((-F.round(F.col(n) * weight(technique, F.lit(n)), 6)).alias("minus"), F.lit(n).alias("feature"), F.col(n).alias("value")) for n in features])
    shown = code_patterns(code)
    depth = F.col("nested_loops")
    known = technique.isin("hash_map", "hash_set", "dynamic_programming")
    return F.struct(
        F.concat(title, F.lit(" ("), F.format_string("%.1f%%", confidence * 100), F.lit(", "), band, F.lit(")")).alias("summary"),
        F.slice(F.array_sort(F.filter(parts, lambda p: p["minus"] < -LEAST)), 1, SHOWN).alias("top"),
        F.array_compact(F.array(*[F.when(c, n) for n, c in shown.items()])).alias("patterns"),
        alternatives(depth, F.col("comparison_pattern")).alias("alternatives"),
        F.when(known, F.concat(F.lit("O(n^"), depth.cast("int").cast("string"), F.lit(") → O(n)"))).otherwise("Significant improvement expected").alias("impact"),
    )
