"""Small fixed dimensions and the scores that are looked up in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rank of a complexity class (speedup scale), 3 for any other.
SPEEDUP_RANK = {"O(1)": 1, "O(log n)": 2, "O(n)": 3, "O(n log n)": 4, "O(n²)": 5, "O(n³)": 6}
# Rank of a complexity class (percentage scale), 3 for any other.
PERCENT_RANK = {"O(1)": 1, "O(log n)": 2, "O(n)": 3, "O(n log n)": 4, "O(n²)": 5, "O(2^n)": 10}
# Run time multiplier of a complexity class, 100 for any other.
RUNTIME_MULTIPLIER = {"O(1)": 1, "O(log n)": 10, "O(n)": 100, "O(n log n)": 1000, "O(n²)": 10000, "O(2^n)": 1000000}
# Complexity and data structure that a technique leads to.
TECHNIQUES = {
    "hash_map": ("O(n)", "Dictionary/HashMap"),
    "hash_set": ("O(n)", "Set/HashSet"),
    "dynamic_programming": ("O(n)", "Array/Variables"),
    "two_pointers": ("O(n log n)", "Sorted Array"),
    "set_intersection": ("O(n + m)", "Set Operations"),
    "frequency_map": ("O(n)", "Dictionary/Counter"),
}


def lookup(key: Column, table: dict[str, object], default: object) -> Column:
    """A left join with a fixed dimension, as a literal map: no shuffle and no join."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def canonical_class(complexity: Column) -> Column:
    """One spelling per complexity class: case of n, powers, spaces around."""
    low = F.lower(F.trim(complexity))
    plain = F.replace(F.replace(low, F.lit("^2)"), F.lit("²)")), F.lit("^3)"), F.lit("³)"))
    return F.regexp_replace(plain, r"^o\(", "O(")


def speedup_factor(before: Column, after: Column) -> Column:
    gain = lookup(before, SPEEDUP_RANK, 3) - lookup(after, SPEEDUP_RANK, 3)
    return F.when(gain > 0, F.pow(F.lit(2), gain)).otherwise(1).cast("int")


def improvement_percent(before: Column, after: Column, changed: Column) -> Column:
    x, y = lookup(before, PERCENT_RANK, 3), lookup(after, PERCENT_RANK, 3)
    return F.when(x > y, (x - y) * 100.0 / x).when(changed, 10.0).otherwise(0.0)


def runtime_estimate(complexity: Column, length: Column) -> Column:
    return F.lit(1e-6) * lookup(complexity, RUNTIME_MULTIPLIER, 100) * length / 100


# Description, complexity, data structure and use of a technique's template; others have none.
TEMPLATES = {
    "hash_map": ("Hash Map Optimization", "O(n)", "Dictionary/HashMap", "Two sum, complement search, key-value mapping"),
    "hash_set": ("Hash Set Optimization", "O(n)", "Set/HashSet", "Duplicate detection, membership testing"),
    "dynamic_programming": ("Dynamic Programming", "O(n)", "Array/Variables", "Optimal substructure, overlapping subproblems"),
    "two_pointers": ("Two Pointers Technique", "O(n) or O(n log n)", "Sorted Array", "Sorted array problems, pair finding"),
    "sliding_window": ("Sliding Window", "O(n)", "Window/Deque", "Subarray problems, range queries"),
    "frequency_map": ("Frequency Counter", "O(n)", "Dictionary", "Counting, frequency analysis"),
}


def theoretical_gains(factor: Column) -> Column:
    """What a speed-up factor is said to give for 100, 1,000 and 10,000 elements; null without a gain."""
    return F.when(factor > 1, F.concat_ws("; ", *[F.concat((factor * n).cast("string"), F.lit(f"x faster for {n:,} elements")) for n in (100, 1000, 10000)]))
