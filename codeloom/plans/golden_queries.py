"""Syntax operators on an in-repo table of snippets, with hand-counted results as SQL.

No SQL can parse code, so these queries run over SNIPPETS instead of a table, and their SQL lists what a
reader counts in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import rewrite, syntax, text

SNIPPETS = {
    1: """def pairs(nums, target):
    for i in range(len(nums)):
        for j in range(i + 1, len(nums)):
            if nums[i] + nums[j] == target:
                return [i, j]
    return []""",
    2: """def fibonacci(n):
    if n <= 1:
        return n
    return fibonacci(n - 1) + fibonacci(n - 2)""",
    3: """def binary_search(rows, wanted):
    left, right = 0, len(rows) - 1
    while left <= right:
        mid = (left + right) // 2
        if rows[mid] == wanted:
            return mid
        if rows[mid] < wanted:
            left = mid + 1
        else:
            right = mid - 1
    return -1""",
    4: """def cubes(n):
    total = 0
    for a in range(n):
        for b in range(n):
            for c in range(n):
                total += a * b * c
    return total""",
    5: """def ordered(v):
    if len(v) < 2:
        return v
    half = len(v) // 2
    return join(ordered(v[:half]), ordered(v[half:]))""",
    6: """def two_passes(v):
    out = []
    for x in v:
        out.append(x)
    while out:
        out.pop()
    return sorted(v)""",
    7: "def broken(:",
    8: "",
    9: """import os
def run(text):
    open('x')
    return eval(text)""",
    10: "squares = [x * x for x in sorted(values)]",
    11: """def repeated(rows):
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and rows[i] == rows[j]:
                return True
    return False""",
}


def snippets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SNIPPETS.items()), "id long, code string")


def _features(spark: SparkSession) -> DataFrame:
    return syntax.features(snippets(spark), "id", "code", ("code",))


def golden_features(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark).select("id", "valid", *COUNTED)


def golden_complexities(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark).select("id", *[c.alias(n) for n, c in syntax.complexities(F.col("code")).items()])


def golden_patterns(spark: SparkSession, d: str) -> DataFrame:
    code = F.col("code")
    return _features(spark).select(
        "id", syntax.pattern(code).alias("pattern"), syntax.algorithm_pattern(code, text.algorithm_type(code)).alias("algorithm"), text.recognized_algorithm(code).alias("recognized")
    )


def golden_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The 30, 20 and 7 features, each as one text."""
    code = F.col("code")

    def shown(columns: dict[str, Column]) -> Column:
        return F.concat_ws(" ", *[c.cast("int").cast("string") for c in columns.values()])

    return _features(spark).select(
        "id", shown(syntax.features30(code)).alias("f30"), shown(syntax.features20(code)).alias("f20"), shown(syntax.features7(code)).alias("f7")
    )


def golden_functions(spark: SparkSession, d: str) -> DataFrame:
    return syntax.functions(snippets(spark), "id", "code")


def golden_security(spark: SparkSession, d: str) -> DataFrame:
    return syntax.security(snippets(spark), "id", "code")


def golden_tokens(spark: SparkSession, d: str) -> DataFrame:
    return syntax.tokens(snippets(spark).where("id IN (2, 8, 10)"), "id", "code").select("id", "n_tokens", "n_unique", "n_operators", "n_name_tokens", "n_number_tokens")


#: Snippets that the rewrites change.
REWRITES = {
    1: "x = 2 * 3 + 2\ny = 10 / 4",
    2: SNIPPETS[2],
    3: """def ordered(v):
    n = len(v)
    for i in range(n):
        for j in range(n - i - 1):
            if v[j] > v[j + 1]:
                v[j], v[j + 1] = v[j + 1], v[j]
    return v""",
    4: """def place(rows, wanted):
    for i in range(len(rows)):
        if rows[i] == wanted:
            return i
    return -1""",
    5: "def ends(v):\n    return sorted(v)[-1] - sorted(v)[0]",
    6: """def text(parts):
    out = ''
    for p in parts:
        out += p
    return out""",
    7: """def show(rows):
    for i in range(len(rows)):
        print(rows[i])""",
    8: """def picked(v):
    out = []
    for x in v:
        if x > 2:
            out.append(x * x)
    return out""",
    9: "def both(v):\n    return list(map(lambda x: x + 1, v)) + list(filter(lambda x: x > 1, v))",
    10: """def early(v):
    unused = 3
    return v
    print(v)""",
    11: """def often(v):
    total = len(v)
    for x in v[1:]:
        total += len(v) * len(v)
    return total""",
    12: """def less(a, b):
    if a < b and a != b:
        return True
    return False""",
    13: "if False:\n    x = 1\nelse:\n    x = 2",
    14: "def broken(:",
}


def golden_rewrites(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(list(REWRITES.items()), "id long, code string")
    return rewrite.rewrites(rows, "id", "code").select("id", "rewritten", F.array_join("rules", ",").alias("rules"))


#: Features that golden_features shows.
COUNTED = (
    "loop_depth n_for n_while n_functions n_ifs n_calls n_plain_assigns n_returns self_calls has_base_case control_depth n_list_calls5 uses_slicing"
).split()

QUERIES = {
    f.__name__: f
    for f in (
        golden_features, golden_complexities, golden_patterns, golden_vectors, golden_functions, golden_security, golden_tokens, golden_rewrites,
    )
}


def values(names: list[str], rows: list[tuple], **kinds: str) -> str:
    """SQL of a table that lists ``rows``; ``kinds`` gives a column another type."""

    def shown(v: object) -> str:
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    kinds = {"id": "BIGINT"} | kinds
    columns = ", ".join(f"{n}::{kinds[n]} AS {n}" if n in kinds else n for n in names)
    return f"SELECT {columns} FROM (VALUES " + ", ".join("(" + ", ".join(map(shown, row)) + ")" for row in rows) + f") AS t({', '.join(names)})"


# Hand-counted results.
ORACLES = {
    "golden_features": values(
        ["id", "valid", *COUNTED],
        [
            (1, True, 2, 2, 0, 1, 1, 4, 0, 2, 0, 0, 4, 0, 0),
            (2, True, 0, 0, 0, 1, 1, 2, 0, 2, 2, 1, 2, 0, 0),
            (3, True, 1, 0, 1, 1, 2, 1, 4, 2, 0, 0, 3, 0, 0),
            (4, True, 3, 3, 0, 1, 0, 3, 1, 1, 0, 0, 4, 0, 0),
            (5, True, 0, 0, 0, 1, 1, 5, 1, 2, 2, 1, 2, 0, 1),
            (6, True, 1, 1, 1, 1, 0, 3, 1, 1, 0, 0, 2, 2, 0),
            (7, False, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
            (8, True, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
            (9, True, 0, 0, 0, 1, 0, 2, 0, 1, 0, 0, 1, 0, 0),
            (10, True, 0, 0, 0, 0, 0, 1, 1, 0, 0, 0, 0, 0, 0),
            (11, True, 2, 2, 0, 1, 1, 4, 0, 2, 0, 0, 4, 0, 0),
        ],
    ),
    "golden_complexities": values(
        ["id", "by_depth", "space", "by_recursion", "by_words", "by_loop_count", "by_visitor", "by_features", "by_stack"],
        [
            (1, "O(n²)", "O(1)", "O(n²)", "O(n²)", "O(n²)", "O(n²)", "O(n²)", "O(n²)"),
            (2, "O(1)", "O(1)", "O(2^n)", "O(2^n)", "O(1)", "O(2^n)", "O(2^n)", "O(1)"),
            (3, "O(n)", "O(1)", "O(n)", "O(n)", "O(n)", "O(log n)", "O(n)", "O(n)"),
            (4, "O(n³)", "O(1)", "O(n²)", "O(n²)", "O(n³)", "O(n³)", "O(n²)", "O(n^3)"),
            (5, "O(1)", "O(1)", "O(n)", "O(1)", "O(1)", "O(n)", "O(1)", "O(1)"),
            (6, "O(n log n)", "O(1)", "O(n)", "O(n)", "O(n²)", "O(n)", "O(n²)", "O(n)"),
            (7, "Unknown", "Unknown", "O(n)", "O(1)", "O(1)", "O(n)", "O(1)", "O(?)"),
            (8, "O(1)", "O(1)", "O(1)", "O(1)", "O(1)", "O(1)", "O(1)", "O(?)"),
            (9, "O(1)", "O(1)", "O(1)", "O(1)", "O(1)", "O(1)", "O(1)", "O(1)"),
            (10, "O(1)", "O(1)", "O(1)", "O(n log n)", "O(1)", "O(1)", "O(1)", "O(1)"),
            (11, "O(n²)", "O(1)", "O(n²)", "O(n²)", "O(n²)", "O(n²)", "O(n²)", "O(n²)"),
        ],
    ),
    "golden_patterns": values(
        ["id", "pattern", "algorithm", "recognized"],
        [
            (1, "two_sum", "iterative_simple", None),
            (2, None, "recursive", "recursive_fibonacci"),
            (3, None, "logarithmic", None),
            (4, "nested_sum", "iterative_nested", None),
            (5, None, "recursive_divide_conquer", None),
            (6, None, "iterative_simple", "list_building"),
            (7, None, None, None),
            (8, None, "constant", None),
            (9, None, "constant", None),
            (10, None, "constant", None),
            (11, "contains_duplicate", "iterative_simple", None),
        ],
    ),
    "golden_vectors": values(
        ["id", "f30", "f20", "f7"],
        [
            (1, "2 4 0 1 0 6 2 0 2 0 0 0 1 0 0 1 0 0 0 1 1 0 1 1 0 0 1 0 0 0", "2 4 0 1 0 1 0 1 0 0 0 0 1 0 1 0 0 0 0 0", "185 6 1 2 2 0 1"),
            (2, "0 2 0 1 0 4 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 1 0 0 0 0 0 0", "0 2 0 1 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0", "96 4 1 0 0 1 1"),
            (3, "1 1 4 2 0 11 0 1 0 0 0 0 0 0 0 0 0 0 0 1 0 0 0 2 0 0 0 0 0 0", "1 1 4 2 0 0 0 1 0 0 0 0 0 1 0 0 0 0 0 0", "295 11 1 1 1 0 2"),
            (4, "3 3 1 0 0 7 3 0 3 0 0 0 0 0 0 0 0 0 0 0 1 1 1 0 0 0 0 0 0 0", "3 3 1 0 0 1 0 0 0 0 0 0 0 0 0 0 0 0 0 0", "160 7 1 3 3 0 0"),
            (5, "0 5 1 1 0 5 0 0 0 0 0 0 0 0 0 0 0 0 0 1 0 0 0 1 0 0 0 0 0 0", "0 5 1 1 0 0 0 1 0 1 0 0 0 0 0 0 0 0 0 0", "128 5 1 0 0 1 1"),
            (6, "1 3 1 0 2 7 1 1 0 0 0 0 1 1 0 0 0 0 1 0 0 0 1 0 0 0 0 0 0 0", "1 3 1 0 1 0 0 1 1 0 0 0 1 0 0 0 0 0 0 0", "123 7 1 2 2 0 0"),
            (7, "0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0", "0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0", "12 1 0 0 0 0 0"),
            (8, "0 0 0 0 0 1 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0", "0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0", "0 1 0 0 0 0 0"),
            (9, "0 2 0 0 0 4 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0", "0 2 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0", "60 4 1 0 0 0 0"),
            (10, "0 1 1 0 0 1 1 0 0 0 0 0 0 0 0 0 0 0 1 0 0 0 1 0 0 0 0 0 0 0", "0 1 1 0 0 0 1 1 1 0 0 0 0 0 0 0 0 0 0 0", "41 1 0 0 0 0 0"),
            (11, "2 4 0 1 0 6 2 0 2 0 0 0 0 0 0 0 0 0 0 1 1 0 1 1 0 0 0 0 0 0", "2 4 0 1 0 1 0 1 0 0 0 0 0 0 0 0 0 0 0 0", "176 6 1 2 2 0 1"),
        ],
    ),
    "golden_functions": values(
        ["id", "name", "n_args", "first_line", "last_line", "has_return"],
        [
            (1, "pairs", 2, 1, 6, True),
            (2, "fibonacci", 1, 1, 4, True),
            (3, "binary_search", 2, 1, 11, True),
            (4, "cubes", 1, 1, 7, True),
            (5, "ordered", 1, 1, 5, True),
            (6, "two_passes", 1, 1, 7, True),
            (9, "run", 1, 2, 4, True),
            (11, "repeated", 1, 1, 6, True),
        ],
    ),
    "golden_security": values(
        ["id", "severity", "what", "line"],
        [
            (7, "medium", "syntax error", None),
            (9, "critical", "call eval", 4),
            (9, "critical", "call open", 3),
            (9, "high", "import os", 1),
        ],
    ),
    "golden_tokens": values(
        ["id", "n_tokens", "n_unique", "n_operators", "n_name_tokens", "n_number_tokens"],
        [
            (2, 29, 15, 4, 12, 3),
            (8, 0, 0, 0, 0, 0),
            (10, 16, 14, 1, 8, 0),
        ],
    ),
    "golden_rewrites": values(
        ["id", "rewritten", "rules"],
        [
            (1, "x = 8\ny = 2.5", "constant_folding,constant_folding,constant_folding"),
            (2, "def fibonacci(n):\n    if n <= 1:\n        return n\n    a, b = (0, 1)\n    for _ in range(n - 1):\n        a, b = (b, a + b)\n    return b", "iterative_fibonacci"),
            (3, "def ordered(v):\n    n = len(v)\n    v.sort()\n    return v", "bubble_sort"),
            (4, "def place(rows, wanted):\n    return rows.index(wanted) if wanted in rows else -1", "linear_search"),
            (5, "def ends(v):\n    return max(v) - min(v)", "sorted_end,sorted_end"),
            (6, "def text(parts):\n    return ''.join((p for p in parts))", "joined_text,direct_return"),
            (7, "def show(rows):\n    for value_i in rows:\n        print(value_i)", "direct_loop"),
            (8, "def picked(v):\n    out = [x * x for x in v if x > 2]\n    return out", "list_comprehension"),
            (9, "def both(v):\n    return [x + 1 for x in v] + [x for x in v if x > 1]", "comprehension,comprehension"),
            (10, "def early(v):\n    return v", "unreachable_code,unused_variable"),
            (11, "def often(v):\n    len_v = len(v)\n    total = len_v\n    for x in v[1:]:\n        total += len_v * len_v\n    return total", "length_once"),
            (12, "def less(a, b):\n    return a < b", "implied_comparison,boolean_return"),
            (13, "x = 2", "dead_branch"),
            (14, "def broken(:", ""),
        ],
    ),
}
