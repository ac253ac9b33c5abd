"""A catalogue of problems with a slow and a fast solution, and the operators on such catalogues."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FLAT = "title string, category string, difficulty string, brute_force string, optimized string, technique string, complexity_improvement string, data_structure string"

#: Slow and fast code of each problem: (title, category, difficulty, slow, fast, technique, before, after, structure, source).
PROBLEMS = [
    ("Pair With Sum", "arrays", "Easy", "def pair(v, goal):\n    return [(i, j) for j in range(len(v)) for i in range(j) if v[i] + v[j] == goal]",
     "def pair(v, goal):\n    at = {}\n    for j, x in enumerate(v):\n        if goal - x in at:\n            return at[goal - x], j\n        at[x] = j", "hash_map", "O(n²)", "O(n)", "dict", "judge"),
    ("Any Repeats", "arrays", "Easy", "def repeats(v):\n    return any(v[i] == v[j] for i in range(len(v)) for j in range(i))",
     "def repeats(v):\n    return len(set(v)) < len(v)", "hash_set", "O(n²)", "O(n)", "set", "judge"),
    ("Best Run", "arrays", "Medium", "def best(v):\n    return max(sum(v[i:j]) for i in range(len(v)) for j in range(i + 1, len(v) + 1))",
     "def best(v):\n    run = top = v[0]\n    for x in v[1:]:\n        run = max(x, run + x)\n        top = max(top, run)\n    return top", "dynamic_programming", "O(n³)", "O(n)", "variables", "judge"),
    ("Same Letters", "strings", "Easy", "def same(a, b):\n    return sorted(a) == sorted(b)",
     "def same(a, b):\n    from collections import Counter\n    return Counter(a) == Counter(b)", "frequency_map", "O(n log n)", "O(n)", "Counter", "course"),
    ("Longest Without Repeat", "strings", "Medium", "def longest(s):\n    return max((j - i for i in range(len(s)) for j in range(i + 1, len(s) + 1) if len(set(s[i:j])) == j - i), default=0)",
     "def longest(s):\n    seen, low, top = {}, 0, 0\n    for i, c in enumerate(s):\n        low = max(low, seen.get(c, -1) + 1)\n        seen[c], top = i, max(top, i - low + 1)\n    return top", "sliding_window", "O(n³)", "O(n)", "dict", "course"),
    ("Common Items", "arrays", "Easy", "def common(a, b):\n    return [x for x in a if x in b]",
     "def common(a, b):\n    return list(set(a) & set(b))", "set_intersection", "O(n²)", "O(n)", "set", "course"),
    ("Steps Up", "dp", "Easy", "def steps(n):\n    return 1 if n < 2 else steps(n - 1) + steps(n - 2)",
     "def steps(n):\n    a, b = 1, 1\n    for _ in range(n):\n        a, b = b, a + b\n    return a", "dynamic_programming", "O(2^n)", "O(n)", "variables", "contest"),
    ("Loot", "dp", "Medium", "def loot(v):\n    return max(v[0] + loot(v[2:]), loot(v[1:])) if v else 0",
     "def loot(v):\n    a = b = 0\n    for x in v:\n        a, b = b, max(b, a + x)\n    return b", "dynamic_programming", "O(2^n)", "O(n)", "variables", "contest"),
    ("Kth Largest", "sorting", "Medium", "def kth(v, k):\n    return sorted(v)[-k]",
     "def kth(v, k):\n    import heapq\n    return heapq.nlargest(k, v)[-1]", "heap", "O(n log n)", "O(n log k)", "heap", "contest"),
    ("Islands", "graphs", "Medium", "def islands(g):\n    todo = {(i, j) for i, r in enumerate(g) for j, c in enumerate(r) if c}\n    return sum(1 for p in todo if not any(q < p for q in todo))",
     "def islands(g):\n    todo, n = {(i, j) for i, r in enumerate(g) for j, c in enumerate(r) if c}, 0\n    while todo:\n        n, edge = n + 1, [todo.pop()]\n        while edge:\n            i, j = edge.pop()\n            near = {(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)} & todo\n            todo -= near\n            edge += near\n    return n", "bfs", "O(n²)", "O(n)", "set", "judge"),
    ("Level Order", "trees", "Medium", "def levels(t):\n    return [] if t is None else [[t.value]] + levels(t.left) + levels(t.right)",
     "def levels(t):\n    out, row = [], [t] if t else []\n    while row:\n        out.append([x.value for x in row])\n        row = [y for x in row for y in (x.left, x.right) if y]\n    return out", "bfs", "O(n²)", "O(n)", "queue", "course"),
    ("Broken Row", "trees", "Hard", "def broken(:", "pass", "bfs", "O(n)", "O(n)", "queue", "contest"),
]

#: (original, optimized, before, after, explanation, rule, category) of the synthetic generators.
PAIRS = [(p[3], p[4], p[6], p[7], f"{p[0]} by {p[5]}", p[5], p[1]) for p in PROBLEMS[:5]]
LOOPS = [
    ("total = 0\nfor x in v:\n    total += x", "total = sum(v)", "O(n)", "O(n)", "sum instead of a loop", "builtin", "loop"),
    ("top = v[0]\nfor x in v:\n    if x > top:\n        top = x", "top = max(v)", "O(n)", "O(n)", "max instead of a loop", "builtin", "loop"),
    ("out = []\nfor x in v:\n    out.append(x * x)", "out = [x * x for x in v]", "O(n)", "O(n)", "a comprehension instead of a loop", "list_comprehension", "loop"),
]
SIX = [
    ("x = v[0]", "x = v[0]", "O(1)", "O(1)", "one access", "none", "complexity"),
    ("while n > 1:\n    n //= 2", "n.bit_length()", "O(log n)", "O(1)", "halving", "builtin", "complexity"),
    ("for x in v:\n    print(x)", "for x in v:\n    print(x)", "O(n)", "O(n)", "one pass", "none", "complexity"),
    ("sorted(v)[0]", "min(v)", "O(n log n)", "O(n)", "the end of a sorted list", "builtin", "complexity"),
    ("[x for x in a if x in b]", "set(a) & set(b)", "O(n²)", "O(n)", "a set for membership", "hash_set", "complexity"),
    ("steps(n - 1) + steps(n - 2)", "steps.cache[n]", "O(2^n)", "O(n)", "kept results", "dynamic_programming", "complexity"),
]


def flat(spark: SparkSession) -> DataFrame:
    """The catalogue under its flat schema."""
    return spark.createDataFrame([(p[0], p[1], p[2], p[3], p[4], p[5], f"{p[6]} -> {p[7]}", p[8]) for p in PROBLEMS], FLAT)


def sourced(spark: SparkSession, sources: list[str] | None = None) -> DataFrame:
    """Rows with their source and number, without a category; only those of ``sources`` if given."""
    rows = [(p[0], p[2], p[3], p[4], p[5], p[9], i, f"{p[6]} -> {p[7]}") for i, p in enumerate(PROBLEMS)]
    out = spark.createDataFrame(rows, "title string, difficulty string, brute_force string, optimized string, technique string, source string, problem_id int, complexity_improvement string")
    return out if sources is None else out.where(F.col("source").isin(sources))


def nested(spark: SparkSession) -> DataFrame:
    """Rows with one struct for each solution and tags."""
    solution = lambda code, cls: F.struct(code.alias("code"), cls.alias("complexity"), F.lit("O(n)").alias("space_complexity"), F.col("technique").alias("explanation"))
    halves = F.split("complexity_improvement", " -> ")
    return flat(spark).select(
        slug("title").alias("problem_id"), F.col("title").alias("problem_name"),
        solution(F.col("brute_force"), halves[0]).alias("naive_solution"), solution(F.col("optimized"), halves[1]).alias("optimized_solution"),
        F.col("technique").alias("optimization_technique"), F.array("category", "technique").alias("tags"), "difficulty",
    )


def slug(title: str) -> F.Column:
    return F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-")


def by_slug(spark: SparkSession, slugs: list[str]) -> DataFrame:
    """The catalogue rows of a list of slugs; slugs without a row are dropped. The list is fixed and small."""
    wanted = spark.createDataFrame([(s,) for s in slugs], "slug string")
    return F.broadcast(wanted).join(flat(spark).withColumn("slug", slug("title")), "slug")


#: Names that variations give to variables; the first is used.
RENAMES = ({"i": "idx", "j": "pos", "v": "data"}, {"i": "a", "j": "b", "v": "numbers"}, {"i": "left", "j": "right", "v": "items"})


def renamed(code: F.Column, names: dict[str, str]) -> F.Column:
    """Identifiers renamed at their boundaries, so that ``if`` and ``in`` stay."""
    for old, new in names.items():
        code = F.regexp_replace(code, rf"(?<![A-Za-z0-9_.]){re.escape(old)}(?![A-Za-z0-9_])", new)
    return code


def variations(catalogue: DataFrame, per_category: int = 2) -> DataFrame:
    """The first rows of each category by title, with other variable names and a marked title."""
    place = F.row_number().over(Window.partitionBy("category").orderBy("title"))
    first = catalogue.withColumn("_place", place).where(F.col("_place") <= per_category).drop("_place")
    changed = {c: renamed(F.col(c), RENAMES[0]) for c in ("brute_force", "optimized")}
    return first.withColumns({**changed, "title": F.concat("title", F.lit(" (Variation)"))})


def training_pairs(catalogue: DataFrame) -> DataFrame:
    """(original_code, optimized_code, technique, complexity_improvement) of flat rows."""
    return catalogue.select(F.col("brute_force").alias("original_code"), F.col("optimized").alias("optimized_code"), "technique", "complexity_improvement")


def training_columns(pairs: DataFrame) -> DataFrame:
    """One row of parallel arrays, for catalogues; rows keep the order of their code."""
    rows = F.array_sort(F.collect_list(F.struct("original_code", "optimized_code", "technique", "complexity_improvement")))
    lists = {"originals": "original_code", "optimized": "optimized_code", "techniques": "technique", "complexity_improvements": "complexity_improvement"}
    return pairs.agg(rows.alias("r")).select(*[F.col("r")[f].alias(n) for n, f in lists.items()])

