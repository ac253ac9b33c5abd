"""Text-level features of source code as native column expressions (no Python in the plan)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def occurrences(code: Column, word: str) -> Column:
    """Non-overlapping occurrences of a substring."""
    return ((F.length(code) - F.length(F.replace(code, F.lit(word), F.lit("")))) / len(word)).cast("long")


def contains_any(code: Column, *words: str) -> Column:
    """1 if any of the substrings occurs, else 0."""
    return reduce(Column.__or__, [code.contains(w) for w in words]).cast("int")


def line_count(code: Column) -> Column:
    return F.size(F.split(code, "\n", -1)).cast("long")


def stripped_line_count(code: Column) -> Column:
    return line_count(F.btrim(code, F.lit(" \t\r\n")))


def loop_depth_by_indent(code: Column) -> Column:
    """Deepest indentation of a for or while line in fours, plus one; 0 without a loop."""
    bare = F.regexp_replace(code, "[\"'].*?[\"']", "")
    indents = F.regexp_extract_all(bare, F.lit(r"(?m)^([ \t]*)(?:for|while)\b"), F.lit(1))
    depth = F.floor(F.array_max(F.transform(indents, F.length)) / 4) + 1
    return F.coalesce(depth, F.lit(0)).cast("long")


#: The ten features of the training rows, in their order.
FEATURES10 = (
    "n_lines", "n_for", "n_while", "n_if", "n_range", "n_len", "has_two_for", "has_sum", "has_equal", "has_append",
)


def features10(code: Column) -> dict[str, Column]:
    return {
        "n_lines": line_count(code),
        "n_for": occurrences(code, "for"),
        "n_while": occurrences(code, "while"),
        "n_if": occurrences(code, "if"),
        "n_range": occurrences(code, "range"),
        "n_len": occurrences(code, "len"),
        "has_two_for": (occurrences(code, "for") >= 2).cast("int"),
        "has_sum": contains_any(code, "sum("),
        "has_equal": contains_any(code, "=="),
        "has_append": contains_any(code, "append"),
    }


def usage_flags(code: Column) -> dict[str, Column]:
    low = F.lower(code)
    return {
        "uses_dict": contains_any(code, "dict", "{}"),
        "uses_set": contains_any(code, "set("),
        "uses_list": contains_any(code, "list(", "[]"),
        "n_append": occurrences(code, "append"),
        "n_get": occurrences(code, "get("),
        "sum_pattern": code.rlike(r"\+.*==|sum\(").cast("int"),
        "comparison_pattern": code.rlike(r"==.*and|!=.*or").cast("int"),
        "uses_min_max": contains_any(code, "max(", "min("),
        "uses_sorting": contains_any(code, "sorted(", ".sort("),
        "uses_len": contains_any(code, "len("),
        "membership": (code.contains("in") & code.contains("for")).cast("int"),
        "says_substring": contains_any(low, "substr"),
        "says_duplicate": contains_any(low, "duplicate"),
        "says_pair": contains_any(low, "pair", "sum"),
        "says_extreme": contains_any(low, "maximum", "minimum"),
        "says_count": contains_any(low, "count"),
        "says_frequency": contains_any(low, "frequency"),
    }


def word_count(code: Column, pattern: str) -> Column:
    """Matches of a pattern that no ASCII letter, digit or underscore touches.

    The guard is spelled out because engines disagree on what a word boundary is.
    """
    spaced = F.regexp_replace(code, "([^A-Za-z0-9_])", "$1$1")
    guarded = F.concat(F.lit(" "), spaced, F.lit(" "))
    return F.regexp_count(guarded, F.lit(f"[^A-Za-z0-9_](?:{pattern})[^A-Za-z0-9_]")).cast("long")


# Keywords of the ladder of algorithm types, first match wins.
ALGORITHM_WORDS = (
    ("sorting", ("sort", "bubble", "quick", "merge", "heap")),
    ("search", ("search", "find", "locate")),
    ("graph", ("graph", "node", "edge", "vertex")),
    ("tree", ("tree", "bst", "binary search tree")),
    ("dynamic_programming", ("dynamic", "dp", "memoize", "fibonacci")),
)


def ladder(rules: list[tuple[Column, str]], otherwise: str | None) -> Column:
    """The value of the first condition that holds."""
    chain = F.when(rules[0][0], rules[0][1])
    for condition, value in rules[1:]:
        chain = chain.when(condition, value)
    return chain.otherwise(otherwise)


def algorithm_type(code: Column) -> Column:
    low = F.lower(code)
    return ladder([(contains_any(low, *words) == 1, name) for name, words in ALGORITHM_WORDS], "unknown")


# Patterns that tell a data structure, in the order in which they are listed.
STRUCTURES = (
    ("list", r"\[\s*\]|(^|[^A-Za-z0-9_])list\s*\("),
    ("dict", r"\{\s*\}|(^|[^A-Za-z0-9_])dict\s*\("),
    ("tuple", r"\(\s*\)|(^|[^A-Za-z0-9_])tuple\s*\("),
    ("set", r"(^|[^A-Za-z0-9_])set\s*\("),
    ("queue/stack", r"(^|[^A-Za-z0-9_])(deque|Queue|Stack)\s*\("),
    ("heap", r"(^|[^A-Za-z0-9_])(heap[A-Za-z0-9_]+\s*\(|priority_queue)"),
    ("custom_structure", r"(^|[^A-Za-z0-9_])(Node|Tree|Graph)([^A-Za-z0-9_]|$)"),
)


def data_structures(code: Column) -> Column:
    """Structures in use as one text, 'unknown' if there is none."""
    found = F.concat_ws(",", *[F.when(code.rlike(pattern), name) for name, pattern in STRUCTURES])
    return F.when(code.isNotNull(), F.coalesce(F.nullif(found, F.lit("")), F.lit("unknown")))


# Regular expressions of brute-force patterns over normalized code.
BRUTE_FORCE = (
    ("two_sum", r"for.*in.*range.*for.*in.*range.*if.*\+.*=="),
    ("duplicate_detection", r"for.*in.*for.*in.*if.*==.*and.*!="),
    ("max_subarray", r"for.*in.*range.*for.*in.*range.*max.*sum"),
    ("frequency_count", r"for.*in.*count.*==.*return"),
)
TEMPLATE_PATTERNS = (
    ("two_sum_pattern", r"for.*range.*for.*range.*\+.*==.*target"),
    ("contains_duplicate_pattern", r"for.*range.*for.*range.*==.*and.*!="),
    ("max_subarray_pattern", r"for.*range.*for.*range.*sum.*max"),
    ("count_pairs_pattern", r"for.*range.*for.*range.*\+.*==.*count"),
)


def normalized(code: Column, keep_comments: bool = False) -> Column:
    """Code on one line with single spaces, without comments unless they are kept."""
    bare = code if keep_comments else F.regexp_replace(code, "#[^\n]*", "")
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n\f\x0B]+", " "))


def first_pattern(code: Column, patterns: tuple[tuple[str, str], ...], keep_comments: bool = False) -> Column:
    text = F.lower(normalized(code, keep_comments))
    return ladder([(text.rlike(pattern.lower()), name) for name, pattern in patterns], None)


def function_name(code: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(code, r"def ([A-Za-z0-9_]+)\(", 1), F.lit("")), F.lit("main"))


def function_parameters(code: Column) -> Column:
    return F.regexp_extract(code, r"def [A-Za-z0-9_]+\(([^)]*)\):", 1)


def cache_key(code: Column) -> Column:
    return F.concat(F.lit("optimization:"), F.md5(code))


def without_fences(code: Column) -> Column:
    return F.btrim(F.replace(F.replace(code, F.lit("```python"), F.lit("")), F.lit("```"), F.lit("")), F.lit(" \t\r\n"))


def squeeze_blank_lines(code: Column, most: int = 2) -> Column:
    """At most ``most`` blank lines in a row; white space at line ends goes."""
    trimmed = F.regexp_replace(code, r"(?m)[ \t]+$", "")
    return F.regexp_replace(trimmed, "\n{%d,}" % (most + 2), "\n" * (most + 1))


def text_complexity(code: Column) -> Column:
    """Complexity class by loop depth in the text, sorting words breaking ties."""
    low, depth = F.lower(code), loop_depth_by_indent(code)
    return ladder(
        [
            (depth >= 3, "O(n³)"),
            (depth == 2, "O(n²)"),
            ((depth == 1) & low.contains("sort"), "O(n log n)"),
            (depth == 1, "O(n)"),
        ],
        "O(1)",
    )


def split_lines(code: Column) -> Column:
    """Lines as a reader splits them: any line end counts, the last one opens no new line, empty text has none."""
    plain = F.regexp_replace(code, "\r\n|[\r\x0b\x0c]", "\n")
    return F.when(F.length(plain) == 0, 0).otherwise(line_count(plain) - plain.endswith("\n").cast("int")).cast("long")


# Method names that count as operations of a data structure.
METHODS = {
    "list_operations": "append|extend|insert|remove|pop|sort|reverse",
    "dict_operations": "keys|values|items|get|pop|update",
    "set_operations": "add|remove|discard|union|intersection",
    "string_operations": "split|join|replace|strip|lower|upper",
}
# Words that speak for a complexity class.
CLASS_WORDS = {
    "o_1": ("return", "print", "=", "+", "-", "*", "/", "%"), "o_log_n": ("binary", "divide", "half", "//2", "/2"),
    "o_n": ("for", "while", "sum", "max", "min", "len"), "o_n_log_n": ("sort", "merge", "heap"), "o_n2": ("nested", "double", "bubble"),
    "o_2_n": ("recursive", "fibonacci", "exponential"),
}


def operation_counts(code: Column) -> dict[str, Column]:
    return {name: F.regexp_count(code, F.lit(rf"\.({words})")).cast("long") for name, words in METHODS.items()}


def class_words(code: Column) -> dict[str, Column]:
    """Words per complexity class, and the flags of four named patterns."""
    low = F.lower(code)
    counts = {name: reduce(Column.__add__, [occurrences(low, w) for w in words]) for name, words in CLASS_WORDS.items()}
    flags = {
        "fibonacci_pattern": low.contains("fibonacci") & code.contains("fibonacci(n-1)"),
        "factorial_pattern": low.contains("factorial") & code.contains("factorial(n-1)"),
        "binary_search_pattern": low.contains("binary") & code.contains("left") & code.contains("right"),
        "sorting_pattern": contains_any(low, "sort", "bubble", "merge", "quick") == 1,
    }
    return counts | {name: c.cast("int") for name, c in flags.items()}


def code_patterns(code: Column) -> dict[str, Column]:
    """Eight named patterns of the text, as booleans."""
    low = F.lower(code)
    return {
        "nested_loops_detected": occurrences(code, "for") >= 2,
        "equality_comparisons": code.contains("=="),
        "sum_operations": code.contains("+") | code.contains("sum("),
        "max_min_operations": code.contains("max(") | code.contains("min("),
        "list_operations": code.contains("append(") | code.contains(".extend("),
        "return_in_loop": code.contains("return") & code.contains("for"),
        "target_variable": code.contains("target"),
        "duplicate_keywords": low.contains("dup"),
    }


def comment_count(code: Column) -> Column:
    return occurrences(code, "#") + occurrences(code, '"""') + occurrences(code, "'''")


# Constant expressions that the plain folder replaces in the text.
FOLDS = (("2 * 3", "6"), ("10 / 2", "5.0"), ("2 ** 8", "256"), ("15 % 4", "3"), ("5 + 3", "8"), ("100 / 4", "25.0"), ("3 ** 3", "27"))


def folded_text(code: Column) -> Column:
    return reduce(lambda text, fold: F.replace(text, F.lit(fold[0]), F.lit(fold[1])), FOLDS, code)


def folds_applied(code: Column) -> Column:
    return F.concat_ws(",", *[F.when(code.contains(a), a) for a, _ in FOLDS])


def looks_like(code: Column) -> Column:
    """python, javascript or unknown, by what the text holds."""
    javascript = contains_any(code, "function", "const ", "let ", ";") == 1
    python = code.contains("def ") | code.contains("import ") | ~code.contains(";")
    return F.when(python, "python").when(javascript, "javascript").otherwise("unknown")


def modern_javascript(code: Column) -> Column:
    """``var`` assignments as ``const`` and counted loops over a whole array as for-of loops."""
    const = F.regexp_replace(code, r"var\s+([a-zA-Z0-9_]+)\s*=", "const $1 =")
    return F.regexp_replace(const, r"for\s*\(\s*let\s+i\s*=\s*0\s*;\s*i\s*<\s*(\w+)\.length\s*;\s*i\s*\+\+\s*\)\s*\{", "for (const item of $1) {")


def tidy_javascript(code: Column) -> Column:
    """Without line comments and console output, one statement a line."""
    steps = ((r"(?m)//.*$", ""), (r"console\.log\(.*?\);", ""), (r"\s+", " "), (r"\{\s+", "{"), (r"\s+\}", "}"), (";", ";\n"), (r"\{", "{\n"), (r"\}", "\n}"))
    return reduce(lambda text, step: F.regexp_replace(text, *step), steps, code)


def enumerated_loops(code: Column) -> Column:
    """``for i in range(len(x)):`` as ``for i, item in enumerate(x):`` by text alone."""
    return F.regexp_replace(code, r"for\s+(\w+)\s+in\s+range\(len\((\w+)\)\):", "for $1, item in enumerate($2):")


def improvement_score(before: Column, after: Column) -> Column:
    return (
        F.when(before.contains("n²") & after.contains("n log n"), 80)
        .when(before.contains("n²") & after.contains("n"), 90)
        .when(before.contains("n") & after.contains("log"), 85)
        .otherwise(50)
    )


def severity(complexity: Column) -> Column:
    """good, medium, poor, very poor or other: the first test that holds, so n log n falls to log."""
    rules = [(("1)", "log"), "good"), (("n log n",), "medium"), (("n²", "n^2"), "poor"), (("2^n", "n!"), "very poor")]
    return ladder([(contains_any(complexity, *words) == 1, name) for words, name in rules], "other")


def text_heuristics(code: Column, improved: Column, result: Column) -> tuple[Column, Column]:
    """Complexity before and after by words of the text, ``improved`` where anything was rewritten."""
    fib = code.contains("fibonacci") & code.contains("return fibonacci(n-1) + fibonacci(n-2)")
    sort = code.contains("sort") & (contains_any(code, "bubble", "selection") == 1)
    search = code.contains("search") & code.contains("for") & code.contains("range")
    before = F.when(fib, "O(2^n)").when(sort, "O(n²)").otherwise("O(n)")
    after = F.when(fib, "O(n)").when(sort & improved, "O(n log n)").when(~sort & search & improved & result.contains("binary"), "O(log n)").otherwise("O(n)")
    return before, after


def first_rule(code: Column) -> Column:
    """The first of four text conditions for a known speed-up, null if none holds."""
    both = code.contains("for i in range") & code.contains("for j in range")
    return (
        F.when(both & code.contains("total +=") & (code.contains("range(i)") | code.contains("range(n)")), "Mathematical formula")
        .when(both & (code.contains("arr[i] == arr[j]") | code.contains("nums[i] == nums[j]")), "Hash set for O(1) lookup")
        .when(both & (code.contains("target") | code.contains("sum")) & code.contains("+"), "Hash map for complement lookup")
        .when(both & code.contains("sum"), "Kadane's algorithm")
    )


def generation_route(code: Column, technique: Column) -> Column:
    """Which generator a snippet goes to, by words of the text, of the function's name, then the technique."""
    name = F.regexp_extract(code, r"def ([A-Za-z0-9_]+)\((.*?)\):", 1)
    low, low_name = F.lower(code), F.lower(name)
    return (
        F.when(name == "", "unchanged")
        .when(low.contains("pairs") | low_name.contains("sum"), "pairs_sum")
        .when(low.contains("duplicate") | low_name.contains("duplicate"), "duplicate")
        .when(low.contains("max") & low_name.contains("subarray"), "max_subarray")
        .when(technique.isin("hash_map", "hash_set"), technique)
        .otherwise("generic")
    )


# Regular expressions that recognize whole algorithms; a back reference ties names together.
ALGORITHMS = (
    ("bubble_sort", r"def\s+(?:\w*sort\w*|\w*bubble\w*)\s*\([^)]*\):.*?for\s+\w+\s+in\s+range.*?for\s+\w+\s+in\s+range.*?if\s+(\w+)\s*\[\s*\w+\s*\]\s*>\s*\1\s*\[\s*\w+(?:\s*\+\s*\d+)?\s*\]"),
    ("selection_sort", r"def\s+\w*sort\w*\s*\(.*?\):.*?for\s+\w+\s+in\s+range\(.*?\):.*?(?:min_idx|min_pos|min_i|min_element|smallest)\s*=\s*\w+.*?for\s+\w+\s+in\s+range\(.*?\):"),
    ("linear_search", r"def\s+(\w*(?:search|find)\w*)\s*\([^)]*\):.*?for\s+\w+\s+in\s+range.*?if\s+\w+\s*\[\s*\w+\s*\]\s*=="),
    ("recursive_fibonacci", r"def\s+(\w*(?:fibonacci|fib|fibo)\w*)\s*\(\s*(\w+)\s*\):.*?if\s+\2\s*(?:<=|<|==|>|>=)\s*\d+.*?return.*?return\s+\1\s*\(\s*\2\s*-\s*1\s*\)\s*\+\s*\1\s*\(\s*\2\s*-\s*2\s*\)"),
    ("list_building", r"(\w+)\s*=\s*\[\]\s*.*?for\s+(\w+)\s+in\s+([^:]+):.*?\1\.append\(([^)]+)\)"),
)


def recognized_algorithm(code: Column) -> Column:
    """The first whole algorithm that the text shows, null if none; line ends count as any character."""
    return ladder([(code.rlike("(?s)" + pattern), name) for name, pattern in ALGORITHMS], None)
