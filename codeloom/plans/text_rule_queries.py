"""Text rules over the code tables: operations, class words, patterns, folds, scores, routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import dims, generate, text
from codeloom.sources.tables import table


def _results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "optimization_result")


def _sums(df: DataFrame, columns: dict) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c.cast("long")).alias(n) for n, c in columns.items()])


def operation_counts(spark: SparkSession, d: str) -> DataFrame:
    code = F.col("optimized_code")
    rows = _results(spark, d).where("optimized_code IS NOT NULL")
    return rows.select("result_id", *[c.alias(n) for n, c in text.operation_counts(code).items()], text.split_lines(code).alias("n_lines"), text.comment_count(code).alias("n_comments"))


def class_words(spark: SparkSession, d: str) -> DataFrame:
    return _sums(table(spark, d, "feedback").where("original_code IS NOT NULL"), text.class_words(F.col("original_code")))


def code_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Rows per list of detected patterns with the three indicators derived from them."""
    found = text.code_patterns(F.col("original_code"))
    rows = table(spark, d, "feedback").where("original_code IS NOT NULL").select(*[c.alias(n) for n, c in found.items()])
    return rows.groupBy(
        F.concat_ws(",", *[F.when(F.col(n), n) for n in found]).alias("patterns"),
        F.col("nested_loops_detected").alias("nested_structure"),
        (F.col("equality_comparisons") & F.col("nested_loops_detected")).alias("search_pattern"),
        (F.col("sum_operations") | F.col("max_min_operations")).alias("accumulation_pattern"),
    ).agg(F.count(F.lit(1)).alias("n"))


def literal_folds(spark: SparkSession, d: str) -> DataFrame:
    code = F.col("original_code")
    rows = _results(spark, d).where("original_code IS NOT NULL")
    return rows.select("result_id", F.md5(text.folded_text(code)).alias("digest"), text.folds_applied(code).alias("folds"))


def offline_rewrites(spark: SparkSession, d: str) -> DataFrame:
    """Rewrites by text alone, for the language that the text looks like."""
    code = F.col("optimized_code")
    rows = _results(spark, d).where("optimized_code IS NOT NULL")
    return rows.select(
        "result_id",
        text.looks_like(code).alias("language"),
        F.md5(text.modern_javascript(code)).alias("modern"),
        F.md5(text.tidy_javascript(code)).alias("tidy"),
        F.md5(text.enumerated_loops(code)).alias("enumerated"),
    )


def text_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores and labels that the text and the stated classes give."""
    a, b = F.col("original_code"), F.col("optimized_code")
    x, y = dims.canonical_class(F.col("complexity_before")), dims.canonical_class(F.col("complexity_after"))
    before, after = text.text_heuristics(a, a != b, b)
    return _results(spark, d).where(a.isNotNull() & b.isNotNull()).select(
        "result_id",
        text.improvement_score(x, y).alias("score"),
        text.severity(y).alias("severity"),
        before.alias("heuristic_before"),
        after.alias("heuristic_after"),
        F.when(a.contains("for"), "O(n)").otherwise("O(1)").alias("demo_class"),
        F.format_string("%.1f%%", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence_score"))) * 1000 + 0.5) / 10).alias("confidence"),
    )


def text_routes(spark: SparkSession, d: str) -> DataFrame:
    """Rows per rule that a text condition picks and per generator that the router picks."""
    code = F.col("original_code")
    return table(spark, d, "feedback").where("original_code IS NOT NULL").groupBy(
        text.first_rule(code).alias("rule"), text.generation_route(code, F.col("predicted_technique")).alias("route")
    ).agg(F.count(F.lit(1)).alias("n"))


def generated_code(spark: SparkSession, d: str) -> DataFrame:
    """Code generated for each feedback row from its predicted technique."""
    code = F.col("original_code")
    rows = table(spark, d, "feedback").where("original_code IS NOT NULL")
    return rows.select("id", F.md5(generate.generated(code, F.coalesce("predicted_technique", F.lit("")))).alias("digest"))


def algorithms_recognized(spark: SparkSession, d: str) -> DataFrame:
    """Rows per whole algorithm recognized; DuckDB's regular expressions have no back references, so no SQL."""
    rows = table(spark, d, "optimization_result").where("original_code IS NOT NULL")
    return rows.groupBy(text.recognized_algorithm(F.col("original_code")).alias("algorithm")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (operation_counts, class_words, code_patterns, literal_folds, offline_rewrites, text_scores, text_routes, generated_code, algorithms_recognized)
}


def _n(code: str, word: str) -> str:
    return f"((length({code}) - length(replace({code}, '{word.replace(chr(39), chr(39) * 2)}', ''))) // {len(word)})"


def _cls(c: str) -> str:
    return f"regexp_replace(replace(replace(lower(trim({c})), '^2)', '²)'), '^3)', '³)'), '^o\\(', 'O(')"


_C = "original_code"
_PLAIN = "regexp_replace(optimized_code, '\\r\\n|[\\r\\v\\f]', chr(10), 'g')"
_FOLDED = _C
for _a, _b in text.FOLDS:
    _FOLDED = f"replace({_FOLDED}, '{_a}', '{_b}')"
_TIDY = "regexp_replace(optimized_code, '(?m)//.*$', '', 'g')"
for _p, _r in ((r"console\.log\(.*?\);", "''"), (r"\s+", "' '"), (r"\{\s+", "'{'"), (r"\s+\}", "'}'"), (";", "';' || chr(10)"), (r"\{", "'{' || chr(10)"), (r"\}", "chr(10) || '}'")):
    _TIDY = f"regexp_replace({_TIDY}, '{_p}', {_r}, 'g')"
_WORDS = {n: " + ".join(_n(f"lower({_C})", w) for w in words) for n, words in text.CLASS_WORDS.items()} | {
    "fibonacci_pattern": f"(contains(lower({_C}), 'fibonacci') AND contains({_C}, 'fibonacci(n-1)'))::INT",
    "factorial_pattern": f"(contains(lower({_C}), 'factorial') AND contains({_C}, 'factorial(n-1)'))::INT",
    "binary_search_pattern": f"(contains(lower({_C}), 'binary') AND contains({_C}, 'left') AND contains({_C}, 'right'))::INT",
    "sorting_pattern": "(" + " OR ".join(f"contains(lower({_C}), '{w}')" for w in ("sort", "bubble", "merge", "quick")) + ")::INT",
}
_PATTERNS = {
    "nested_loops_detected": f"{_n(_C, 'for')} >= 2", "equality_comparisons": f"contains({_C}, '==')",
    "sum_operations": f"(contains({_C}, '+') OR contains({_C}, 'sum('))", "max_min_operations": f"(contains({_C}, 'max(') OR contains({_C}, 'min('))",
    "list_operations": f"(contains({_C}, 'append(') OR contains({_C}, '.extend('))", "return_in_loop": f"(contains({_C}, 'return') AND contains({_C}, 'for'))",
    "target_variable": f"contains({_C}, 'target')", "duplicate_keywords": f"contains(lower({_C}), 'dup')",
}
def _filled(template: str) -> str:
    text_ = "'" + template.replace("'", "''") + "'"
    for slot, part in (("<name>", "name"), ("<args>", "args"), ("<first>", "first"), ("<second>", "second")):
        text_ = f"replace({text_}, '{slot}', {part})"
    return text_


_BOTH = f"contains({_C}, 'for i in range') AND contains({_C}, 'for j in range')"

ORACLES = {
    "operation_counts": "SELECT result_id, "
    + ", ".join(f"len(regexp_extract_all(optimized_code, '\\.({w})')) AS {n}" for n, w in text.METHODS.items())
    + f""", CASE WHEN length(optimized_code) = 0 THEN 0 ELSE len(string_split({_PLAIN}, chr(10))) - ends_with({_PLAIN}, chr(10))::INT END AS n_lines,
        {_n('optimized_code', '#')} + {_n('optimized_code', '"""')} + {_n('optimized_code', chr(39) * 3)} AS n_comments
        FROM optimization_result WHERE optimized_code IS NOT NULL""",
    "class_words": "SELECT count(*) AS n, " + ", ".join(f"sum({e})::BIGINT AS {n}" for n, e in _WORDS.items()) + f" FROM feedback WHERE {_C} IS NOT NULL",
    "code_patterns": "SELECT concat_ws(',', "
    + ", ".join(f"CASE WHEN {e} THEN '{n}' END" for n, e in _PATTERNS.items())
    + f""") AS patterns, {_PATTERNS['nested_loops_detected']} AS nested_structure,
        {_PATTERNS['equality_comparisons']} AND {_PATTERNS['nested_loops_detected']} AS search_pattern,
        {_PATTERNS['sum_operations']} OR {_PATTERNS['max_min_operations']} AS accumulation_pattern, count(*) AS n
        FROM feedback WHERE {_C} IS NOT NULL GROUP BY 1, 2, 3, 4""",
    "literal_folds": f"SELECT result_id, md5({_FOLDED}) AS digest, concat_ws(',', "
    + ", ".join(f"CASE WHEN contains({_C}, '{a}') THEN '{a}' END" for a, _ in text.FOLDS)
    + f") AS folds FROM optimization_result WHERE {_C} IS NOT NULL",
    "offline_rewrites": rf"""
        SELECT result_id, CASE WHEN contains(optimized_code, 'def ') OR contains(optimized_code, 'import ') OR NOT contains(optimized_code, ';') THEN 'python' ELSE 'javascript' END AS language,
               md5(regexp_replace(regexp_replace(optimized_code, 'var\s+([a-zA-Z0-9_]+)\s*=', 'const \1 =', 'g'),
                   'for\s*\(\s*let\s+i\s*=\s*0\s*;\s*i\s*<\s*(\w+)\.length\s*;\s*i\s*\+\+\s*\)\s*\{{', 'for (const item of \1) {{', 'g')) AS modern,
               md5({_TIDY}) AS tidy,
               md5(regexp_replace(optimized_code, 'for\s+(\w+)\s+in\s+range\(len\((\w+)\)\):', 'for \1, item in enumerate(\2):', 'g')) AS enumerated
        FROM optimization_result WHERE optimized_code IS NOT NULL""",
    "text_scores": f"""
        WITH r AS (SELECT *, {_cls('complexity_before')} AS x, {_cls('complexity_after')} AS y,
                          contains({_C}, 'fibonacci') AND contains({_C}, 'return fibonacci(n-1) + fibonacci(n-2)') AS fib,
                          contains({_C}, 'sort') AND (contains({_C}, 'bubble') OR contains({_C}, 'selection')) AS sort,
                          contains({_C}, 'search') AND contains({_C}, 'for') AND contains({_C}, 'range') AS search
                   FROM optimization_result WHERE {_C} IS NOT NULL AND optimized_code IS NOT NULL)
        SELECT result_id, CASE WHEN contains(x, 'n²') AND contains(y, 'n log n') THEN 80 WHEN contains(x, 'n²') AND contains(y, 'n') THEN 90
                               WHEN contains(x, 'n') AND contains(y, 'log') THEN 85 ELSE 50 END AS score,
               CASE WHEN contains(y, '1)') OR contains(y, 'log') THEN 'good' WHEN contains(y, 'n log n') THEN 'medium' WHEN contains(y, 'n²') OR contains(y, 'n^2') THEN 'poor'
                    WHEN contains(y, '2^n') OR contains(y, 'n!') THEN 'very poor' ELSE 'other' END AS severity,
               CASE WHEN fib THEN 'O(2^n)' WHEN sort THEN 'O(n²)' ELSE 'O(n)' END AS heuristic_before,
               CASE WHEN fib THEN 'O(n)' WHEN sort AND {_C} <> optimized_code THEN 'O(n log n)'
                    WHEN NOT sort AND search AND {_C} <> optimized_code AND contains(optimized_code, 'binary') THEN 'O(log n)' ELSE 'O(n)' END AS heuristic_after,
               CASE WHEN contains({_C}, 'for') THEN 'O(n)' ELSE 'O(1)' END AS demo_class,
               printf('%.1f%%', floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, confidence_score)) * 1000 + 0.5) / 10) AS confidence
        FROM r""",
    "generated_code": rf"""
        WITH h AS (SELECT *, regexp_extract({_C}, 'def [A-Za-z0-9_]+\(([^)]*)\):', 1) AS p FROM feedback WHERE {_C} IS NOT NULL),
             r AS (SELECT id, {_C}, predicted_technique AS t, coalesce(nullif(regexp_extract({_C}, 'def ([A-Za-z0-9_]+)\(', 1), ''), 'main') AS name, coalesce(nullif(trim(p), ''), 'items, target') AS args,
                          coalesce(nullif(regexp_extract(string_split(p, ',')[1], '[A-Za-z_][A-Za-z0-9_]*'), ''), 'items') AS first,
                          coalesce(nullif(regexp_extract(string_split(p, ',')[2], '[A-Za-z_][A-Za-z0-9_]*'), ''), 'target') AS second FROM h)
        SELECT id, md5(CASE t {" ".join(f"WHEN '{n}' THEN {_filled(x)}" for n, x in generate.TEMPLATES.items())} ELSE {_C} END) AS digest FROM r""",
    "text_routes": rf"""
        WITH r AS (SELECT *, regexp_extract({_C}, 'def ([A-Za-z0-9_]+)\((.*?)\):', 1) AS f, lower({_C}) AS low FROM feedback WHERE {_C} IS NOT NULL)
        SELECT CASE WHEN {_BOTH} AND contains({_C}, 'total +=') AND (contains({_C}, 'range(i)') OR contains({_C}, 'range(n)')) THEN 'Mathematical formula'
                    WHEN {_BOTH} AND (contains({_C}, 'arr[i] == arr[j]') OR contains({_C}, 'nums[i] == nums[j]')) THEN 'Hash set for O(1) lookup'
                    WHEN {_BOTH} AND (contains({_C}, 'target') OR contains({_C}, 'sum')) AND contains({_C}, '+') THEN 'Hash map for complement lookup'
                    WHEN {_BOTH} AND contains({_C}, 'sum') THEN 'Kadane''s algorithm' END AS rule,
               CASE WHEN f = '' THEN 'unchanged' WHEN contains(low, 'pairs') OR contains(lower(f), 'sum') THEN 'pairs_sum'
                    WHEN contains(low, 'duplicate') OR contains(lower(f), 'duplicate') THEN 'duplicate'
                    WHEN contains(low, 'max') AND contains(lower(f), 'subarray') THEN 'max_subarray'
                    WHEN predicted_technique IN ('hash_map', 'hash_set') THEN predicted_technique ELSE 'generic' END AS route, count(*) AS n
        FROM r GROUP BY 1, 2""",
}
