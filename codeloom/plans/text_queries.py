"""Text-level code analytics over the code tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import dims, text
from codeloom.operators import explain
from codeloom.sources.tables import table

CODE = F.col


def _feedback(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feedback").where("original_code IS NOT NULL")


def _results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "optimization_result")


def text_features10(spark: SparkSession, d: str) -> DataFrame:
    """The ten training features summed up per predicted technique."""
    rows = _feedback(spark, d).select("predicted_technique", *[c.alias(n) for n, c in text.features10(F.col("original_code")).items()])
    return rows.groupBy("predicted_technique").agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in text.FEATURES10])


def usage_flags(spark: SparkSession, d: str) -> DataFrame:
    flags = text.usage_flags(F.col("original_code"))
    return _feedback(spark, d).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("long").alias(n) for n, c in flags.items()])


def line_stats(spark: SparkSession, d: str) -> DataFrame:
    code = F.col("optimized_code")
    rows = _results(spark, d).where(code.isNotNull())
    return rows.select(
        "result_id",
        text.line_count(code).alias("n_lines"),
        text.stripped_line_count(code).alias("n_stripped"),
        F.length(code).cast("long").alias("n_chars"),
        F.round(F.length(code) / text.line_count(code), 4).alias("mean_line"),
    )


def keyword_counts(spark: SparkSession, d: str) -> DataFrame:
    code = F.col("original_code")
    return _feedback(spark, d).select(
        "id",
        text.word_count(code, "for|while").alias("n_loops"),
        text.word_count(code, "if|elif|else").alias("n_conditionals"),
        text.word_count(code, "import|from").alias("n_imports"),
        text.loop_depth_by_indent(code).alias("loop_depth"),
    )


def algorithm_types(spark: SparkSession, d: str) -> DataFrame:
    kind = text.algorithm_type(F.col("original_code"))
    return _feedback(spark, d).groupBy(kind.alias("algorithm")).agg(F.count(F.lit(1)).alias("n"))


def data_structures(spark: SparkSession, d: str) -> DataFrame:
    found = text.data_structures(F.col("optimized_code"))
    return _results(spark, d).where("optimized_code IS NOT NULL").groupBy(found.alias("structures")).agg(F.count(F.lit(1)).alias("n"))


def brute_force_patterns(spark: SparkSession, d: str) -> DataFrame:
    code = F.col("original_code")
    return _feedback(spark, d).groupBy(
        text.first_pattern(code, text.BRUTE_FORCE).alias("pattern"),
        text.first_pattern(code, text.TEMPLATE_PATTERNS, True).alias("template"),
    ).agg(F.count(F.lit(1)).alias("n"))


def function_headers(spark: SparkSession, d: str) -> DataFrame:
    code = F.col("original_code")
    return _feedback(spark, d).select("id", text.function_name(code).alias("name"), text.function_parameters(code).alias("parameters"))


def cache_key_dedup(spark: SparkSession, d: str) -> DataFrame:
    key = text.cache_key(F.col("original_code"))
    return _feedback(spark, d).groupBy(key.alias("cache_key")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def fences_stripped(spark: SparkSession, d: str) -> DataFrame:
    code = text.without_fences(F.col("optimized_code"))
    return _results(spark, d).where("optimized_code IS NOT NULL").select("result_id", F.length(code).cast("long").alias("n_chars"), F.md5(code).alias("digest"))


def blank_lines_squeezed(spark: SparkSession, d: str) -> DataFrame:
    code = text.squeeze_blank_lines(F.col("original_code"))
    return _feedback(spark, d).select("id", F.md5(code).alias("digest"))


def text_complexities(spark: SparkSession, d: str) -> DataFrame:
    rows = _results(spark, d).where("original_code IS NOT NULL AND optimized_code IS NOT NULL")
    return rows.groupBy(
        text.text_complexity(F.col("original_code")).alias("before"), text.text_complexity(F.col("optimized_code")).alias("after")
    ).agg(F.count(F.lit(1)).alias("n"))


def complexity_scores(spark: SparkSession, d: str) -> DataFrame:
    before, after = dims.canonical_class(F.col("complexity_before")), dims.canonical_class(F.col("complexity_after"))
    changed = F.col("original_code").eqNullSafe(F.col("optimized_code")) == F.lit(False)
    return _results(spark, d).select(
        "result_id",
        dims.speedup_factor(before, after).alias("speedup"),
        F.round(dims.improvement_percent(before, after, changed), 4).alias("improvement"),
        F.round(dims.runtime_estimate(before, F.length(F.coalesce("original_code", F.lit("")))) * 1e6, 2).alias("runtime_us"),
    )


def technique_dims(spark: SparkSession, d: str) -> DataFrame:
    technique = F.col("technique")
    rows = _results(spark, d).select(F.explode("applied_techniques").alias("technique"))
    complexity = {k: v[0] for k, v in dims.TECHNIQUES.items()}
    structure = {k: v[1] for k, v in dims.TECHNIQUES.items()}
    return rows.groupBy("technique").agg(F.count(F.lit(1)).alias("n")).select(
        "technique",
        F.initcap(F.replace(technique, F.lit("_"), F.lit(" "))).alias("title"),
        dims.lookup(technique, complexity, "O(n)").alias("complexity"),
        dims.lookup(technique, structure, "Generic Data Structure").alias("structure"),
        "n",
    )


def size_reduction(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("original_code"), F.col("optimized_code")
    rows = _results(spark, d).where(a.isNotNull() & b.isNotNull())
    before, after = text.line_count(a), text.line_count(b)
    ratio = F.length(b) / F.nullif(F.length(a), F.lit(0))
    return rows.select(
        "result_id",
        F.round((before - after) * 100.0 / before, 4).alias("reduction"),
        F.when(ratio.between(0.5, 1.5), 0.8).otherwise(0.3).alias("confidence"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence_score"))) * 100, 2).alias("percent"),
    )


#: Text features that take part in an explanation, by the names of the weights.
EXPLAINED = ("for_loops", "lines_of_code", "sum_pattern", "comparison_pattern", "pair_pattern", "duplicate_pattern", "max_pattern", "sorting_usage", "membership_testing", "conditional_complexity", "nested_loops")


def feature_contributions(spark: SparkSession, d: str) -> DataFrame:
    """Places that each feature takes among the top contributions, per technique and impact."""
    code = F.col("original_code")
    flags, ten = text.usage_flags(code), text.features10(code)
    values = {
        "for_loops": ten["n_for"], "lines_of_code": ten["n_lines"], "sum_pattern": flags["sum_pattern"],
        "comparison_pattern": flags["comparison_pattern"], "pair_pattern": flags["says_pair"], "duplicate_pattern": flags["says_duplicate"],
        "max_pattern": flags["says_extreme"], "sorting_usage": flags["uses_sorting"], "membership_testing": flags["membership"],
        "conditional_complexity": ten["n_if"], "nested_loops": text.loop_depth_by_indent(code),
    }
    rows = _feedback(spark, d).select("id", "predicted_technique", *[values[n].alias(n) for n in EXPLAINED])
    shown = explain.contributions(rows, "id", "predicted_technique", list(EXPLAINED)).join(rows.select("id", "predicted_technique"), "id")
    return shown.groupBy("predicted_technique", "feature", "place", "impact").agg(F.count(F.lit(1)).alias("n"))


def rationales(spark: SparkSession, d: str) -> DataFrame:
    before, after = dims.canonical_class(F.col("complexity_before")), dims.canonical_class(F.col("complexity_after"))
    technique = F.element_at("applied_techniques", 1)
    rows = _results(spark, d).where(F.size("applied_techniques") > 0)
    return rows.select("result_id", explain.rationale(technique, before, after, F.col("confidence_score")).alias("rationale"))


QUERIES = {
    f.__name__: f
    for f in (
        feature_contributions, rationales, text_features10, usage_flags, line_stats, keyword_counts, algorithm_types, data_structures, brute_force_patterns,
        function_headers, cache_key_dedup, fences_stripped, blank_lines_squeezed, text_complexities, complexity_scores,
        technique_dims, size_reduction,
    )
}


def _n(code: str, word: str) -> str:
    return f"((length({code}) - length(replace({code}, '{word}', ''))) // {len(word)})"


def _has(code: str, *words: str) -> str:
    return "CASE WHEN " + " OR ".join(f"contains({code}, '{w}')" for w in words) + " THEN 1 ELSE 0 END"


def _lines(code: str) -> str:
    return f"len(string_split({code}, chr(10)))"


def _words(code: str, pattern: str) -> str:
    spaced = f"' ' || regexp_replace({code}, '([^A-Za-z0-9_])', '\\1\\1', 'g') || ' '"
    return f"len(regexp_extract_all({spaced}, '[^A-Za-z0-9_](?:{pattern})[^A-Za-z0-9_]'))"


def _depth(code: str) -> str:
    bare = f"regexp_replace({code}, '[\"''].*?[\"'']', '', 'g')"
    found = f"regexp_extract_all({bare}, '(?m)^([ \\t]*)(?:for|while)\\b', 1)"
    return f"coalesce(list_max(list_transform({found}, lambda x: length(x))) // 4 + 1, 0)"


def _case(rules: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in rules) + f" ELSE {otherwise} END"


def _complexity(code: str) -> str:
    return _case(
        [(f"{_depth(code)} >= 3", "O(n³)"), (f"{_depth(code)} = 2", "O(n²)"),
         (f"{_depth(code)} = 1 AND contains(lower({code}), 'sort')", "O(n log n)"), (f"{_depth(code)} = 1", "O(n)")],
        "'O(1)'",
    )


def _class(c: str) -> str:
    return f"regexp_replace(replace(replace(lower(trim({c})), '^2)', '²)'), '^3)', '³)'), '^o\\(', 'O(')"


def _look(key: str, entries: dict, default: object) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {show(v)}" for k, v in entries.items()) + f" ELSE {show(default)} END"


_C = "original_code"
_LOW = f"lower({_C})"
_ONE_LINE = r"trim(regexp_replace(regexp_replace(lower(original_code), '#[^\n]*', '', 'g'), '[ \t\r\n\f\v]+', ' ', 'g'))"
_ONE_LINE_ALL = r"trim(regexp_replace(lower(original_code), '[ \t\r\n\f\v]+', ' ', 'g'))"
_FEATURES = {
    "n_lines": _lines(_C), "n_for": _n(_C, "for"), "n_while": _n(_C, "while"), "n_if": _n(_C, "if"),
    "n_range": _n(_C, "range"), "n_len": _n(_C, "len"), "has_two_for": f"CASE WHEN {_n(_C, 'for')} >= 2 THEN 1 ELSE 0 END",
    "has_sum": _has(_C, "sum("), "has_equal": _has(_C, "=="), "has_append": _has(_C, "append"),
}
_FLAGS = {
    "uses_dict": _has(_C, "dict", "{}"), "uses_set": _has(_C, "set("), "uses_list": _has(_C, "list(", "[]"),
    "n_append": _n(_C, "append"), "n_get": _n(_C, "get("),
    "sum_pattern": rf"CASE WHEN regexp_matches({_C}, '\+.*==|sum\(') THEN 1 ELSE 0 END",
    "comparison_pattern": f"CASE WHEN regexp_matches({_C}, '==.*and|!=.*or') THEN 1 ELSE 0 END",
    "uses_min_max": _has(_C, "max(", "min("), "uses_sorting": _has(_C, "sorted(", ".sort("), "uses_len": _has(_C, "len("),
    "membership": f"CASE WHEN contains({_C}, 'in') AND contains({_C}, 'for') THEN 1 ELSE 0 END",
    "says_substring": _has(_LOW, "substr"), "says_duplicate": _has(_LOW, "duplicate"), "says_pair": _has(_LOW, "pair", "sum"),
    "says_extreme": _has(_LOW, "maximum", "minimum"), "says_count": _has(_LOW, "count"), "says_frequency": _has(_LOW, "frequency"),
}
_STRIPPED = r"trim({0}, ' ' || chr(9) || chr(13) || chr(10))"
_UNFENCED = _STRIPPED.format("replace(replace(optimized_code, '```python', ''), '```', '')")

_EXPLAINED = {
    "for_loops": _FEATURES["n_for"], "lines_of_code": _FEATURES["n_lines"], "sum_pattern": _FLAGS["sum_pattern"],
    "comparison_pattern": _FLAGS["comparison_pattern"], "pair_pattern": _FLAGS["says_pair"], "duplicate_pattern": _FLAGS["says_duplicate"],
    "max_pattern": _FLAGS["says_extreme"], "sorting_usage": _FLAGS["uses_sorting"], "membership_testing": _FLAGS["membership"],
    "conditional_complexity": _FEATURES["n_if"], "nested_loops": _depth(_C),
}
_WEIGHT = "CASE t || '|' || f " + " ".join(f"WHEN '{t}|{f}' THEN {w}" for t, own in explain.WEIGHTS.items() for f, w in own.items()) + " ELSE 0.01 END"

ORACLES = {
    "feature_contributions": "WITH r AS (" + " UNION ALL ".join(
        f"SELECT id, predicted_technique AS t, '{n}' AS f, ({e})::DOUBLE AS v FROM feedback WHERE original_code IS NOT NULL" for n, e in _EXPLAINED.items()
    ) + f"""), c AS (SELECT id, t, f, round(v * ({_WEIGHT})::DOUBLE, 6) AS c FROM r),
        k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, f) AS place FROM c WHERE c > 0.01)
        SELECT t AS predicted_technique, f AS feature, place,
               CASE WHEN c > 0.15 THEN 'High' WHEN c > 0.05 THEN 'Medium' ELSE 'Low' END AS impact, count(*) AS n
        FROM k WHERE place <= 5 GROUP BY 1, 2, 3, 4""",
    "rationales": f"""
        SELECT result_id, concat_ws('; ', array_to_string(list_transform(string_split(applied_techniques[1], '_'), lambda w: upper(w[1]) || w[2:]), ' ') || ' was chosen',
               {_class('complexity_before')} || ' becomes ' || {_class('complexity_after')},
               CASE WHEN confidence_score > 0.7 THEN 'High' WHEN confidence_score > 0.4 THEN 'Medium' ELSE 'Low' END || ' confidence') AS rationale
        FROM optimization_result WHERE len(applied_techniques) > 0""",
    "text_features10": "SELECT predicted_technique, count(*) AS n, "
    + ", ".join(f"sum({e})::BIGINT AS {k}" for k, e in _FEATURES.items())
    + " FROM feedback WHERE original_code IS NOT NULL GROUP BY 1",
    "usage_flags": "SELECT count(*) AS n, " + ", ".join(f"sum({e})::BIGINT AS {k}" for k, e in _FLAGS.items())
    + " FROM feedback WHERE original_code IS NOT NULL",
    "line_stats": f"""
        SELECT result_id, {_lines('optimized_code')} AS n_lines, {_lines(_STRIPPED.format('optimized_code'))} AS n_stripped,
               length(optimized_code) AS n_chars, round(length(optimized_code) / {_lines('optimized_code')}, 4) AS mean_line
        FROM optimization_result WHERE optimized_code IS NOT NULL""",
    "keyword_counts": f"""
        SELECT id, {_words(_C, 'for|while')} AS n_loops, {_words(_C, 'if|elif|else')} AS n_conditionals,
               {_words(_C, 'import|from')} AS n_imports, {_depth(_C)} AS loop_depth
        FROM feedback WHERE original_code IS NOT NULL""",
    "algorithm_types": "SELECT "
    + _case([(" OR ".join(f"contains({_LOW}, '{w}')" for w in words), name) for name, words in text.ALGORITHM_WORDS], "'unknown'")
    + " AS algorithm, count(*) AS n FROM feedback WHERE original_code IS NOT NULL GROUP BY 1",
    "data_structures": "SELECT coalesce(nullif(concat_ws(',', "
    + ", ".join(f"CASE WHEN regexp_matches(optimized_code, '{p}') THEN '{n}' END" for n, p in text.STRUCTURES)
    + "), ''), 'unknown') AS structures, count(*) AS n FROM optimization_result WHERE optimized_code IS NOT NULL GROUP BY 1",
    "brute_force_patterns": "SELECT "
    + _case([(f"regexp_matches({_ONE_LINE}, '{p}')", n) for n, p in text.BRUTE_FORCE], "NULL") + " AS pattern, "
    + _case([(f"regexp_matches({_ONE_LINE_ALL}, '{p}')", n) for n, p in text.TEMPLATE_PATTERNS], "NULL")
    + " AS template, count(*) AS n FROM feedback WHERE original_code IS NOT NULL GROUP BY 1, 2",
    "function_headers": r"""
        SELECT id, coalesce(nullif(regexp_extract(original_code, 'def ([A-Za-z0-9_]+)\(', 1), ''), 'main') AS name,
               regexp_extract(original_code, 'def [A-Za-z0-9_]+\(([^)]*)\):', 1) AS parameters
        FROM feedback WHERE original_code IS NOT NULL""",
    "cache_key_dedup": """
        SELECT 'optimization:' || md5(original_code) AS cache_key, count(*) AS n, min(id) AS first_id
        FROM feedback WHERE original_code IS NOT NULL GROUP BY 1""",
    "fences_stripped": f"""
        SELECT result_id, length({_UNFENCED}) AS n_chars, md5({_UNFENCED}) AS digest
        FROM optimization_result WHERE optimized_code IS NOT NULL""",
    "blank_lines_squeezed": r"""
        SELECT id, md5(regexp_replace(regexp_replace(original_code, '(?m)[ \t]+$', '', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g')) AS digest
        FROM feedback WHERE original_code IS NOT NULL""",
    "text_complexities": f"""
        SELECT {_complexity('original_code')} AS before, {_complexity('optimized_code')} AS after, count(*) AS n
        FROM optimization_result WHERE original_code IS NOT NULL AND optimized_code IS NOT NULL GROUP BY 1, 2""",
    "complexity_scores": f"""
        WITH r AS (SELECT *, {_class('complexity_before')} AS b, {_class('complexity_after')} AS a FROM optimization_result),
             s AS (SELECT *, {_look('b', dims.SPEEDUP_RANK, 3)} AS sb, {_look('a', dims.SPEEDUP_RANK, 3)} AS sa,
                   {_look('b', dims.PERCENT_RANK, 3)} AS pb, {_look('a', dims.PERCENT_RANK, 3)} AS pa FROM r)
        SELECT result_id, CASE WHEN sb > sa THEN pow(2, sb - sa) ELSE 1 END::INT AS speedup,
               round(CASE WHEN pb > pa THEN (pb - pa) * 100.0 / pb WHEN original_code IS DISTINCT FROM optimized_code THEN 10.0 ELSE 0.0 END::DOUBLE, 4) AS improvement,
               round(0.000001::DOUBLE * ({_look('b', dims.RUNTIME_MULTIPLIER, 100)}) * length(coalesce(original_code, '')) / 100 * 1e6, 2) AS runtime_us
        FROM s""",
    "technique_dims": f"""
        SELECT technique, array_to_string(list_transform(string_split(technique, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS title,
               {_look('technique', {k: v[0] for k, v in dims.TECHNIQUES.items()}, 'O(n)')} AS complexity,
               {_look('technique', {k: v[1] for k, v in dims.TECHNIQUES.items()}, 'Generic Data Structure')} AS structure, count(*) AS n
        FROM (SELECT unnest(applied_techniques) AS technique FROM optimization_result) GROUP BY 1""",
    "size_reduction": f"""
        SELECT result_id, round(({_lines('original_code')} - {_lines('optimized_code')}) * 100.0 / {_lines('original_code')}, 4) AS reduction,
               CASE WHEN length(optimized_code) / nullif(length(original_code), 0) BETWEEN 0.5 AND 1.5 THEN 0.8 ELSE 0.3 END::DOUBLE AS confidence,
               round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, confidence_score)) * 100, 2) AS percent
        FROM optimization_result WHERE original_code IS NOT NULL AND optimized_code IS NOT NULL""",
}
