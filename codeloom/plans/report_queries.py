"""Reports of the service and of validation runs, and the remaining relational forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import dims, text
from codeloom.operators import datasets as D
from codeloom.operators import explain, graphs, models
from codeloom.operators import relational as R
from codeloom.plans.golden_queries import _features, snippets, values
from codeloom.functions import syntax
from codeloom.sources.tables import stream_table, table
from codeloom.streaming import feedback as streams


def _status(df: DataFrame) -> DataFrame:
    return df.withColumn("status", F.lower(F.trim("validation_status")))


def _passed() -> Column:
    return F.coalesce(F.col("status") == "passed", F.lit(False))


# --- datasets and validation ----------------------------------------------------------------


def _checks() -> list[tuple[Column, str]]:
    return [
        (D.filled(F.col("problem_name")), "no name"), (D.filled(F.col("optimization_technique")), "no technique"),
        (D.filled(F.col("naive_solution.code")), "no naive code"), (D.filled(F.col("optimized_solution.code")), "no optimized code"),
        (F.col("naive_solution.complexity") != F.col("optimized_solution.complexity"), "complexity unchanged"),
    ]


def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    """Rows, rows with both codes, their share in per cent and the number of all issues."""
    rows = table(spark, d, "dataset_scraper")
    valid = D.filled(F.col("naive_solution.code")) & D.filled(F.col("optimized_solution.code"))
    n_issues = sum((F.when(~F.coalesce(ok, F.lit(False)), 1).otherwise(0) for ok, _ in _checks()), F.lit(0))
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(valid).alias("n_valid"), F.coalesce(F.sum(n_issues), F.lit(0)).cast("long").alias("n_issues"),
        F.coalesce(F.round(F.count_if(valid) * 100 / F.nullif(F.count(F.lit(1)), F.lit(0)), 4), F.lit(0.0)).alias("success_rate"),
    )


def quality_issues(spark: SparkSession, d: str) -> DataFrame:
    issue = F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for ok, name in _checks()])))
    return table(spark, d, "dataset_scraper").select(issue.alias("issue"), "problem_id").groupBy("issue").agg(F.count(F.lit(1)).alias("n"), F.min("problem_id").alias("first_id"))


def exact_split(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the three splits, whose sizes are exact."""
    rows = table(spark, d, "simple_dataset_generator").select("example_id")
    return D.exact_split(rows, "example_id", {"train": 0.8, "validation": 0.1, "test": 0.1}).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("example_id").alias("first_id"), F.sum("example_id").alias("sum_id")
    )


def changed_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of answers that changed the code, and size changes where they did."""
    a, b = F.col("original_code"), F.col("optimized_code")
    changed = F.coalesce(a != b, F.lit(False))
    return table(spark, d, "optimization_result").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(changed).alias("n_changed"), F.round(F.avg(changed.cast("double")), 6).alias("success_rate"),
        F.round(F.avg(F.when(changed, D.improvement(F.length(a), F.length(b)))), 4).alias("mean_shorter"),
    )


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Runs, successes, and the means of time and improvement over the successes."""
    rows = _status(table(spark, d, "optimization_result"))
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(_passed(), F.col(c))), F.lit(0.0)), 6)
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(_passed()).alias("n_passed"), F.round(F.count_if(_passed()) * 100 / F.count(F.lit(1)), 4).alias("success_rate"),
        mean("processing_time").alias("mean_time"), mean("performance_improvement").alias("mean_improvement"),
    )


def run_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Runs that failed against runs that passed: improvement of the mean time, t and its coarse p value."""
    rows = _status(table(spark, d, "optimization_candidate"))
    t = D.welch_t(rows, _passed(), "processing_time")
    means = rows.agg(F.avg(F.when(~_passed(), F.col("processing_time"))).alias("a"), F.avg(F.when(_passed(), F.col("processing_time"))).alias("b"))
    p = D.bucketed_p(F.col("t"))
    return t.crossJoin(means).select(  # one row each
        "t", p.alias("p"), F.when(p <= 0.05, "high").otherwise("low").alias("level"), F.round(D.improvement(F.col("a"), F.col("b")), 4).alias("time_improvement")
    )


def validation_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Per request: candidates, those that passed, whether all did, and the verdict."""
    rows = _status(table(spark, d, "optimization_candidate")).where("request_id IS NOT NULL")
    n_passed = F.count_if(_passed())
    return rows.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n"), n_passed.alias("n_passed"), F.bool_and(_passed()).alias("all_passed"),
        F.when(n_passed == F.count(F.lit(1)), "valid").when(n_passed > 0, "partly valid").otherwise("invalid").alias("verdict"),
    )


def output_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Outputs of two ways to the same number, compared case by case with a tolerance."""
    keys = ["l_orderkey", "l_linenumber", "l_returnflag"]
    rows = table(spark, d, "lineitem").groupBy(*keys).agg(F.max("l_extendedprice").alias("l_extendedprice"), F.max("l_discount").alias("l_discount"))
    original = rows.select(*keys, (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("out"))
    optimized = rows.where("l_linenumber <> 7").select(*keys, (F.col("l_extendedprice") - F.col("l_extendedprice") * F.col("l_discount")).alias("out"))
    return D.compare_outputs(original, optimized, keys, "out", 1e-6).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_cases"), F.count_if("equal").alias("n_equal"), F.bool_and("equal").alias("all_equal")
    )


def hybrid_results(spark: SparkSession, d: str) -> DataFrame:
    """Requests with their best valid candidate: at most five by confidence are tried, the first that passed wins.

    A request without one keeps its own code and the default class.
    """
    tried = R.top_per_group(
        _status(table(spark, d, "optimization_candidate")).where("request_id IS NOT NULL"), "request_id", [F.desc_nulls_last("confidence_score"), F.asc("candidate_id")], 5
    )
    won = tried.where(_passed()).groupBy("request_id").agg(F.min_by(F.struct("candidate_id", "optimized_code", "complexity_improvement"), "rank").alias("c"))
    rows = table(spark, d, "optimization_request").select("request_id", "code").join(won, "request_id", "left")
    return rows.select(
        "request_id", F.col("c.candidate_id").alias("candidate_id"), F.md5(F.coalesce("c.optimized_code", "code")).alias("digest"),
        F.coalesce(F.col("c.complexity_improvement")["before"], F.lit("O(n)")).alias("before"), F.coalesce(F.col("c.complexity_improvement")["after"], F.lit("O(n)")).alias("after"),
        F.col("c").isNotNull().alias("success"),
    )


# --- feedback and service -------------------------------------------------------------------


def feedback_summary(spark: SparkSession, d: str) -> DataFrame:
    """The statistics answer as one row: total, mean rating and a map of kinds, shown as text."""
    kinds = table(spark, d, "feedback").groupBy(F.lower(F.trim("user_feedback")).alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("user_rating") > 0, F.col("user_rating"))).alias("s"), F.count(F.when(F.col("user_rating") > 0, 1)).alias("r")
    )
    shown = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("k", F.lit("unknown")), "n")))))
    return kinds.agg(F.sum("n").alias("total_feedback"), F.bround(F.coalesce(F.sum("s") / F.sum("r"), F.lit(0.0)), 2).alias("average_rating"), shown.alias("kinds"))


def stream_feedback_stats(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of feedback as a stream over its table, run to its end."""
    rows = stream_table(spark, d, "feedback")
    return streams.drain(streams.running_stats(rows, "user_rating", "user_feedback"), "stats")


def token_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Events within an hour of the user's first one, as a token issued then would admit."""
    rows = table(spark, d, "events")
    first = rows.groupBy("user_id").agg(F.min("ts").alias("issued"))
    return streams.unexpired(rows.join(first, "user_id"), "issued", "ts").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def session_batches(spark: SparkSession, d: str) -> DataFrame:
    """The first ten feedback rows of each session, as a batch takes them."""
    rows = table(spark, d, "feedback").where("session_id IS NOT NULL").select("session_id", "id", "predicted_technique")
    return R.top_per_group(rows, "session_id", [F.asc("id")], 10).select("session_id", "id", "rank")


def technique_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The three most frequent techniques of each session with their share."""
    rows = table(spark, d, "feedback").where("session_id IS NOT NULL")
    counts = rows.groupBy("session_id", F.coalesce("predicted_technique", F.lit("")).alias("technique")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("session_id").agg(F.sum("n").alias("all"))
    shares = counts.join(total, "session_id").select("session_id", "technique", F.round(F.col("n") / F.col("all"), 6).alias("share"))
    return R.top_per_group(shares, "session_id", [F.desc("share"), F.asc("technique")], 3).select("session_id", "technique", "share", "rank")


def technique_templates(spark: SparkSession, d: str) -> DataFrame:
    """Techniques with what their template says, an empty text for those without one."""
    technique = F.col("technique")
    rows = table(spark, d, "optimization_candidate").select(F.explode("applied_techniques").alias("technique")).groupBy("technique").agg(F.count(F.lit(1)).alias("n"))
    part = lambda i: dims.lookup(technique, {k: v[i] for k, v in dims.TEMPLATES.items()}, "")
    return rows.select("technique", "n", part(0).alias("description"), part(1).alias("complexity"), part(2).alias("structure"), part(3).alias("use_case"))


def response_rows(spark: SparkSession, d: str) -> DataFrame:
    """Results under the names of the answer, with gains, size change and improvements by kind."""
    a, b = F.col("original_code"), F.col("optimized_code")
    x, y = dims.canonical_class(F.col("complexity_before")), dims.canonical_class(F.col("complexity_after"))
    before, after = text.line_count(a), text.line_count(b)
    size = F.when(a == b, 0.0).when(before > after, (before - after) * 100.0 / before).when(dims.speedup_factor(x, y) > 1, 40.0).otherwise(10.0)
    kept = F.filter("applied_techniques", lambda t: t.contains("hash") | t.contains("fold"))
    return table(spark, d, "optimization_result").where(a.isNotNull() & b.isNotNull()).select(
        F.col("result_id").alias("resultId"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.round(size, 4).alias("improvement"),
        dims.theoretical_gains(dims.speedup_factor(x, y)).alias("gains"), F.to_json("applied_techniques").alias("techniques"), F.array_join(kept, ",").alias("kept"),
    )


def theoretical_savings(spark: SparkSession, d: str) -> DataFrame:
    """Steps of a quadratic and a linear way for some sizes."""
    sizes = spark.range(1).select(F.explode(F.array(*[F.lit(n).cast("long") for n in (100, 1000, 10000, 100000)])).alias("n"))
    return sizes.select("n", (F.col("n") * F.col("n")).alias("quadratic"), F.col("n").alias("linear"), F.expr("n * n div n").alias("times_fewer"))


def rule_explanations(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("original_code"), F.col("optimized_code")
    rows = table(spark, d, "optimization_result").where(a.isNotNull() & b.isNotNull())
    shown = explain.rule_based(F.col("applied_techniques"), F.col("complexity_before"), F.col("complexity_after"), text.line_count(a), text.line_count(b))
    return rows.select("result_id", shown.alias("explanation"))


def golden_explanations(spark: SparkSession, d: str) -> DataFrame:
    """The explanation struct of the golden snippets for a hash map at confidence 0.8, by its parts."""
    vector = syntax.features30(F.col("code"))
    rows = _features(spark).select("id", "code", F.lit("hash_map").alias("technique"), F.lit(0.8).alias("confidence"), *[c.alias(n) for n, c in vector.items()])
    e = explain.explanation(F.col("code"), F.col("technique"), F.col("confidence"), list(vector))
    return rows.select("id", e.alias("e")).select(
        "id", "e.summary", F.array_join("e.patterns", ",").alias("patterns"), F.array_join(F.transform("e.alternatives", lambda x: F.concat(x["technique"], F.lit(":"), x["applicability"])), ",").alias("alternatives"),
        "e.impact", F.array_join(F.transform("e.top", lambda x: x["feature"]), ",").alias("top"),
    )


def technique_forest(spark: SparkSession, d: str) -> DataFrame:
    """The three most probable categories of the held-out examples by the full classifier: 200 trees on 30 features."""
    rows = table(spark, d, "simple_dataset_generator").where("original IS NOT NULL AND category IS NOT NULL")
    found = syntax.features(rows.withColumn("s", F.lower(F.trim("split_name"))), "example_id", "original", ("original", "category", "s"))
    own = found.select("example_id", "category", "s", *[c.alias(n) for n, c in syntax.features30(F.col("original")).items()])
    model = models.fit_forest(own.where("s = 'train'"), syntax.FEATURES30, "category")
    return models.top_classes(models.predict(model, own.where("s <> 'train'")), "example_id").select("example_id", "place", "label", F.round("score", 6).alias("score"))


# --- relational forms -----------------------------------------------------------------------


def pairs_used_once(spark: SparkSession, d: str) -> DataFrame:
    return R.pairs_used_once(table(spark, d, "part"), "p_size", 50)


def top_balances(spark: SparkSession, d: str) -> DataFrame:
    return R.top_by_size(table(spark, d, "customer"), "c_custkey", "c_acctbal", 10)


def sorted_quantities(spark: SparkSession, d: str) -> DataFrame:
    """Per order its quantities in order, the different ones, and the place of the first 10."""
    q = F.collect_list(F.col("l_quantity").cast("int"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(q).alias("q"))
    return rows.select(
        "l_orderkey", F.array_join("q", ",").alias("ordered"), F.array_join(F.array_distinct("q"), ",").alias("different"), R.position_in(F.col("q"), F.lit(10)).alias("place")
    )


def anagram_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose brand, and whose name, has the letters of its own reverse and of the type."""
    rows = table(spark, d, "part")
    return rows.groupBy(R.is_anagram(F.col("p_name"), F.reverse("p_name")).alias("own"), R.is_anagram(F.col("p_brand"), F.col("p_type")).alias("other")).agg(F.count(F.lit(1)).alias("n"))


def number_series(spark: SparkSession, d: str) -> DataFrame:
    """Per part size: sum of squares up to it, its square, the ways up its stairs, and the factorial of its last digit."""
    n = F.col("p_size").cast("long")
    rows = table(spark, d, "part").where("p_size BETWEEN 1 AND 60").select(n.alias("n")).distinct()
    stairs = F.expr("aggregate(sequence(1, n), struct(1L AS a, 1L AS b), (s, i) -> struct(s.b AS a, s.a + s.b AS b), s -> s.a)")
    return rows.select(
        "n", F.expr("n * (n + 1) * (2 * n + 1) div 6").alias("squares"), F.pow("n", F.lit(2)).cast("long").alias("power"), stairs.alias("stairs"),
        F.factorial((F.col("n") % 10).cast("int")).alias("factorial"),
    )


def size_islands(spark: SparkSession, d: str) -> DataFrame:
    """Groups of neighbouring large parts on a grid 50 wide, by size."""
    cells = table(spark, d, "part").where("p_size > 25").select(F.expr("p_partkey div 50").alias("x"), (F.col("p_partkey") % 50).alias("y"))
    return graphs.islands(cells).groupBy("n").agg(F.count(F.lit(1)).alias("n_islands"))


def nation_distances(spark: SparkSession, d: str) -> DataFrame:
    """Cheapest way from the first nation over the ring of nation numbers with steps of one and of seven."""
    rows = table(spark, d, "nation").select("n_nationkey")
    step = lambda k, w: rows.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") + k) % 25).alias("dst"), F.lit(w).alias("weight"))
    found = graphs.shortest_paths(step(1, 1.0).union(step(7, 3.5)), rows.where("n_nationkey = 0").select(F.col("n_nationkey").alias("node")))
    return found.select(F.col("node").cast("int").alias("node"), "distance")


def golden_tables(spark: SparkSession, d: str) -> DataFrame:
    """Longest common subsequences of pairs of words, and a knapsack of capacity 10."""
    words = spark.createDataFrame([(1, "kitten", "sitting"), (2, "", "abc"), (3, "banana", "ananas"), (4, "same", "same")], "id long, a string, b string")
    bag = R.knapsack(F.array(*map(F.lit, (5, 4, 6, 3))), F.array(*map(F.lit, (10, 40, 30, 50))), 10)
    return words.select("id", R.longest_common("a", "b").cast("int").alias("common"), bag.cast("int").alias("bag"))


def three_sum_small(spark: SparkSession, d: str) -> DataFrame:
    """Triplets of nation numbers that add up to 20."""
    return R.three_sum(table(spark, d, "nation"), "n_nationkey", 20)


def seen_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose size stood at a part with a smaller key."""
    return R.repeats(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", "p_partkey")


QUERIES = {
    f.__name__: f
    for f in (
        quality_summary, quality_issues, exact_split, changed_rate, run_summary, run_comparison, validation_verdicts, output_comparison, hybrid_results,
        feedback_summary, stream_feedback_stats, token_expiry, session_batches, technique_ranks, technique_templates, response_rows, theoretical_savings,
        rule_explanations, golden_explanations, technique_forest, pairs_used_once, top_balances, sorted_quantities, anagram_pairs, number_series,
        size_islands, nation_distances, golden_tables, three_sum_small, seen_sizes,
    )
}


def _filled(c: str) -> str:
    return f"coalesce(length(trim({c}, ' ' || chr(9) || chr(13) || chr(10))) > 0, false)"


def _cls(c: str) -> str:
    return f"regexp_replace(replace(replace(lower(trim({c})), '^2)', '²)'), '^3)', '³)'), '^o\\(', 'O(')"


def _case(key: str, entries: dict, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v if isinstance(v, int) else chr(39) + v + chr(39)}" for k, v in entries.items()) + f" ELSE {default} END"


_LETTERS = "array_to_string(list_sort(string_split(lower({0}), '')), '')"
_ISSUES = {
    "no name": f"NOT {_filled('problem_name')}", "no technique": f"NOT {_filled('optimization_technique')}", "no naive code": f"NOT {_filled('naive_solution.code')}",
    "no optimized code": f"NOT {_filled('optimized_solution.code')}", "complexity unchanged": "NOT coalesce(naive_solution.complexity <> optimized_solution.complexity, false)",
}
_BOTH = f"{_filled('naive_solution.code')} AND {_filled('optimized_solution.code')}"
_OK = "coalesce(lower(trim(validation_status)) = 'passed', false)"
_LINES = "len(string_split({0}, chr(10)))"
_RESULTS = "optimization_result WHERE original_code IS NOT NULL AND optimized_code IS NOT NULL"

ORACLES = {
    "quality_summary": f"""
        SELECT count(*) AS total, count(*) FILTER (WHERE {_BOTH}) AS n_valid, coalesce(sum({' + '.join(f'({e})::INT' for e in _ISSUES.values())}), 0)::BIGINT AS n_issues,
               coalesce(round(count(*) FILTER (WHERE {_BOTH}) * 100 / nullif(count(*), 0), 4), 0) AS success_rate FROM dataset_scraper""",
    "quality_issues": " UNION ALL ".join(f"SELECT '{n}' AS issue, count(*) AS n, min(problem_id) AS first_id FROM dataset_scraper WHERE {e} HAVING count(*) > 0" for n, e in _ISSUES.items()),
    "exact_split": """
        WITH r AS (SELECT example_id, row_number() OVER (ORDER BY md5(example_id::VARCHAR), example_id) AS p, count(*) OVER () AS n FROM simple_dataset_generator),
             s AS (SELECT *, CASE WHEN p <= floor(0.8 * n) THEN 'train' WHEN p <= floor(0.8 * n) + floor(0.1 * n) THEN 'validation' ELSE 'test' END AS split FROM r)
        SELECT split, count(*) AS n, min(example_id) AS first_id, sum(example_id)::BIGINT AS sum_id FROM s GROUP BY 1""",
    "changed_rate": """
        SELECT count(*) AS total, count(*) FILTER (WHERE original_code <> optimized_code) AS n_changed,
               round(avg(coalesce(original_code <> optimized_code, false)::INT), 6) AS success_rate,
               round(avg(CASE WHEN original_code <> optimized_code THEN CASE WHEN length(original_code) > 0
                         THEN (length(original_code) - length(optimized_code)) / length(original_code) * 100 ELSE 0 END END), 4) AS mean_shorter FROM optimization_result""",
    "run_summary": f"""
        SELECT count(*) AS total, count(*) FILTER (WHERE {_OK}) AS n_passed, round(count(*) FILTER (WHERE {_OK}) * 100 / count(*), 4) AS success_rate,
               round(coalesce(avg(processing_time) FILTER (WHERE {_OK}), 0), 6) AS mean_time, round(coalesce(avg(performance_improvement) FILTER (WHERE {_OK}), 0), 6) AS mean_improvement
        FROM optimization_result""",
    "run_comparison": f"""
        WITH r AS (SELECT processing_time AS v, {_OK} AS f FROM optimization_candidate WHERE processing_time IS NOT NULL),
             s AS (SELECT avg(v) FILTER (WHERE f) AS m1, var_samp(v) FILTER (WHERE f) AS s1, count(*) FILTER (WHERE f) AS n1,
                          avg(v) FILTER (WHERE NOT f) AS m2, var_samp(v) FILTER (WHERE NOT f) AS s2, count(*) FILTER (WHERE NOT f) AS n2 FROM r),
             t AS (SELECT *, round(abs(m1 - m2) / sqrt(s1 / n1 + s2 / n2), 4) AS t FROM s)
        SELECT t, (CASE WHEN t > 2.0 THEN 0.05 WHEN t > 1.5 THEN 0.1 ELSE 0.5 END)::DOUBLE AS p, CASE WHEN t > 2.0 THEN 'high' ELSE 'low' END AS level,
               round((m2 - m1) / m2 * 100, 4) AS time_improvement FROM t""",
    "validation_verdicts": f"""
        SELECT request_id, count(*) AS n, count(*) FILTER (WHERE {_OK}) AS n_passed, bool_and({_OK}) AS all_passed,
               CASE WHEN count(*) FILTER (WHERE {_OK}) = count(*) THEN 'valid' WHEN count(*) FILTER (WHERE {_OK}) > 0 THEN 'partly valid' ELSE 'invalid' END AS verdict
        FROM optimization_candidate WHERE request_id IS NOT NULL GROUP BY 1""",
    "output_comparison": """
        SELECT l_returnflag, count(*) AS n_cases, count(*) FILTER (WHERE l_linenumber <> 7) AS n_equal, bool_and(l_linenumber <> 7) AS all_equal
        FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem) GROUP BY 1""",
    "hybrid_results": f"""
        WITH c AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY confidence_score DESC NULLS LAST, candidate_id) AS k FROM optimization_candidate WHERE request_id IS NOT NULL),
             w AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY k) AS first FROM c WHERE k <= 5 AND {_OK})
        SELECT r.request_id, w.candidate_id, md5(coalesce(w.optimized_code, r.code)) AS digest, coalesce(w.complexity_improvement['before'], 'O(n)') AS before,
               coalesce(w.complexity_improvement['after'], 'O(n)') AS after, w.candidate_id IS NOT NULL AS success
        FROM optimization_request r LEFT JOIN w ON w.request_id = r.request_id AND w.first = 1""",
    "feedback_summary": """
        SELECT count(*) AS total_feedback, round_even(coalesce(avg(user_rating) FILTER (WHERE user_rating > 0), 0), 2) AS average_rating,
               (SELECT '{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}' FROM (SELECT coalesce(lower(trim(user_feedback)), 'unknown') AS k, count(*) AS n FROM feedback GROUP BY 1)) AS kinds
        FROM feedback""",
    "stream_feedback_stats": """
        SELECT lower(trim(user_feedback)) AS kind, count(*) AS n, sum(user_rating) FILTER (WHERE user_rating > 0)::BIGINT AS rated_sum, count(*) FILTER (WHERE user_rating > 0) AS n_rated
        FROM feedback GROUP BY 1""",
    "token_expiry": """
        SELECT user_id, count(*) AS n FROM (SELECT user_id, ts, min(ts) OVER (PARTITION BY user_id) AS issued FROM events) WHERE ts < issued + INTERVAL 1 hour GROUP BY 1""",
    "session_batches": """
        SELECT session_id, id, rank::INT AS rank FROM (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY id) AS rank FROM feedback WHERE session_id IS NOT NULL) WHERE rank <= 10""",
    "technique_ranks": """
        WITH c AS (SELECT session_id, coalesce(predicted_technique, '') AS technique, count(*) AS n FROM feedback WHERE session_id IS NOT NULL GROUP BY 1, 2),
             s AS (SELECT session_id, technique, round(n / sum(n) OVER (PARTITION BY session_id), 6) AS share FROM c)
        SELECT session_id, technique, share, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY share DESC, technique) AS rank FROM s) WHERE rank <= 3""",
    "technique_templates": "SELECT technique, count(*) AS n, "
    + ", ".join(f"{_case('technique', {k: v[i] for k, v in dims.TEMPLATES.items()}, chr(39) * 2)} AS {n}" for i, n in enumerate(("description", "complexity", "structure", "use_case")))
    + " FROM (SELECT unnest(applied_techniques) AS technique FROM optimization_candidate) GROUP BY 1",
    "response_rows": f"""
        WITH r AS (SELECT *, {_LINES.format('original_code')} AS x, {_LINES.format('optimized_code')} AS y,
                          {_case(_cls('complexity_before'), dims.SPEEDUP_RANK, '3')} - {_case(_cls('complexity_after'), dims.SPEEDUP_RANK, '3')} AS gain FROM {_RESULTS})
        SELECT result_id AS "resultId", strftime(created_at, '%Y-%m-%d %H:%M:%S') AS timestamp,
               round((CASE WHEN original_code = optimized_code THEN 0 WHEN x > y THEN (x - y) * 100.0 / x WHEN gain > 0 THEN 40 ELSE 10 END)::DOUBLE, 4) AS improvement,
               CASE WHEN gain > 0 THEN concat_ws('; ', (pow(2, gain) * 100)::BIGINT || 'x faster for 100 elements', (pow(2, gain) * 1000)::BIGINT || 'x faster for 1,000 elements',
                    (pow(2, gain) * 10000)::BIGINT || 'x faster for 10,000 elements') END AS gains,
               '[' || array_to_string(list_transform(applied_techniques, lambda t: '"' || t || '"'), ',') || ']' AS techniques,
               coalesce(array_to_string(list_filter(applied_techniques, lambda t: contains(t, 'hash') OR contains(t, 'fold')), ','), '') AS kept FROM r""",
    "theoretical_savings": "SELECT n, n * n AS quadratic, n AS linear, n AS times_fewer FROM (SELECT unnest([100, 1000, 10000, 100000])::BIGINT AS n)",
    "rule_explanations": f"""
        WITH r AS (SELECT *, lower(array_to_string(applied_techniques, ' ')) AS rules FROM {_RESULTS})
        SELECT result_id, '# Code Optimization Explanation' || chr(10) || chr(10) || '## Optimization Techniques Applied' || chr(10) || chr(10)
               || coalesce(array_to_string(list_transform(applied_techniques, lambda t: '- ' || t || chr(10)), ''), '') || chr(10)
               || '## Complexity Analysis' || chr(10) || chr(10) || '- Original code complexity: ' || coalesce(complexity_before, 'unknown') || chr(10)
               || '- Optimized code complexity: ' || coalesce(complexity_after, 'unknown') || chr(10) || '- Original code size: ' || {_LINES.format('original_code')} || ' lines' || chr(10)
               || '- Optimized code size: ' || {_LINES.format('optimized_code')} || ' lines' || chr(10) || chr(10) || '## Improvements' || chr(10) || chr(10)
               || CASE WHEN complexity_before <> complexity_after THEN '{explain.NOTES["complexity"]}' || chr(10) ELSE '' END
               || CASE WHEN contains(rules, 'loop') THEN '{explain.NOTES["loop"]}' || chr(10) ELSE '' END
               || CASE WHEN contains(rules, 'dead code') OR contains(rules, 'unused') THEN '{explain.NOTES["unused"]}' || chr(10) ELSE '' END
               || CASE WHEN contains(rules, 'algorithm') OR contains(rules, 'pattern') THEN '{explain.NOTES["algorithm"]}' || chr(10) ELSE '' END AS explanation FROM r""",
    "pairs_used_once": """
        WITH c AS (SELECT p_size AS v, count(*) AS n FROM part WHERE p_size IS NOT NULL GROUP BY 1)
        SELECT coalesce(sum(CASE WHEN a.v = b.v THEN a.n // 2 ELSE least(a.n, b.n) END), 0)::BIGINT AS n_pairs FROM c a JOIN c b ON b.v = 50 - a.v AND a.v <= b.v""",
    "top_balances": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 10",
    "sorted_quantities": """
        WITH r AS (SELECT l_orderkey, list_sort(list(l_quantity::INT)) AS q FROM lineitem GROUP BY 1)
        SELECT l_orderkey, array_to_string(q, ',') AS ordered, array_to_string(list_sort(list_distinct(q)), ',') AS different, coalesce(list_position(q, 10), 0)::BIGINT - 1 AS place FROM r""",
    "anagram_pairs": f"""
        SELECT {_LETTERS.format('p_name')} = {_LETTERS.format('reverse(p_name)')} AS own, {_LETTERS.format('p_brand')} = {_LETTERS.format('p_type')} AS other, count(*) AS n FROM part GROUP BY 1, 2""",
    "number_series": """
        WITH RECURSIVE s(i, a, b) AS (SELECT 0::BIGINT, 1::BIGINT, 1::BIGINT UNION ALL SELECT i + 1, b, a + b FROM s WHERE i < 60)
        SELECT n, n * (n + 1) * (2 * n + 1) // 6 AS squares, n * n AS power, s.a AS stairs, factorial((n % 10)::INT)::BIGINT AS factorial
        FROM (SELECT DISTINCT p_size::BIGINT AS n FROM part WHERE p_size BETWEEN 1 AND 60) JOIN s ON s.i = n""",
    "size_islands": """
        WITH RECURSIVE c AS (SELECT DISTINCT p_partkey // 50 AS x, p_partkey % 50 AS y FROM part WHERE p_size > 25),
             e AS (SELECT a.x * 50 + a.y AS s, b.x * 50 + b.y AS t FROM c a JOIN c b ON (a.x = b.x AND abs(a.y - b.y) = 1) OR (a.y = b.y AND abs(a.x - b.x) = 1)),
             r(s, t) AS (SELECT x * 50 + y, x * 50 + y FROM c UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s),
             l AS (SELECT t, min(s) AS label FROM r GROUP BY 1), k AS (SELECT label, count(*) AS n FROM l GROUP BY 1)
        SELECT n, count(*) AS n_islands FROM k GROUP BY 1""",
    "nation_distances": """
        SELECT n_nationkey AS node, min(a.range + 3.5::DOUBLE * b.range)::DOUBLE AS distance
        FROM nation, range(0, 25) a, range(0, 25) b WHERE (a.range + 7 * b.range) % 25 = n_nationkey GROUP BY 1""",
    "golden_explanations": "SELECT id, 'Hash Map (80.0%, High)' AS summary, patterns, CASE WHEN depth > 1 THEN 'Hash Map:Medium,Hash Set:Medium,Two Pointers:Medium' ELSE '' END AS alternatives, "
    "'O(n^' || depth || ') → O(n)' AS impact, top FROM (" + values(
        ["id", "patterns", "depth", "top"],
        [
            (1, "nested_loops_detected,equality_comparisons,sum_operations,return_in_loop,target_variable", 2, "nested_loops,sum_pattern,pair_pattern,for_loops,lines_of_code"),
            (2, "sum_operations", 0, "lines_of_code,function_calls"),
            (3, "equality_comparisons,sum_operations", 1, "nested_loops,lines_of_code,variables,conditional_complexity,conditionals"),
            (4, "nested_loops_detected,sum_operations,return_in_loop", 3, "nested_loops,for_loops,lines_of_code,function_calls,range_usage"),
            (5, "", 0, "function_calls,lines_of_code"),
            (6, "list_operations,return_in_loop", 1, "nested_loops,lines_of_code,for_loops,function_calls,list_operations"),
            (7, "", 0, ""), (8, "", 0, ""), (9, "", 0, "lines_of_code,function_calls"), (10, "", 0, "for_loops"),
            (11, "nested_loops_detected,equality_comparisons,return_in_loop", 2, "nested_loops,for_loops,lines_of_code,function_calls,range_usage"),
        ],
    ) + ")",
    "golden_tables": values(["id", "common", "bag"], [(1, 4, 90), (2, 0, 90), (3, 5, 90), (4, 4, 90)]),
    "three_sum_small": """
        SELECT a.n_nationkey AS x, b.n_nationkey AS y, c.n_nationkey AS z FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey
        JOIN nation c ON b.n_nationkey < c.n_nationkey AND a.n_nationkey + b.n_nationkey + c.n_nationkey = 20""",
    "seen_sizes": "SELECT p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS k FROM part) WHERE k > 1",
}
