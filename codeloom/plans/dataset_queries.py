"""Dataset pipeline queries: unions, validation, profiles, splits, augmentation, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import dims
from codeloom.operators import datasets as D
from codeloom.sources.tables import table


def _scraped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dataset_scraper")


def dataset_histograms(spark: SparkSession, d: str) -> DataFrame:
    rows = _scraped(spark, d).select(F.initcap(F.trim("source")).alias("source"), F.col("optimization_technique").alias("technique"), F.lower("difficulty").alias("difficulty"))
    return D.histograms(rows, ["source", "technique", "difficulty"])


def dataset_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "simple_dataset_generator")
    return rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.length("original")), 4).alias("mean_original"),
        F.round(F.avg(F.length("optimized")), 4).alias("mean_optimized"),
        F.countDistinct("source").alias("n_sources"),
    )


def dataset_lists(spark: SparkSession, d: str) -> DataFrame:
    """Distinct sources, techniques and versions, each as one sorted text."""
    def listed(column: str) -> F.Column:
        return F.array_join(F.array_sort(F.collect_set(column)), ",")

    return _scraped(spark, d).agg(
        listed("source").alias("sources"), listed("optimization_technique").alias("techniques"), listed("dataset_version").alias("versions")
    )


def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return _scraped(spark, d).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def improvement_classes(spark: SparkSession, d: str) -> DataFrame:
    """Improvements with one kind of arrow, from the two solutions and as stated."""
    stated = F.replace("complexity_improvement", F.lit("→"), F.lit("->"))
    built = F.concat_ws(" -> ", "naive_solution.complexity", "optimized_solution.complexity")
    return _scraped(spark, d).groupBy(stated.alias("stated"), built.alias("built")).agg(F.count(F.lit(1)).alias("n"))


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    rows = _scraped(spark, d)
    found = D.issues(
        [
            (D.filled(F.col("problem_name")), "no name"),
            (D.filled(F.col("optimization_technique")), "no technique"),
            (D.filled(F.col("naive_solution.code")), "no naive code"),
            (D.filled(F.col("optimized_solution.code")), "no optimized code"),
            (F.col("naive_solution.complexity") != F.col("optimized_solution.complexity"), "complexity unchanged"),
        ]
    )
    return rows.groupBy(found.alias("issues")).agg(F.count(F.lit(1)).alias("n"))


def required_fields(spark: SparkSession, d: str) -> DataFrame:
    needed = [F.col(c) for c in ("problem_name", "naive_solution.code", "optimized_solution.code", "optimization_technique", "source")]
    return D.with_required(_scraped(spark, d), needed).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def catalogue_union(spark: SparkSession, d: str) -> DataFrame:
    """Rows of three catalogues under one schema, counted per origin and technique."""
    scraped = _scraped(spark, d).select(F.lit("scraper").alias("origin"), F.col("optimization_technique").alias("technique"), F.col("naive_solution.code").alias("before"), F.col("optimized_solution.code").alias("after"), "difficulty")
    generated = table(spark, d, "simple_dataset_generator").select(F.lit("generator").alias("origin"), F.col("category").alias("technique"), F.col("original").alias("before"), F.col("optimized").alias("after"))
    results = table(spark, d, "optimization_result").select(F.lit("result").alias("origin"), F.element_at("applied_techniques", 1).alias("technique"), F.col("original_code").alias("before"), F.col("optimized_code").alias("after")).where(F.size("applied_techniques") > 0)
    rows = D.unite([scraped, generated, results])
    return rows.groupBy("origin", "technique").agg(
        F.count(F.lit(1)).alias("n"), F.count("before").alias("n_before"), F.count("after").alias("n_after"), F.count("difficulty").alias("n_difficulty")
    )


def hash_split(spark: SparkSession, d: str) -> DataFrame:
    rows = D.hash_split(table(spark, d, "simple_dataset_generator"), "example_id", {"train": 80, "validation": 10, "test": 10})
    return rows.groupBy("split", "category").agg(F.count(F.lit(1)).alias("n"), F.min("example_id").alias("first_id"))


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "simple_dataset_generator").where("category IS NOT NULL").select("example_id", "category")
    return D.stratified_split(rows, "example_id", "category", 0.2).select("example_id", "split")


def augmented(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "simple_dataset_generator").where("original IS NOT NULL").select("example_id", "category", "original")
    return D.augment(rows, "original", 3).groupBy("category", "variant").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("original")).alias("n_chars"))


def complexity_confusion(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "optimization_result").select(
        F.coalesce(dims.canonical_class(F.col("complexity_before")), F.lit("none")).alias("t"),
        F.coalesce(dims.canonical_class(F.col("complexity_after")), F.lit("none")).alias("p"),
    )
    return D.confusion(rows, "t", "p")


def technique_scores(spark: SparkSession, d: str) -> DataFrame:
    """Weighted scores of the predicted techniques against what was applied to the request."""
    said = table(spark, d, "feedback").where("request_id IS NOT NULL").groupBy("request_id").agg(F.min_by("predicted_technique", "id").alias("p"))
    true = table(spark, d, "optimization_result").where("request_id IS NOT NULL AND size(applied_techniques) > 0")
    true = true.groupBy("request_id").agg(F.min_by(F.element_at("applied_techniques", 1), F.col("result_id")).alias("t"))
    return D.weighted_scores(true.join(said, "request_id"), "t", "p")


def run_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "optimization_candidate").withColumn("status", F.lower(F.trim("validation_status")))
    return D.run_stats(rows, ["status"], "processing_time")


def welch_t(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "optimization_candidate")
    return D.welch_t(rows, F.coalesce(F.lower(F.trim("validation_status")) == "passed", F.lit(False)), "processing_time")


def map_fields(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "optimization_candidate").select(F.explode("complexity_improvement").alias("k", "v"))
    return pairs.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        dataset_histograms, dataset_profile, dataset_lists, tag_counts, improvement_classes, quality_report, required_fields,
        catalogue_union, hash_split, stratified_split, augmented, complexity_confusion, technique_scores, run_stats, welch_t, map_fields,
    )
}


def _filled(c: str) -> str:
    return f"coalesce(length(trim({c}, ' ' || chr(9) || chr(13) || chr(10))) > 0, false)"


def _cls(c: str) -> str:
    return f"coalesce(regexp_replace(replace(replace(lower(trim({c})), '^2)', '²)'), '^3)', '³)'), '^o\\(', 'O('), 'none')"


_TITLE = "array_to_string(list_transform(string_split(lower(trim(source)), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"

ORACLES = {
    "dataset_histograms": f"""
        SELECT 'source' AS dimension, coalesce({_TITLE}, 'Unknown') AS value, count(*) AS n FROM dataset_scraper GROUP BY 2
        UNION ALL SELECT 'technique', coalesce(optimization_technique, 'Unknown'), count(*) FROM dataset_scraper GROUP BY 2
        UNION ALL SELECT 'difficulty', coalesce(lower(difficulty), 'Unknown'), count(*) FROM dataset_scraper GROUP BY 2""",
    "dataset_profile": """
        SELECT category, count(*) AS n, round(avg(length(original)), 4) AS mean_original, round(avg(length(optimized)), 4) AS mean_optimized,
               count(DISTINCT source) AS n_sources FROM simple_dataset_generator GROUP BY 1""",
    "dataset_lists": """
        SELECT array_to_string(list_sort(list(DISTINCT source) FILTER (WHERE source IS NOT NULL)), ',') AS sources,
               array_to_string(list_sort(list(DISTINCT optimization_technique) FILTER (WHERE optimization_technique IS NOT NULL)), ',') AS techniques,
               array_to_string(list_sort(list(DISTINCT dataset_version) FILTER (WHERE dataset_version IS NOT NULL)), ',') AS versions
        FROM dataset_scraper""",
    "tag_counts": "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM dataset_scraper) GROUP BY 1",
    "improvement_classes": """
        SELECT replace(complexity_improvement, '→', '->') AS stated,
               concat_ws(' -> ', naive_solution.complexity, optimized_solution.complexity) AS built, count(*) AS n
        FROM dataset_scraper GROUP BY 1, 2""",
    "quality_report": f"""
        SELECT concat_ws(',', CASE WHEN NOT {_filled('problem_name')} THEN 'no name' END,
               CASE WHEN NOT {_filled('optimization_technique')} THEN 'no technique' END,
               CASE WHEN NOT {_filled('naive_solution.code')} THEN 'no naive code' END,
               CASE WHEN NOT {_filled('optimized_solution.code')} THEN 'no optimized code' END,
               CASE WHEN NOT coalesce(naive_solution.complexity <> optimized_solution.complexity, false) THEN 'complexity unchanged' END) AS issues,
               count(*) AS n FROM dataset_scraper GROUP BY 1""",
    "required_fields": f"""
        SELECT source, count(*) AS n FROM dataset_scraper WHERE {_filled('problem_name')} AND {_filled('naive_solution.code')}
        AND {_filled('optimized_solution.code')} AND {_filled('optimization_technique')} AND {_filled('source')} GROUP BY 1""",
    "catalogue_union": """
        SELECT origin, technique, count(*) AS n, count(b) AS n_before, count(a) AS n_after, count(dif) AS n_difficulty FROM (
          SELECT 'scraper' AS origin, optimization_technique AS technique, naive_solution.code AS b, optimized_solution.code AS a, difficulty AS dif FROM dataset_scraper
          UNION ALL SELECT 'generator', category, original, optimized, NULL FROM simple_dataset_generator
          UNION ALL SELECT 'result', applied_techniques[1], original_code, optimized_code, NULL FROM optimization_result WHERE len(applied_techniques) > 0)
        GROUP BY 1, 2""",
    "hash_split": """
        WITH r AS (SELECT *, ('0x' || substr(md5(example_id::VARCHAR), 1, 6))::BIGINT % 100 AS b FROM simple_dataset_generator)
        SELECT CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END AS split, category, count(*) AS n, min(example_id) AS first_id
        FROM r GROUP BY 1, 2""",
    "stratified_split": """
        SELECT example_id, CASE WHEN (row_number() OVER (PARTITION BY category ORDER BY md5(example_id::VARCHAR), example_id) - 1)
               / count(*) OVER (PARTITION BY category) < 0.2 THEN 'test' ELSE 'train' END AS split
        FROM simple_dataset_generator WHERE category IS NOT NULL""",
    "augmented": """
        SELECT category, variant, count(*) AS n, sum(length(original) + CASE WHEN variant > 0 THEN 14 ELSE 0 END)::BIGINT AS n_chars
        FROM simple_dataset_generator, (SELECT unnest([0, 1, 2]) AS variant) WHERE original IS NOT NULL GROUP BY 1, 2""",
    "complexity_confusion": f"SELECT {_cls('complexity_before')} AS truth, {_cls('complexity_after')} AS predicted, count(*) AS n FROM optimization_result GROUP BY 1, 2",
    "technique_scores": """
        WITH s AS (SELECT request_id, arg_min(predicted_technique, id) AS p FROM feedback WHERE request_id IS NOT NULL GROUP BY 1),
             t AS (SELECT request_id, arg_min(applied_techniques[1], result_id) AS t FROM optimization_result
                   WHERE request_id IS NOT NULL AND len(applied_techniques) > 0 GROUP BY 1),
             j AS (SELECT t, p FROM t JOIN s USING (request_id)),
             l AS (SELECT t AS label, count(*) AS support, count(*) FILTER (WHERE t = p) AS hit FROM j GROUP BY 1),
             q AS (SELECT l.*, coalesce(hit / nullif((SELECT count(*) FROM j WHERE j.p = l.label), 0), 0) AS pr, hit / support AS rc FROM l)
        SELECT round(sum(hit) / sum(support), 6) AS accuracy, round(sum(pr * support) / sum(support), 6) AS precision,
               round(sum(rc * support) / sum(support), 6) AS recall,
               round(sum(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END * support) / sum(support), 6) AS f1 FROM q""",
    "run_stats": """
        SELECT lower(trim(validation_status)) AS status, count(*) AS n_runs, round(avg(processing_time), 6) AS mean,
               round(coalesce(stddev_samp(processing_time), 0), 6) AS deviation, min(processing_time) AS least, max(processing_time) AS greatest
        FROM optimization_candidate WHERE processing_time IS NOT NULL GROUP BY 1""",
    "welch_t": """
        WITH r AS (SELECT processing_time AS v, coalesce(lower(trim(validation_status)) = 'passed', false) AS f FROM optimization_candidate WHERE processing_time IS NOT NULL),
             s AS (SELECT avg(v) FILTER (WHERE f) AS m1, var_samp(v) FILTER (WHERE f) AS s1, count(*) FILTER (WHERE f) AS n1,
                          avg(v) FILTER (WHERE NOT f) AS m2, var_samp(v) FILTER (WHERE NOT f) AS s2, count(*) FILTER (WHERE NOT f) AS n2 FROM r)
        SELECT n1, n2, round(abs(m1 - m2) / sqrt(s1 / n1 + s2 / n2), 4) AS t FROM s""",
    "map_fields": """
        SELECT e.key AS k, e.value AS v, count(*) AS n
        FROM (SELECT unnest(map_entries(complexity_improvement)) AS e FROM optimization_candidate) GROUP BY 1, 2""",
}
