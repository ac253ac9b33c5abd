"""Round trips through the file formats, the catalogue and the generators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import syntax
from codeloom.plans.durable import shared_dir
from codeloom.plans.golden_queries import values
from codeloom.sources import catalogue, files, synthetic
from codeloom.sources.tables import table


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/codeloom-{uuid.uuid4().hex}-{name}"


def _examples(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "simple_dataset_generator")
    return rows.select(
        F.col("original").alias("original_code"), F.col("optimized").alias("optimized_code"), "complexity_before", "complexity_after", "explanation",
        F.array("source", "split_name").alias("applied_rules"), "category",
    )


def _told(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count("original_code").alias("n_original"), F.coalesce(F.sum(F.length("original_code")), F.lit(0)).alias("n_chars"),
        F.sum(F.size("applied_rules")).cast("long").alias("n_rules"), F.min(F.md5("optimized_code")).alias("least"),
    )


def examples_json(spark: SparkSession, d: str) -> DataFrame:
    """Examples written as JSON lines and read back."""
    path = _path(spark, "set.json")
    files.write_examples(_examples(spark, d), path)
    return _told(files.read_examples(spark, path))


def examples_csv(spark: SparkSession, d: str) -> DataFrame:
    """Examples written as CSV, rules as JSON text, and read back."""
    path = _path(spark, "set.csv")
    files.write_examples(_examples(spark, d), path)
    return _told(files.read_examples(spark, path))


def dataset_envelope(spark: SparkSession, d: str) -> DataFrame:
    """The metadata that a dataset's writer put beside its rows, with the number of rows that come back."""
    path = _path(spark, "set")
    rows = _examples(spark, d)
    files.write_dataset(rows, path, "category", "complexity_after")
    n = files.read_dataset(spark, path, files.EXAMPLE).agg(F.count(F.lit(1)).alias("n_rows"))
    meta = spark.read.schema("total_examples long, categories map<string,long>, techniques_covered array<string>").json(f"{path}/metadata")
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("categories")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return meta.crossJoin(n).select("total_examples", shown.alias("categories"), F.array_join("techniques_covered", ",").alias("techniques"), "n_rows")  # one row each


def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    """The side file of a dataset's distinct values, read back."""
    path = _path(spark, "summary.json")
    columns = ["source", "optimization_technique", "difficulty", "dataset_version"]
    files.write_summary(table(spark, d, "dataset_scraper"), path, columns)
    rows = spark.read.schema(", ".join(f"{c} array<string>" for c in columns)).json(path)
    return rows.select(*[F.array_join(c, ",").alias(c) for c in columns])


def algorithm_csv(spark: SparkSession, d: str) -> DataFrame:
    """Algorithm rows through their CSV form: profile per time complexity."""
    rows = table(spark, d, "optimization_result").where("original_code IS NOT NULL AND optimized_code IS NOT NULL")
    path = _path(spark, "algorithms.csv")
    fenced = F.concat(F.lit("```python\n"), F.col("optimized_code"), F.lit("\n```"))
    files.write_csv(
        rows.select(
            F.col("original_code").alias("Code"), fenced.alias("Alternative Code"), F.element_at(F.col("applied_techniques"), F.when(F.size("applied_techniques") > 0, 1).otherwise(None)).alias("Code Type"),
            F.when(F.col("result_id") % 2 == 0, "True").otherwise("False").alias("recursion_used"), (F.col("original_code") != F.col("optimized_code")).cast("string").alias("is_optimized"),
            F.length("original_code").alias("code_length"), F.when(F.col("result_id") % 7 == 0, "many").otherwise(F.size(F.split("original_code", " ")).cast("string")).alias("code_tokens"),
            F.lit("1").alias("loop_count"), F.lit("").alias("loop_nesting_depth"), F.col("complexity_before").alias("Time Complexity"), F.lit("O(1)").alias("Space Complexity"),
        ),
        path,
    )
    back = files.read_algorithm_csv(spark, path)
    return back.groupBy(F.col("Time Complexity").alias("time_complexity")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_optimized").alias("n_optimized"), F.count_if(~F.col("is_optimized")).alias("n_not"), F.count_if("recursion_used").alias("n_recursive"),
        F.round(F.avg("code_length"), 4).alias("mean_length"), F.round(F.avg("code_tokens"), 4).alias("mean_tokens"), F.count("loop_nesting_depth").alias("n_depth"),
        F.sum(F.length("Alternative Code")).alias("n_chars"),
    )


def results_export(spark: SparkSession, d: str) -> DataFrame:
    """Results as text files: lines per name that come back."""
    path = _path(spark, "results.txt")
    files.write_results(table(spark, d, "optimization_result").select("result_id", "complexity_before", "complexity_after"), path)
    lines = spark.read.text(path).where("value <> ''")
    return lines.groupBy(F.substring_index("value", ":", 1).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"))


def catalogue_rows(spark: SparkSession, d: str) -> DataFrame:
    """Per source of the catalogue: rows and those of which both codes parse."""
    rows = catalogue.sourced(spark)
    a = syntax.validity(rows, "problem_id", "brute_force", "slow", ("optimized", "source"))
    b = syntax.validity(a, "problem_id", "optimized", "fast", ("slow", "source"))
    return b.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("slow") & F.col("fast")).alias("n_valid"))


def catalogue_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a list of slugs; the unknown one is dropped."""
    return catalogue.by_slug(spark, ["pair-with-sum", "kth-largest", "no-such-problem"]).select("slug", "technique", "data_structure")


def catalogue_variations(spark: SparkSession, d: str) -> DataFrame:
    """Variations with renamed variables, by their titles and whether they still parse."""
    rows = catalogue.variations(catalogue.flat(spark))
    return syntax.validity(rows, "title", "brute_force", "valid", ("category",)).select("title", "category", "valid")


def catalogue_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue as one row of parallel arrays, by their lengths, and one nested row."""
    columns = catalogue.training_columns(catalogue.training_pairs(catalogue.flat(spark)))
    nested = catalogue.nested(spark).where("problem_id = 'islands'").select("naive_solution.complexity", "optimized_solution.space_complexity", F.array_join("tags", ",").alias("tags"))
    return columns.select(F.size("originals").alias("n"), F.array_join(F.array_sort(F.array_distinct("techniques")), ",").alias("techniques")).crossJoin(nested)  # one row each


def synthetic_algorithms(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "simple_dataset_generator").count()
    parts = {"algorithm": synthetic.algorithm_examples(spark, n), "loop": synthetic.loop_examples(spark, n), "two": synthetic.two_template_examples(spark, n)}
    out = None
    for kind, rows in parts.items():
        own = rows.groupBy(F.lit(kind).alias("kind"), "explanation").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
        out = own if out is None else out.unionByName(own)
    return out


def synthetic_mixture(spark: SparkSession, d: str) -> DataFrame:
    rows = synthetic.mixed_examples(spark, table(spark, d, "simple_dataset_generator").count())
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first_place"))


def synthetic_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Test inputs of every kind of algorithm, and the edges of a random graph."""
    out = None
    for kind in ("sorting", "search", "other"):
        own = synthetic.test_inputs(spark, kind, 20).select(F.lit(kind).alias("kind"), "case", F.array_join("data", ",").alias("data"), "target")
        out = own if out is None else out.unionByName(own)
    edges = synthetic.test_graph(spark, 20).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("src") * 100 + F.col("dst")).alias("s"))
    graph = edges.select(F.lit("graph").alias("kind"), F.lit("edges").alias("case"), F.concat_ws(",", F.col("n").cast("string"), F.col("s").cast("string")).alias("data"), F.lit(None).cast("long").alias("target"))
    return out.unionByName(graph)


QUERIES = {
    f.__name__: f
    for f in (
        examples_json, examples_csv, dataset_envelope, dataset_summary, algorithm_csv, results_export, catalogue_rows, catalogue_lookup,
        catalogue_variations, catalogue_pairs, synthetic_algorithms, synthetic_mixture, synthetic_inputs,
    )
}


def _draw(name: str, low: int, high: int, at: str = "id") -> str:
    return f"(('0x' || substr(md5('{name}:' || {at}::VARCHAR), 1, 7))::BIGINT % {high - low + 1} + {low})"


_TOLD = """
    SELECT coalesce(category, 'general') AS category, count(*) AS n, count(original) AS n_original, coalesce(sum(length(original)), 0)::BIGINT AS n_chars,
           (count(*) * 2)::BIGINT AS n_rules, min(md5(optimized)) AS least FROM simple_dataset_generator GROUP BY 1"""
_N = "(SELECT count(*) FROM simple_dataset_generator)"


def _chosen(kind: str, name: str, templates: list[tuple]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{t[4]}'" for i, t in enumerate(templates, 1))
    return f"SELECT '{kind}' AS kind, CASE {_draw(name, 1, len(templates))} {cases} END AS explanation, count(*) AS n, min(id) AS first_id FROM (SELECT unnest(range({_N})) AS id) GROUP BY 1, 2"


def _drawn(name: str, high: int) -> str:
    return f"list_transform(range(1, 21), lambda i: {_draw(name, 0, high, 'i')})"


_SEARCH, _ORDERED = _drawn("search", 100), f"list_sort({_drawn('ordered', 100)})"
_INPUTS = [
    ("sorting", "random", _drawn("random", 100), "NULL"), ("sorting", "sorted", "range(0, 20)", "NULL"), ("sorting", "reversed", "range(20, 0, -1)", "NULL"),
    ("sorting", "few", _drawn("few", 5), "NULL"), ("search", "present", _SEARCH, f"({_SEARCH})[10]"), ("search", "absent", _SEARCH, "-1"),
    ("search", "ordered", _ORDERED, f"({_ORDERED})[10]"), ("other", "random", _drawn("random", 100), "NULL"), ("other", "sorted", "range(0, 20)", "NULL"),
]

ORACLES = {
    "examples_json": _TOLD,
    "examples_csv": _TOLD,
    "dataset_envelope": """
        SELECT count(*) AS total_examples, (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT coalesce(category, 'Unknown') AS k, count(*) AS n FROM simple_dataset_generator GROUP BY 1)) AS categories,
               (SELECT string_agg(DISTINCT complexity_after, ',' ORDER BY complexity_after) FROM simple_dataset_generator) AS techniques, count(*) AS n_rows
        FROM simple_dataset_generator""",
    "dataset_summary": "SELECT "
    + ", ".join(f"array_to_string(list_sort(list(DISTINCT {c}) FILTER (WHERE {c} IS NOT NULL)), ',') AS {c}" for c in ("source", "optimization_technique", "difficulty", "dataset_version"))
    + " FROM dataset_scraper",
    "algorithm_csv": """
        SELECT complexity_before AS time_complexity, count(*) AS n, count(*) FILTER (WHERE original_code <> optimized_code) AS n_optimized,
               count(*) FILTER (WHERE original_code = optimized_code) AS n_not, count(*) FILTER (WHERE result_id % 2 = 0) AS n_recursive,
               round(avg(length(original_code)), 4) AS mean_length, round(avg(CASE WHEN result_id % 7 <> 0 THEN len(string_split(original_code, ' ')) END), 4) AS mean_tokens, 0::BIGINT AS n_depth,
               sum(length(trim(replace(replace(optimized_code, '```python', ''), '```', ''), ' ' || chr(9) || chr(13) || chr(10))))::BIGINT AS n_chars
        FROM optimization_result WHERE original_code IS NOT NULL AND optimized_code IS NOT NULL GROUP BY 1""",
    "results_export": """
        SELECT name, count(*) AS n, count(DISTINCT v) AS n_values FROM (
            SELECT 'result_id' AS name, result_id::VARCHAR AS v FROM optimization_result
            UNION ALL SELECT 'complexity_before', coalesce(complexity_before, '') FROM optimization_result
            UNION ALL SELECT 'complexity_after', coalesce(complexity_after, '') FROM optimization_result) GROUP BY 1""",
    "catalogue_rows": values(["source", "n", "n_valid"], [("judge", 4, 4), ("course", 4, 4), ("contest", 4, 3)], n="BIGINT", n_valid="BIGINT"),
    "catalogue_lookup": values(["slug", "technique", "data_structure"], [("pair-with-sum", "hash_map", "dict"), ("kth-largest", "heap", "heap")]),
    "catalogue_variations": values(
        ["title", "category", "valid"],
        [
            (f"{title} (Variation)", category, title != "Broken Row")
            for title, category in (
                ("Any Repeats", "arrays"), ("Best Run", "arrays"), ("Longest Without Repeat", "strings"), ("Same Letters", "strings"), ("Loot", "dp"), ("Steps Up", "dp"),
                ("Kth Largest", "sorting"), ("Islands", "graphs"), ("Broken Row", "trees"), ("Level Order", "trees"),
            )
        ],
    ),
    "catalogue_pairs": values(
        ["n", "techniques", "complexity", "space_complexity", "tags"],
        [(12, "bfs,dynamic_programming,frequency_map,hash_map,hash_set,heap,set_intersection,sliding_window", "O(n²)", "O(n)", "graphs,bfs")],
    ),
    "synthetic_algorithms": " UNION ALL ".join(
        [_chosen("algorithm", "algorithm", catalogue.PAIRS), _chosen("loop", "loop", catalogue.LOOPS), _chosen("two", "two", catalogue.PAIRS[:2])]
    ),
    "synthetic_mixture": f"""
        WITH k AS (SELECT 'algorithm' AS kind, floor(0.4 * {_N})::BIGINT AS n UNION ALL SELECT 'folding', floor(0.3 * {_N})::BIGINT
                   UNION ALL SELECT 'loop', floor(0.2 * {_N})::BIGINT UNION ALL SELECT 'complexity', 6)
        SELECT kind, count(*) AS n, min(md5(kind || ':' || i)) AS first_place FROM (SELECT kind, unnest(range(n)) AS i FROM k) GROUP BY 1""",
    "synthetic_inputs": " UNION ALL ".join(f"SELECT '{k}' AS kind, '{c}' AS \"case\", array_to_string({data}, ',') AS data, {t}::BIGINT AS target" for k, c, data, t in _INPUTS)
    + f" UNION ALL SELECT 'graph', 'edges', count(*) || ',' || sum(id // 20 * 100 + id % 20), NULL FROM (SELECT unnest(range(400)) AS id) WHERE {_draw('edge', 0, 9)} >= 7",
}
