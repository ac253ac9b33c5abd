"""Readers and writers of code-pair datasets: JSON, CSV, envelopes, code files, feedback tables."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.text import without_fences

EXAMPLE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("original_code", "optimized_code", "complexity_before", "complexity_after", "explanation")]
    + [T.StructField("applied_rules", T.ArrayType(T.StringType())), T.StructField("category", T.StringType())]
)
FEEDBACK_DDL = (
    "id BIGINT, created_at STRING, original_code STRING, predicted_technique STRING, confidence DOUBLE, "
    "user_feedback STRING, user_rating INT, session_id STRING"
)
#: Null has a mark of its own, so that an empty text stays one; spaces at the ends of a value stay too.
_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "nullValue": "\\N", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _first_character(spark: SparkSession, path: str) -> str:
    """The first character of a text that is no white space; FileNotFoundError if there is no such path."""
    try:
        line = spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1)).head()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(path) from error
        raise
    return line[0] if line else ""


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Examples of a .json file or folder (an array, or one object a line) or of a .csv file (rules as JSON text).

    Other suffixes are refused; a missing path is a FileNotFoundError.
    """
    suffix = PurePosixPath(path.rstrip("/")).suffix
    if suffix not in (".json", ".csv"):
        raise ValueError(f"unknown format {suffix!r}")
    first = _first_character(spark, path)
    if suffix == ".json":
        rows = spark.read.schema(EXAMPLE).json(path, multiLine=first == "[")
    else:
        flat = T.StructType([f if f.name != "applied_rules" else T.StructField(f.name, T.StringType()) for f in EXAMPLE])
        rows = spark.read.schema(flat).csv(path, **_CSV)
        rows = rows.withColumn("applied_rules", F.from_json("applied_rules", T.ArrayType(T.StringType())))
    return rows.withColumn("category", F.coalesce("category", F.lit("general")))


def write_examples(df: DataFrame, path: str) -> None:
    """Examples as JSON lines or as CSV with the rules as JSON text, by the suffix."""
    suffix = PurePosixPath(path.rstrip("/")).suffix
    if suffix == ".csv":
        df.withColumn("applied_rules", F.to_json("applied_rules")).write.mode("overwrite").csv(path, **{k: v for k, v in _CSV.items() if k != "multiLine"})
    elif suffix == ".json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown format {suffix!r}")


def read_envelope(spark: SparkSession, path: str, example: T.StructType) -> DataFrame:
    """The rows of {metadata, examples: [...]} files."""
    schema = T.StructType([T.StructField("examples", T.ArrayType(example))])
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline("examples"))


def envelope_metadata(df: DataFrame, category: str, technique: str) -> DataFrame:
    """One row: total, category histogram as a map and distinct techniques, sorted."""
    counts = df.groupBy(F.coalesce(category, F.lit("Unknown")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    histogram = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("categories"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_examples"))
    names = df.agg(F.array_sort(F.collect_set(technique)).alias("techniques_covered"))
    return histogram.crossJoin(names)  # one row each


def write_dataset(df: DataFrame, path: str, category: str, technique: str) -> None:
    """Rows below ``path``/examples and one row of metadata below ``path``/metadata, both as JSON lines.

    Rows stay in as many files as they have partitions; only the metadata is one row.
    """
    df.write.mode("overwrite").json(f"{path}/examples")
    meta = envelope_metadata(df, category, technique).withColumn("created_at", F.current_timestamp())
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def write_summary(df: DataFrame, path: str, columns: list[str]) -> None:
    """One JSON row beside a dataset: the distinct values of each column, sorted."""
    df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns]).coalesce(1).write.mode("overwrite").json(path)


def read_dataset(spark: SparkSession, path: str, example: T.StructType, default: list[tuple] | None = None) -> DataFrame:
    """Rows of an envelope file or of what write_dataset wrote; ``default`` rows where nothing is there."""
    try:
        if PurePosixPath(path).suffix == ".json":
            _first_character(spark, path)
            return read_envelope(spark, path, example)
        _first_character(spark, f"{path}/examples")
        return spark.read.schema(example).json(f"{path}/examples")
    except FileNotFoundError:
        if default is None:
            raise
        return spark.createDataFrame(default, example)


ALGORITHM_CSV = (
    "`Code` string, `Alternative Code` string, `Code Type` string, `recursion_used` string, `is_optimized` string, `code_length` string, "
    "`code_tokens` string, `loop_count` string, `loop_nesting_depth` string, `Time Complexity` string, `Space Complexity` string"
)
NUMERIC = ("code_length", "code_tokens", "loop_count", "loop_nesting_depth")


def read_algorithm_csv(spark: SparkSession, path: str) -> DataFrame:
    """Algorithm rows: fences stripped from codes, flags as booleans, numbers that do not parse as null."""
    rows = spark.read.schema(ALGORITHM_CSV).csv(path, **_CSV)
    changes = {c: without_fences(F.col(c)) for c in ("Code", "Alternative Code")}
    changes |= {c: F.lower(F.trim(c)).isin("true", "1", "yes") for c in ("recursion_used", "is_optimized")}
    changes |= {c: F.expr(f"try_cast({c} AS double)") for c in NUMERIC}
    return rows.withColumns(changes)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, **{k: v for k, v in _CSV.items() if k != "multiLine"})


def read_pairs_csv(spark: SparkSession, path: str, original: str, optimized: str) -> DataFrame:
    """(original_code, optimized_code) of the named columns of a CSV; pairs with a missing side are left out."""
    rows = spark.read.csv(path, **_CSV)
    return rows.select(F.col(original).alias("original_code"), F.col(optimized).alias("optimized_code")).dropna()


def write_results(df: DataFrame, path: str) -> None:
    """Results as JSON lines (.json) or as text of one ``name: value`` line a column (.txt), by the suffix."""
    suffix = PurePosixPath(path.rstrip("/")).suffix
    if suffix == ".json":
        df.write.mode("overwrite").json(path)
    elif suffix == ".txt":
        lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]
        df.select(F.concat_ws("\n", *lines, F.lit("")).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format {suffix!r}")


def read_config(path: str, defaults: dict) -> dict:
    """Settings of a JSON file over the defaults; a missing or broken file leaves the defaults."""
    try:
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
    except (OSError, ValueError):
        return dict(defaults)
    return defaults | {k: v for k, v in found.items() if k in defaults} if isinstance(found, dict) else dict(defaults)


def append_history(df: DataFrame, path: str) -> None:
    """Append result rows with their time to a JSON log."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def read_code_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("code"))


def create_feedback_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({FEEDBACK_DDL}) USING parquet")


def append_feedback(df: DataFrame, name: str) -> None:
    """Append feedback rows; defaults are filled in, rows without an id get one from a UUID."""
    defaults = {"user_feedback": "unknown", "confidence": 0.0}
    df = df.withColumn("id", F.coalesce("id", F.xxhash64(F.expr("uuid()")).bitwiseAND(2**62 - 1)))
    df.select(
        *[
            (F.coalesce(F.col(c), F.lit(defaults[c])) if c in defaults else F.col(c)).alias(c)
            for c in (field.split()[0] for field in FEEDBACK_DDL.split(", "))
        ]
    ).write.mode("append").saveAsTable(name)
