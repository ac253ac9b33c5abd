"""Readers of the engine's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.plans.workers import ship


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """``<directory>/<name>.parquet``; columns are pruned by Catalyst at the scan."""
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def stream_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The same table as a stream, be it one file or a folder of part files.

    The path is a pattern that only the table's own name matches: a streamed path without one has to be a folder.
    """
    return spark.readStream.schema(table(spark, directory, name).schema).parquet(f"{directory}/{name}.parque[t]")
