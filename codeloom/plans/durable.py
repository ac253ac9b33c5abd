"""Lineage cuts that survive the loss of an executor.

Intermediate tables are written as parquet below ``spark.checkpoint.dir``, the folder that
the cluster shares. Only where that setting is absent (tests, local runs) a folder of our
own is made. Nothing here uses localCheckpoint or a machine-local folder on a cluster.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names, else a local one for single-machine runs."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="codeloom-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return _LOCAL[0]


def persist_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back with its lineage cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codeloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    saved = spark.read.schema(df.schema).parquet(path)
    saved.__dict__["_saved"] = path
    return saved


def forget(*tables: DataFrame) -> None:
    """Delete what persist_table wrote for these frames.

    Only for tables that nothing unsaved reads any more: whatever was made of them must have been saved
    itself, so that a lost executor needs them no longer. Frames of another origin are left alone.
    """
    for table in tables:
        path = table.__dict__.pop("_saved", None)
        if path is not None:
            jvm = table.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
