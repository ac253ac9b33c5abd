"""Streaming forms of the service's time-based rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.durable import shared_dir


def rate_windows(events: DataFrame, key: str, time: str, width: str, most: int, late: str = "1 day") -> DataFrame:
    """Windows in which a key has more than ``most`` events.

    In append mode a window comes out, and its state goes, once the watermark passes its end; events
    later than ``late`` are left out.
    """
    own = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    counts = own.groupBy(key, F.window("at", width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > most).select(key, F.col("w.start").alias("start"), "n")


def cached_once(requests: DataFrame, code: str, time: str, ttl: str = "1 hour") -> DataFrame:
    """The first request of each code within the time to live; repeats are answered from cache."""
    own = requests.withColumn("code_hash", F.md5(code)).withColumn("at", F.col(time).cast("timestamp"))
    return own.withWatermark("at", ttl).dropDuplicatesWithinWatermark(["code_hash"])


def running_stats(feedback: DataFrame, rating: str, kind: str) -> DataFrame:
    """Rows, mean of the given ratings and rows per kind so far, of a stream (complete mode: one row a kind)."""
    rated = F.when(F.col(rating) > 0, F.col(rating))
    return feedback.groupBy(F.lower(F.trim(kind)).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(rated).alias("rated_sum"), F.count(rated).alias("n_rated"))


def unexpired(tokens: DataFrame, issued: str, now: str, hours: int = 1) -> DataFrame:
    """Rows whose token is at most ``hours`` old at the time in column ``now``."""
    return tokens.where((F.col(now) >= F.col(issued)) & (F.col(now) < F.col(issued) + F.expr(f"INTERVAL {hours} HOURS")))


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now and return its last result as a table."""
    spark: SparkSession = stream.sparkSession
    import uuid

    base = f"{shared_dir(spark)}/codeloom-{name}-{uuid.uuid4().hex}"
    # A stream without any input runs no batch; its result is the empty table.
    spark.createDataFrame([], stream.schema).write.parquet(f"{base}/out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
