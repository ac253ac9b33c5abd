"""Feedback and service queries: counts, ratings, rate limits, cache and candidate ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.operators import datasets as D
from codeloom.operators import relational as R
from codeloom.sources.tables import table


def _label(column: str) -> Column:
    return F.lower(F.trim(column))


def feedback_time(text: str = "created_at") -> Column:
    """Timestamp of the text formats of feedback; a trailing Z and fractions are allowed."""
    return F.coalesce(
        F.try_to_timestamp(F.regexp_replace(F.replace(F.col(text), F.lit("T"), F.lit(" ")), r"(\.\d+)?Z?$", ""), F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(F.col(text), F.lit("dd/MM/yyyy HH:mm")),
    )


def feedback_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feedback").agg(F.count(F.lit(1)).alias("n_feedback"))


def feedback_avg_rating(spark: SparkSession, d: str) -> DataFrame:
    rated = F.when(F.col("user_rating") > 0, F.col("user_rating"))
    return table(spark, d, "feedback").agg(F.bround(F.coalesce(F.avg(rated), F.lit(0.0)), 2).alias("average_rating"))


def feedback_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feedback").groupBy(_label("user_feedback").alias("user_feedback")).agg(F.count(F.lit(1)).alias("n"))


def feedback_by_technique(spark: SparkSession, d: str) -> DataFrame:
    accepted = F.count_if(_label("user_feedback") == "accepted")
    technique = F.coalesce(F.nullif("predicted_technique", F.lit("")), F.lit("Unknown"))
    return table(spark, d, "feedback").groupBy(technique.alias("technique")).agg(
        F.count(F.lit(1)).alias("n"),
        accepted.alias("n_accepted"),
        F.round(accepted / F.count(F.lit(1)), 6).alias("success_rate"),
        F.round(F.avg(F.when(F.col("confidence").between(0, 1), F.col("confidence"))), 6).alias("confidence"),
    )


def feedback_by_day(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format(feedback_time(), "yyyy-MM-dd")
    return table(spark, d, "feedback").groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


def confidence_bands(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("confidence")
    band = F.when(c > 0.7, "High").when(c > 0.4, "Medium").otherwise("Low")
    return table(spark, d, "feedback").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if(c >= 0.7).alias("n_over_threshold"))


def rate_limit_hour(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    hour = F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")
    return events.groupBy("user_id", hour).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "n"
    )


def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Requests whose code was sent before within the hour by the same key."""
    rows = table(spark, d, "optimization_request").where(D.filled(F.col("code"))).select(
        F.md5("code").alias("code_hash"), F.col("submitted_at").alias("at"), "request_id"
    )
    earlier = F.lag("at").over(Window.partitionBy("code_hash").orderBy("at", "request_id"))
    gap = F.timestamp_diff("SECOND", F.col("before"), F.col("at"))
    return rows.withColumn("before", earlier).agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.count("before").alias("n_repeated"),
        F.count_if(gap < 3600).alias("n_within_hour"),
    )


def candidate_rank(spark: SparkSession, d: str) -> DataFrame:
    """Per request the first passing candidate among the five of greatest confidence."""
    rows = table(spark, d, "optimization_candidate").where("request_id IS NOT NULL AND confidence_score IS NOT NULL")
    rows = rows.select("request_id", "candidate_id", "confidence_score", _label("validation_status").alias("status"))
    top = R.top_per_group(rows, "request_id", [F.desc("confidence_score"), F.asc("candidate_id")], 5)
    won = F.min(F.when(F.col("status") == "passed", F.struct("rank", "candidate_id")))
    return top.groupBy("request_id").agg(F.count(F.lit(1)).cast("long").alias("n_ranked"), won.alias("w")).select(
        "request_id", "n_ranked", F.col("w.candidate_id").alias("winner")
    )


def level_candidates(spark: SparkSession, d: str) -> DataFrame:
    level = F.coalesce(_label("optimization_level"), F.lit("medium"))
    count = F.when(level == "low", 1).when(level == "medium", 3).when(level == "high", 5).otherwise(3)
    return table(spark, d, "optimization_request").groupBy(level.alias("level"), count.alias("n_candidates")).agg(F.count(F.lit(1)).alias("n"))


def size_filter(spark: SparkSession, d: str) -> DataFrame:
    n = F.length(F.btrim("code", F.lit(" \t\r\n")))
    outcome = F.when(F.coalesce(n, F.lit(0)) == 0, "empty").when(n > 10000, "too long").otherwise("accepted")
    return table(spark, d, "optimization_request").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def changed_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "optimization_result")
    same = F.col("original_code").eqNullSafe(F.col("optimized_code"))
    return rows.groupBy(_label("validation_status").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~same).alias("n_changed"), F.count_if(F.col("performance_improvement") > 0).alias("n_improved")
    )


def event_json(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))


def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Confusion of requested level and validation outcome, one column per outcome."""
    rows = table(spark, d, "optimization_candidate").select("request_id", _label("validation_status").alias("status"))
    levels = table(spark, d, "optimization_request").select("request_id", F.coalesce(_label("optimization_level"), F.lit("none")).alias("level"))
    names = ["passed", "failed", "skipped", "error"]
    return rows.join(levels, "request_id").groupBy("level").pivot("status", names).count().na.fill(0, names)


QUERIES = {
    f.__name__: f
    for f in (
        feedback_count, feedback_avg_rating, feedback_types, feedback_by_technique, feedback_by_day, confidence_bands,
        rate_limit_hour, cache_hits, candidate_rank, level_candidates, size_filter, changed_candidates, event_json, status_pivot,
    )
}

_TRIMMED = "length(trim({0}, ' ' || chr(9) || chr(13) || chr(10)))"

ORACLES = {
    "feedback_count": "SELECT count(*) AS n_feedback FROM feedback",
    "feedback_avg_rating": "SELECT round_even(coalesce(avg(user_rating) FILTER (WHERE user_rating > 0), 0), 2) AS average_rating FROM feedback",
    "feedback_types": "SELECT lower(trim(user_feedback)) AS user_feedback, count(*) AS n FROM feedback GROUP BY 1",
    "feedback_by_technique": """
        SELECT coalesce(nullif(predicted_technique, ''), 'Unknown') AS technique, count(*) AS n,
               count(*) FILTER (WHERE lower(trim(user_feedback)) = 'accepted') AS n_accepted,
               round(count(*) FILTER (WHERE lower(trim(user_feedback)) = 'accepted') / count(*), 6) AS success_rate,
               round(avg(confidence) FILTER (WHERE confidence BETWEEN 0 AND 1), 6) AS confidence
        FROM feedback GROUP BY 1""",
    "feedback_by_day": """
        SELECT strftime(coalesce(try_strptime(substr(replace(created_at, 'T', ' '), 1, 19), '%Y-%m-%d %H:%M:%S'),
                                 try_strptime(created_at, '%d/%m/%Y %H:%M')), '%Y-%m-%d') AS day, count(*) AS n
        FROM feedback GROUP BY 1""",
    "confidence_bands": """
        SELECT CASE WHEN confidence > 0.7 THEN 'High' WHEN confidence > 0.4 THEN 'Medium' ELSE 'Low' END AS band,
               count(*) AS n, count(*) FILTER (WHERE confidence >= 0.7) AS n_over_threshold
        FROM feedback GROUP BY 1""",
    "rate_limit_hour": """
        SELECT user_id, strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M') AS hour, count(*) AS n
        FROM events GROUP BY 1, 2 HAVING count(*) > 1""",
    "cache_hits": f"""
        WITH r AS (SELECT md5(code) AS h, submitted_at AS t, request_id FROM optimization_request WHERE {_TRIMMED.format('code')} > 0),
             l AS (SELECT t, lag(t) OVER (PARTITION BY h ORDER BY t, request_id) AS p FROM r)
        SELECT count(*) AS n_requests, count(p) AS n_repeated,
               count(*) FILTER (WHERE epoch_us(t) - epoch_us(p) < 3600000000) AS n_within_hour FROM l""",
    "candidate_rank": """
        WITH r AS (SELECT request_id, candidate_id, lower(trim(validation_status)) AS s,
                          row_number() OVER (PARTITION BY request_id ORDER BY confidence_score DESC, candidate_id) AS k
                   FROM optimization_candidate WHERE request_id IS NOT NULL AND confidence_score IS NOT NULL)
        SELECT request_id, count(*) AS n_ranked, arg_min(candidate_id, k) FILTER (WHERE s = 'passed') AS winner
        FROM r WHERE k <= 5 GROUP BY 1""",
    "level_candidates": """
        SELECT l AS level, CASE l WHEN 'low' THEN 1 WHEN 'medium' THEN 3 WHEN 'high' THEN 5 ELSE 3 END AS n_candidates, count(*) AS n
        FROM (SELECT coalesce(lower(trim(optimization_level)), 'medium') AS l FROM optimization_request) GROUP BY 1, 2""",
    "size_filter": f"""
        SELECT CASE WHEN coalesce({_TRIMMED.format('code')}, 0) = 0 THEN 'empty' WHEN {_TRIMMED.format('code')} > 10000 THEN 'too long'
               ELSE 'accepted' END AS outcome, count(*) AS n FROM optimization_request GROUP BY 1""",
    "changed_candidates": """
        SELECT lower(trim(validation_status)) AS status, count(*) AS n,
               count(*) FILTER (WHERE original_code IS DISTINCT FROM optimized_code) AS n_changed,
               count(*) FILTER (WHERE performance_improvement > 0) AS n_improved
        FROM optimization_result GROUP BY 1""",
    "event_json": """
        SELECT event_type, count(k) AS n, sum(k)::BIGINT AS sum_k, max(k) AS max_k
        FROM (SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events) GROUP BY 1""",
    "status_pivot": """
        SELECT coalesce(lower(trim(q.optimization_level)), 'none') AS level,
               count(*) FILTER (WHERE lower(trim(c.validation_status)) = 'passed') AS passed,
               count(*) FILTER (WHERE lower(trim(c.validation_status)) = 'failed') AS failed,
               count(*) FILTER (WHERE lower(trim(c.validation_status)) = 'skipped') AS skipped,
               count(*) FILTER (WHERE lower(trim(c.validation_status)) = 'error') AS error
        FROM optimization_candidate c JOIN optimization_request q USING (request_id) GROUP BY 1""",
}
