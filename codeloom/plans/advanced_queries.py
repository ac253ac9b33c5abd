"""Vectors, graphs, models, streams and synthetic data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.operators import datasets, graphs, models, vectors
from codeloom.plans.durable import persist_table
from codeloom.sources import synthetic
from codeloom.sources.tables import stream_table, table
from codeloom.streaming import feedback as streams


def embedding_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = vectors.vector_stats(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", *[F.round(c.cast("double"), 5).alias(n) for n, c in stats.items()])


def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Each row whose id 50 divides, against all rows."""
    rows = table(spark, d, "embeddings")
    return vectors.nearest(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding").select("query", "neighbour", F.round("cosine", 4).alias("cosine"))


def reach_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels from the first region over nations, suppliers and the parts they ship."""
    def edge(name: str, a: str, pa: str, b: str, pb: str) -> DataFrame:
        key = lambda c, p: F.concat(F.lit(p), F.col(c).cast("string"))
        return table(spark, d, name).select(key(a, pa).alias("src"), key(b, pb).alias("dst"))

    edges = edge("nation", "n_regionkey", "r", "n_nationkey", "n").union(edge("supplier", "s_nationkey", "n", "s_suppkey", "s"))
    edges = edges.union(edge("lineitem", "l_suppkey", "s", "l_partkey", "p")).distinct()
    start = spark.createDataFrame([("r0",)], "node string")
    return graphs.bfs_levels(persist_table(edges, "edges"), start).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def session_components(spark: SparkSession, d: str) -> DataFrame:
    """Sessions and requests that feedback connects: components by size."""
    rows = table(spark, d, "feedback").where("session_id IS NOT NULL AND request_id IS NOT NULL")
    edges = rows.select(F.concat(F.lit("s"), "session_id").alias("src"), F.concat(F.lit("r"), F.col("request_id").cast("string")).alias("dst")).distinct()
    sizes = graphs.components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))
    return sizes.groupBy("n_nodes").agg(F.count(F.lit(1)).alias("n_components"))


def forest_scores(spark: SparkSession, d: str) -> DataFrame:
    """A forest on the ten text features: trained on the train split, scored on the others."""
    rows = table(spark, d, "simple_dataset_generator").where("original IS NOT NULL AND category IS NOT NULL")
    code = F.col("original")
    own = rows.select("category", F.lower(F.trim("split_name")).alias("s"), *[c.cast("double").alias(n) for n, c in text.features10(code).items()])
    model = models.fit_forest(own.where("s = 'train'"), list(text.FEATURES10), "category", trees=20)
    return datasets.weighted_scores(models.predict(model, own.where("s <> 'train'")), "category", "predicted")


def stream_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """The rate limit as a stream over the events, run to its end: windows that the watermark has passed."""
    late = streams.rate_windows(stream_table(spark, d, "events"), "user_id", "ts", "1 hour", 1)
    return streams.drain(late, "rate", "append").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("hour"), "n")


def synthetic_folding(spark: SparkSession, d: str) -> DataFrame:
    """As many rows as the generator table has."""
    rows = synthetic.folding_examples(spark, table(spark, d, "simple_dataset_generator").count())
    return rows.withColumn("rule", F.array_join("applied_rules", ",")).drop("applied_rules")


QUERIES = {
    f.__name__: f
    for f in (embedding_stats, nearest_vectors, reach_levels, session_components, forest_scores, stream_rate_limit, synthetic_folding)
}


def _draw(name: str, low: int, high: int) -> str:
    return f"(('0x' || substr(md5('{name}:' || id::VARCHAR), 1, 7))::BIGINT % {high - low + 1} + {low})"


ORACLES = {
    "embedding_stats": """
        SELECT vec_id, round(list_avg(e), 5) AS mean, round(list_stddev_pop(e), 5) AS deviation, round(list_min(e), 5) AS least, round(list_max(e), 5) AS greatest
        FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""",
    "nearest_vectors": """
        WITH p AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS c
                   FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
             k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, neighbour) AS k FROM p)
        SELECT query, neighbour, round(c, 4) AS cosine FROM k WHERE k = 1""",
    "reach_levels": """
        WITH n AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 0), s AS (SELECT s_suppkey AS k FROM supplier WHERE s_nationkey IN (SELECT k FROM n)),
             p AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_suppkey IN (SELECT k FROM s)),
             c AS (SELECT 0::BIGINT AS level, 1::BIGINT AS n UNION ALL SELECT 1, count(*) FROM n UNION ALL SELECT 2, count(*) FROM s UNION ALL SELECT 3, count(*) FROM p)
        SELECT level, n FROM c WHERE n > 0""",
    "stream_rate_limit": """
        SELECT user_id, strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M') AS hour, count(*) AS n
        FROM events GROUP BY 1, 2, time_bucket(INTERVAL 1 hour, ts)
        HAVING count(*) > 1 AND time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour <= (SELECT max(ts) FROM events) - INTERVAL 1 day""",
    "synthetic_folding": f"""
        WITH r AS (SELECT unnest(range((SELECT count(*) FROM simple_dataset_generator))) AS id),
             d AS (SELECT id, {_draw('a', 1, 20)} AS a, {_draw('b', 1, 10)} AS b, {_draw('op', 0, 5)} AS op FROM r),
             e AS (SELECT id, a || ' ' || ['+', '-', '*', '//', '**', '%'][op + 1] || ' ' || b AS term,
                          CASE op WHEN 0 THEN a + b WHEN 1 THEN a - b WHEN 2 THEN a * b WHEN 3 THEN a // b
                               WHEN 4 THEN CASE WHEN b < 10 THEN pow(a::HUGEINT, b)::BIGINT ELSE a END ELSE a % b END AS v FROM d)
        SELECT id, 'def calculate():' || chr(10) || '    x = ' || term || chr(10) || '    return x' AS original_code,
               'def calculate():' || chr(10) || '    x = ' || v || chr(10) || '    return x' AS optimized_code, 'O(1)' AS complexity_before, 'O(1)' AS complexity_after,
               'Folded constant expression ' || term || ' to ' || v AS explanation, 'constant_folding' AS rule, 'constant_folding' AS category FROM e""",
}
