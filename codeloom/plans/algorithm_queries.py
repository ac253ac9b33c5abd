"""Nested-loop algorithms as relational plans over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import relational as R
from codeloom.sources.tables import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events with whole-numbered values around zero."""
    return table(spark, d, "events").select("user_id", "event_id", "event_type", (F.floor("value") - 245).cast("long").alias("v"))


def _orders(spark: SparkSession, d: str, q: Column) -> DataFrame:
    """Orders of each customer with a whole number ``q`` made of the whole price ``v``."""
    rows = table(spark, d, "orders").withColumn("v", F.floor("o_totalprice").cast("long"))
    return rows.select("o_custkey", "o_orderkey", q.alias("q"))


def two_sum_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a customer's orders whose whole prices add up to a target; target on one side."""
    rows = table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("v"))
    return R.pair_join(rows, "o_orderkey", "v", 200000).agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("sum_i"), F.sum("j").alias("sum_j"))


def two_sum_first(spark: SparkSession, d: str) -> DataFrame:
    return R.two_sum_first(_events(spark, d), "user_id", "event_id", "v", 50)


def count_pairs(spark: SparkSession, d: str) -> DataFrame:
    return R.count_pairs(table(spark, d, "part"), "p_size", 50)


def pair_exists(spark: SparkSession, d: str) -> DataFrame:
    return R.pair_exists(table(spark, d, "part"), "p_size", 150)


def three_sum(spark: SparkSession, d: str) -> DataFrame:
    return R.three_sum(table(spark, d, "part"), "p_size", 60)


def contains_duplicate(spark: SparkSession, d: str) -> DataFrame:
    return R.contains_duplicate(table(spark, d, "orders"), "o_orderkey")


def duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    return R.duplicates(table(spark, d, "part"), "p_name")


def missing_number(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    low, high = rows.agg(F.min("o_custkey"), F.max("o_custkey")).first()
    return R.missing_numbers(rows, "o_custkey", low, high)


def inversions(spark: SparkSession, d: str) -> DataFrame:
    return R.inversions(_events(spark, d), "user_id", "event_id", "v")


def greater_pairs(spark: SparkSession, d: str) -> DataFrame:
    return R.greater_pairs(table(spark, d, "part"), "p_size")


def first_position(spark: SparkSession, d: str) -> DataFrame:
    return R.position_of(table(spark, d, "part"), "p_partkey", "p_size", 7)


def sock_pairs(spark: SparkSession, d: str) -> DataFrame:
    return R.pairs_of_equals(table(spark, d, "part"), "p_size")


def majority(spark: SparkSession, d: str) -> DataFrame:
    return R.majority(table(spark, d, "lineitem").withColumn("v", (F.col("l_returnflag") == "N").cast("int")), "v")


def frequency_map(spark: SparkSession, d: str) -> DataFrame:
    return R.value_counts(table(spark, d, "events"), "event_type")


def group_anagrams(spark: SparkSession, d: str) -> DataFrame:
    return R.anagram_groups(table(spark, d, "part"), "p_name")


def product_except_self(spark: SparkSession, d: str) -> DataFrame:
    return R.product_except_self(_orders(spark, d, F.col("v") % 3), "o_custkey", "o_orderkey", "q")


def max_subarray(spark: SparkSession, d: str) -> DataFrame:
    return R.max_subarray(_events(spark, d), "user_id", "event_id", "v")


def max_product(spark: SparkSession, d: str) -> DataFrame:
    return R.max_product(_orders(spark, d, F.col("v") % 7 - 3), "o_custkey", "o_orderkey", "q")


def stock_profit(spark: SparkSession, d: str) -> DataFrame:
    return R.stock_profit(_events(spark, d), "user_id", "event_id", "v")


def sliding_max(spark: SparkSession, d: str) -> DataFrame:
    return R.sliding_max(_events(spark, d), "user_id", "event_id", "v", 4)


def subarray_sum_k(spark: SparkSession, d: str) -> DataFrame:
    return R.subarrays_with_sum(_events(spark, d), "user_id", "event_id", "v", 10)


def difference_array(spark: SparkSession, d: str) -> DataFrame:
    updates = table(spark, d, "lineitem").select("l_partkey", (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("last"), F.col("l_quantity").cast("long").alias("k"))
    return R.difference_array(updates, "l_partkey", "last", "k")


def longest_unique_run(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", R.longest_unique_run("p_name").cast("long").alias("n"))


def house_robber(spark: SparkSession, d: str) -> DataFrame:
    return R.house_robber(_orders(spark, d, F.col("v")), "o_custkey", "o_orderkey", "q")


def kth_largest(spark: SparkSession, d: str) -> DataFrame:
    return R.kth_largest(table(spark, d, "orders"), "o_totalprice", 25)


def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.top_per_group(rows, "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).withColumn("rank", F.col("rank").cast("long"))


def seen_before(spark: SparkSession, d: str) -> DataFrame:
    return R.repeats(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", "p_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("s"))


def array_intersection(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return a.intersect(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k")))


def array_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    return a.union(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))).distinct()


def number_formulas(spark: SparkSession, d: str) -> DataFrame:
    """Sum, sum of squares and Fibonacci number up to each part size."""
    n = F.col("n")
    fib = F.expr("aggregate(sequence(1, n), struct(0L AS a, 1L AS b), (s, i) -> struct(s.b AS a, s.a + s.b AS b), s -> s.a)")
    sizes = table(spark, d, "part").select(F.col("p_size").alias("n")).where("n > 0").distinct()
    return sizes.select("n", F.expr("n * (n + 1) div 2").alias("total"), F.expr("CAST(n AS bigint) * (n + 1) * (2 * n + 1) div 6").alias("squares"), fib.alias("fibonacci"))


def extremes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.max("l_extendedprice").alias("greatest"), F.min("l_extendedprice").alias("least"))


QUERIES = {
    f.__name__: f
    for f in (
        two_sum_pairs, two_sum_first, count_pairs, pair_exists, three_sum, contains_duplicate, duplicate_names, missing_number,
        inversions, greater_pairs, first_position, sock_pairs, majority, frequency_map, group_anagrams, product_except_self,
        max_subarray, max_product, stock_profit, sliding_max, subarray_sum_k, difference_array, longest_unique_run, house_robber,
        kth_largest, topk_per_group, seen_before, array_intersection, array_union, number_formulas, extremes,
    )
}

_E = "(SELECT user_id, event_id, event_type, floor(value)::BIGINT - 245 AS v FROM events)"

ORACLES = {
    "two_sum_pairs": """
        WITH o AS (SELECT o_orderkey AS k, floor(o_totalprice)::BIGINT AS v FROM orders)
        SELECT count(*) AS n, sum(a.k)::BIGINT AS sum_i, sum(b.k)::BIGINT AS sum_j FROM o a JOIN o b ON b.v = 200000 - a.v AND a.k < b.k""",
    "two_sum_first": f"""
        WITH p AS (SELECT a.user_id, a.event_id AS i, b.event_id AS j, row_number() OVER (PARTITION BY a.user_id ORDER BY b.event_id, a.event_id DESC) AS k
                   FROM {_E} a JOIN {_E} b ON a.user_id = b.user_id AND b.v = 50 - a.v AND a.event_id < b.event_id)
        SELECT user_id, i, j FROM p WHERE k = 1""",
    "count_pairs": """
        WITH c AS (SELECT p_size AS v, count(*) AS n FROM part GROUP BY 1)
        SELECT coalesce(sum(CASE WHEN a.v = b.v THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END), 0)::BIGINT AS n_pairs
        FROM c a JOIN c b ON b.v = 50 - a.v AND a.v <= b.v""",
    "pair_exists": "SELECT EXISTS (SELECT 1 FROM part a JOIN part b ON a.p_size + b.p_size = 150 AND a.p_partkey < b.p_partkey) AS pair_exists",
    "three_sum": """
        WITH c AS (SELECT p_size AS v, count(*) AS n FROM part GROUP BY 1)
        SELECT a.v AS x, b.v AS y, c3.v AS z FROM c a JOIN c b ON a.v <= b.v JOIN c c3 ON b.v <= c3.v AND a.v + b.v + c3.v = 60
        WHERE (a.v < b.v OR a.n > 1) AND (b.v < c3.v OR b.n > 1) AND (a.v < c3.v OR a.n > 2)""",
    "contains_duplicate": "SELECT count(*) > count(DISTINCT o_orderkey) AS contains_duplicate FROM orders",
    "duplicate_names": "SELECT p_name AS v, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1",
    "missing_number": """
        SELECT v FROM (SELECT unnest(range(min(o_custkey), max(o_custkey) + 1)) AS v FROM orders)
        WHERE v NOT IN (SELECT o_custkey FROM orders)""",
    "inversions": f"""
        SELECT u.user_id, count(p.i) AS n_inversions FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN
          (SELECT a.user_id, a.event_id AS i FROM {_E} a JOIN {_E} b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.v > b.v) p
        ON u.user_id = p.user_id GROUP BY 1""",
    "greater_pairs": """
        WITH c AS (SELECT p_size AS v, count(*) AS n FROM part GROUP BY 1)
        SELECT coalesce(sum(a.n * b.n), 0)::BIGINT AS n_pairs FROM c a JOIN c b ON a.v > b.v""",
    "first_position": "SELECT coalesce(min(p_partkey) FILTER (WHERE p_size = 7), -1)::BIGINT AS position FROM part",
    "sock_pairs": "SELECT coalesce(sum(n // 2), 0)::BIGINT AS n_pairs FROM (SELECT count(*) AS n FROM part GROUP BY p_size)",
    "majority": """
        WITH c AS (SELECT (l_returnflag = 'N')::INT AS v, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT CASE WHEN max(n) * 2 > sum(n) THEN arg_max(v, n) ELSE -1 END::BIGINT AS majority FROM c""",
    "frequency_map": "SELECT event_type AS v, count(*) AS n FROM events GROUP BY 1",
    "group_anagrams": """
        SELECT array_to_string(list_sort(string_split(w, '')), '') AS letters, count(*) AS n, min(w) AS least
        FROM (SELECT DISTINCT lower(p_name) AS w FROM part) GROUP BY 1""",
    "product_except_self": """
        SELECT a.o_custkey, a.o_orderkey, coalesce(product(floor(b.o_totalprice)::BIGINT % 3), 1)::DOUBLE AS product FROM orders a LEFT JOIN orders b
        ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey GROUP BY 1, 2""",
    "max_subarray": f"""
        WITH s AS (SELECT user_id, event_id, sum(v) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM {_E}),
             m AS (SELECT user_id, s - least(0, coalesce(min(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS b FROM s)
        SELECT user_id, max(b)::BIGINT AS max_sum FROM m GROUP BY 1""",
    "max_product": """
        WITH r AS (SELECT o_custkey, o_orderkey, floor(o_totalprice)::BIGINT % 7 - 3 AS q FROM orders)
        SELECT o_custkey, max(p) AS max_product FROM (
          SELECT a.o_custkey, a.o_orderkey, b.o_orderkey AS z, product(c.q) AS p FROM r a
          JOIN r b ON a.o_custkey = b.o_custkey AND a.o_orderkey <= b.o_orderkey
          JOIN r c ON a.o_custkey = c.o_custkey AND c.o_orderkey BETWEEN a.o_orderkey AND b.o_orderkey GROUP BY 1, 2, 3) GROUP BY 1""",
    "stock_profit": f"SELECT user_id, max(v - m)::BIGINT AS profit FROM (SELECT user_id, v, min(v) OVER (PARTITION BY user_id ORDER BY event_id) AS m FROM {_E}) GROUP BY 1",
    "sliding_max": f"""
        SELECT user_id, event_id, w AS window_max FROM (SELECT user_id, event_id,
          max(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS w,
          row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM {_E}) WHERE k >= 4""",
    "subarray_sum_k": f"""
        WITH s AS (SELECT user_id, event_id AS t, sum(v) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM {_E}),
             a AS (SELECT user_id, t, s FROM s UNION ALL SELECT DISTINCT user_id, -1, 0 FROM events)
        SELECT s.user_id, count(a.s) AS n_runs FROM s LEFT JOIN a ON a.user_id = s.user_id AND s.s = a.s + 10 AND a.t < s.t GROUP BY 1""",
    "difference_array": """
        WITH m AS (SELECT l_partkey AS p, l_quantity::BIGINT AS d FROM lineitem UNION ALL SELECT l_partkey + l_quantity::BIGINT + 1, -(l_quantity::BIGINT) FROM lineitem),
             c AS (SELECT p, sum(d) AS d FROM m GROUP BY 1)
        SELECT greatest(0, max(t))::BIGINT AS greatest FROM (SELECT sum(d) OVER (ORDER BY p) AS t FROM c)""",
    "longest_unique_run": """
        WITH c AS (SELECT p_partkey, i, p_name[i] AS ch FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS i FROM part)),
             l AS (SELECT p_partkey, i, coalesce(lag(i) OVER (PARTITION BY p_partkey, ch ORDER BY i), 0) AS p FROM c),
             m AS (SELECT p_partkey, i - max(p) OVER (PARTITION BY p_partkey ORDER BY i) AS n FROM l)
        SELECT p_partkey, max(n) AS n FROM m GROUP BY 1""",
    "house_robber": """
        WITH RECURSIVE r AS (SELECT o_custkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, floor(o_totalprice)::BIGINT AS q FROM orders),
             s AS (SELECT o, k, 0::BIGINT AS w, q AS b FROM r WHERE k = 1
                   UNION ALL SELECT s.o, r.k, s.b, greatest(s.b, s.w + r.q) FROM s JOIN r ON r.o = s.o AND r.k = s.k + 1)
        SELECT o AS o_custkey, arg_max(b, k) AS loot FROM s GROUP BY 1""",
    "kth_largest": "SELECT min(o_totalprice) AS kth_largest FROM (SELECT o_totalprice FROM orders ORDER BY 1 DESC LIMIT 25)",
    "topk_per_group": """
        SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
        WHERE rank <= 3""",
    "seen_before": "SELECT count(*) AS n, sum(p_partkey)::BIGINT AS s FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS k FROM part) WHERE k > 1",
    "array_intersection": "SELECT o_custkey AS k FROM orders INTERSECT SELECT l_suppkey FROM lineitem",
    "array_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "number_formulas": """
        WITH RECURSIVE f AS (SELECT 0::BIGINT AS i, 0::BIGINT AS a, 1::BIGINT AS b UNION ALL SELECT i + 1, b, a + b FROM f WHERE i < 60)
        SELECT n, (n * (n + 1) // 2)::BIGINT AS total, n::BIGINT * (n + 1) * (2 * n + 1) // 6 AS squares, f.a AS fibonacci
        FROM (SELECT DISTINCT p_size AS n FROM part WHERE p_size > 0) p JOIN f ON f.i = p.n""",
    "extremes": "SELECT l_returnflag, max(l_extendedprice) AS greatest, min(l_extendedprice) AS least FROM lineitem GROUP BY 1",
}
