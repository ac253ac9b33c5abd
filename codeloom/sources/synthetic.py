"""Synthetic example rows made by rule from spark.range and md5, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.sources.catalogue import LOOPS, PAIRS, SIX

LABELS = ("complexity_before", "complexity_after", "explanation", "applied_rules", "category")


def draw(name: str, low: int, high: int) -> Column:
    """A number low..high from the md5 of a name and the row's id."""
    digits = F.substring(F.md5(F.concat(F.lit(name + ":"), F.col("id").cast("string"))), 1, 7)
    return (F.conv(digits, 16, 10).cast("long") % (high - low + 1) + low).cast("long")


SIGNS = ("+", "-", "*", "//", "**", "%")


def folding_examples(spark: SparkSession, n: int) -> DataFrame:
    """n rows of a constant expression over a in 1..20, b in 1..10 and its folded value.

    A power with exponent 10 folds to its base, as the generator that is rebuilt here has it.
    """
    rows = spark.range(n).select("id", draw("a", 1, 20).alias("a"), draw("b", 1, 10).alias("b"), draw("op", 0, 5).alias("op"))
    a, b, op = F.col("a"), F.col("b"), F.col("op")
    power = F.when(b < 10, F.aggregate(F.sequence(F.lit(1), b), F.lit(1).cast("long"), lambda x, _: x * a)).otherwise(a)
    value = F.when(op == 0, a + b).when(op == 1, a - b).when(op == 2, a * b).when(op == 3, F.expr("a div b")).when(op == 4, power).otherwise(a % b)
    term = F.concat_ws(" ", a.cast("string"), F.element_at(F.array(*map(F.lit, SIGNS)), (op + 1).cast("int")), b.cast("string"))
    body = lambda x: F.concat(F.lit("def calculate():\n    x = "), x, F.lit("\n    return x"))
    return rows.select(
        "id",
        body(term).alias("original_code"),
        body(value.cast("string")).alias("optimized_code"),
        F.lit("O(1)").alias("complexity_before"),
        F.lit("O(1)").alias("complexity_after"),
        F.concat(F.lit("Folded constant expression "), term, F.lit(" to "), value.cast("string")).alias("explanation"),
        F.array(F.lit("constant_folding")).alias("applied_rules"),
        F.lit("constant_folding").alias("category"),
    )


def chosen_examples(spark: SparkSession, n: int, templates: list[tuple], name: str) -> DataFrame:
    """n rows, each one of the fixed (original, optimized, before, after, explanation, rule, category) templates.

    The template is drawn by the row's id and looked up in a literal array: no join, no shuffle.
    """
    fields = ("original_code", "optimized_code", *LABELS)
    shown = F.array(*[F.struct(*[(F.array(F.lit(v)) if f == "applied_rules" else F.lit(v)).alias(f) for f, v in zip(fields, t, strict=True)]) for t in templates])
    return spark.range(n).select("id", F.element_at(shown, (draw(name, 1, len(templates))).cast("int")).alias("t")).select("id", "t.*")


def algorithm_examples(spark: SparkSession, n: int) -> DataFrame:
    return chosen_examples(spark, n, PAIRS, "algorithm")


def loop_examples(spark: SparkSession, n: int) -> DataFrame:
    return chosen_examples(spark, n, LOOPS, "loop")


def two_template_examples(spark: SparkSession, n: int) -> DataFrame:
    return chosen_examples(spark, n, PAIRS[:2], "two")


def complexity_examples(spark: SparkSession) -> DataFrame:
    """Six fixed rows, one for each complexity class."""
    names = ["original_code", "optimized_code", "complexity_before", "complexity_after", "explanation", "rule", "category"]
    rows = spark.createDataFrame([(i, *row) for i, row in enumerate(SIX)], ["id", *names])
    return rows.withColumn("applied_rules", F.array("rule")).drop("rule")


def mixture_counts(n: int) -> dict[str, int]:
    """Rows of each kind in a mixed dataset of n: 40, 30 and 20 per cent, and six fixed ones."""
    return {"algorithm": int(0.4 * n), "folding": int(0.3 * n), "loop": int(0.2 * n), "complexity": 6}


def mixed_examples(spark: SparkSession, n: int) -> DataFrame:
    """The mixture in an order of its own: ``place`` is a hash, so that no task has to sort all rows."""
    counts = mixture_counts(n)
    kinds = {
        "algorithm": algorithm_examples(spark, counts["algorithm"]), "folding": folding_examples(spark, counts["folding"]),
        "loop": loop_examples(spark, counts["loop"]), "complexity": complexity_examples(spark),
    }
    out = None
    for kind, rows in kinds.items():
        own = rows.withColumn("kind", F.lit(kind)).withColumn("place", F.md5(F.concat(F.lit(f"{kind}:"), F.col("id").cast("string"))))
        out = own if out is None else out.unionByName(own)
    return out


def test_inputs(spark: SparkSession, kind: str, size: int) -> DataFrame:
    """(case, data, target) inputs for a kind of algorithm: sorting, search or any other."""
    at = lambda name, high: F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.conv(F.substring(F.md5(F.concat(F.lit(f"{name}:"), i.cast("string"))), 1, 7), 16, 10).cast("long") % (high + 1))
    rising = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: i.cast("long"))
    none = F.lit(None).cast("long")
    cases = {
        "sorting": [("random", at("random", 100), none), ("sorted", rising, none), ("reversed", F.transform(F.reverse(rising), lambda x: x + 1), none), ("few", at("few", 5), none)],
        "search": [
            ("present", at("search", 100), F.element_at(at("search", 100), size // 2)), ("absent", at("search", 100), F.lit(-1).cast("long")),
            ("ordered", F.array_sort(at("ordered", 100)), F.element_at(F.array_sort(at("ordered", 100)), size // 2)),
        ],
    }.get(kind, [("random", at("random", 100), none), ("sorted", rising, none)])
    rows = F.array(*[F.struct(F.lit(c).alias("case"), d.alias("data"), t.alias("target")) for c, d, t in cases])
    return spark.range(1).select(F.inline(rows))


def test_graph(spark: SparkSession, size: int) -> DataFrame:
    """(src, dst) edges of a random graph, each of the size * size with a chance of 3 in 10, drawn by its number."""
    edge = spark.range(size * size)
    return edge.where(draw("edge", 0, 9) >= 7).select(F.expr(f"id div {size}").alias("src"), (F.col("id") % size).alias("dst"))
