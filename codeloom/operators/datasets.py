"""Operators on datasets of code pairs: validation, profiles, splits, augmentation, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unite(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def filled(column: Column) -> Column:
    """Neither null nor blank."""
    return F.coalesce(F.length(F.btrim(column, F.lit(" \t\r\n"))) > 0, F.lit(False))


def with_required(df: DataFrame, columns: list[Column]) -> DataFrame:
    """Rows in which every required field is filled."""
    return df.where(reduce(Column.__and__, map(filled, columns)))


def issues(checks: list[tuple[Column, str]]) -> Column:
    """The names of the checks that fail, in order; an unknown outcome fails."""
    return F.concat_ws(",", *[F.when(~F.coalesce(ok, F.lit(False)), name) for ok, name in checks])


def histograms(df: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, n) of several columns in one pass by grouping sets."""
    own = df.select(*[F.coalesce(F.col(c), F.lit("Unknown")).alias(c) for c in columns])
    sets = own.groupingSets([[F.col(c)] for c in columns], *columns).agg(
        F.grouping_id(*columns).alias("gid"), F.count(F.lit(1)).alias("n")
    )
    every = (1 << len(columns)) - 1
    name = F.coalesce(*[F.when(F.col("gid") == (every ^ (1 << (len(columns) - 1 - i))), c) for i, c in enumerate(columns)])
    return sets.select(name.alias("dimension"), F.coalesce(*columns).alias("value"), "n")


def hash_split(df: DataFrame, key: str, shares: dict[str, int]) -> DataFrame:
    """``split`` by the md5 of the key in hundredths: the same on every engine and every run."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 6), 16, 10).cast("long") % 100
    upto, rule = 0, None
    for name, share in shares.items():
        upto += share
        rule = F.when(bucket < upto, name) if rule is None else rule.when(bucket < upto, name)
    return df.withColumn("split", rule)


def stratified_split(df: DataFrame, key: str, label: str, test_share: float) -> DataFrame:
    """``split`` test for the first share of every label's rows by md5 of the key, exact to the row.

    Rows are counted per label and leading byte of the hash with map-side combine; running totals
    over those 256 counts give every row its place but for the byte in which the cut falls. Only the
    rows of that byte, one in 256, are ordered, per label.
    """
    mark = F.md5(F.col(key).cast("string"))
    own = df.withColumn("_mark", mark).withColumn("_byte", F.substring("_mark", 1, 2))
    counts = own.groupBy(label, "_byte").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(label).orderBy("_byte")
    cuts = counts.select(
        label,
        "_byte",
        (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
        (F.sum("_n").over(upto)).alias("_upto"),
        F.sum("_n").over(Window.partitionBy(label)).alias("_all"),
    )
    told = own.join(cuts, [label, "_byte"])  # cuts has at most 256 rows a label
    whole = told.where((F.col("_upto") - 1) / F.col("_all") < test_share).withColumn("split", F.lit("test"))
    none = told.where((F.col("_before") / F.col("_all") >= test_share)).withColumn("split", F.lit("train"))
    edge = told.where(((F.col("_upto") - 1) / F.col("_all") >= test_share) & (F.col("_before") / F.col("_all") < test_share))
    place = (F.row_number().over(Window.partitionBy(label).orderBy("_mark", key)) - 1 + F.col("_before")) / F.col("_all")
    edge = edge.withColumn("split", F.when(place < test_share, "test").otherwise("train"))
    return whole.unionByName(none).unionByName(edge).drop("_mark", "_byte", "_before", "_upto", "_all")


def exact_split(df: DataFrame, key: str, shares: dict[str, float]) -> DataFrame:
    """``split`` with the exact sizes int(share * n), the rest in the last one, by md5 of the key.

    ValueError unless the shares add up to 1 within 1e-6. The cuts are found as in stratified_split.
    """
    if abs(sum(shares.values()) - 1) > 1e-6:
        raise ValueError("shares must add up to 1")
    n = df.count()
    out, left, names = [], df.withColumn("_one", F.lit(1)), list(shares)
    taken = 0
    for name in names[:-1]:
        size, rest = int(shares[name] * n), n - taken
        cut = stratified_split(left, key, "_one", (size - 0.5) / rest if rest and size else 0.0)
        out.append(cut.where("split = 'test'").withColumn("split", F.lit(name)))
        left, taken = cut.where("split = 'train'").drop("split"), taken + size
    out.append(left.withColumn("split", F.lit(names[-1])))
    return unite(out).drop("_one")


def augment(df: DataFrame, code: str, factor: int) -> DataFrame:
    """The rows and ``factor - 1`` variants of each with a numbered comment before the code."""
    copies = df.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    tagged = F.when(F.col("variant") > 0, F.concat(F.lit("# variation "), F.col("variant").cast("string"), F.lit("\n"), F.col(code)))
    return copies.withColumn(code, tagged.otherwise(F.col(code)))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n) over normalized labels."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def weighted_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall and F1 from the confusion counts."""
    cells = confusion(df, truth, predicted)
    rows = cells.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    said = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    both = rows.join(said, "label", "left")
    precision = F.coalesce(F.col("hit") / F.nullif(F.col("said"), F.lit(0)), F.lit(0.0))
    recall = F.col("hit") / F.col("support")
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    total = F.sum("support")
    return both.agg(
        F.round(F.sum("hit") / total, 6).alias("accuracy"),
        F.round(F.sum(precision * F.col("support")) / total, 6).alias("precision"),
        F.round(F.sum(recall * F.col("support")) / total, 6).alias("recall"),
        F.round(F.sum(f1 * F.col("support")) / total, 6).alias("f1"),
    )


def run_stats(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Runs, mean, sample deviation (0 for one run), least and greatest of each group."""
    return df.where(F.col(value).isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.round(F.avg(value), 6).alias("mean"),
        F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("deviation"),
        F.min(value).alias("least"),
        F.max(value).alias("greatest"),
    )


def welch_t(df: DataFrame, flag: Column, value: str) -> DataFrame:
    """One row: Welch's t of the value where the flag holds against where it doesn't."""
    sides = df.where(F.col(value).isNotNull()).agg(
        *[
            f(F.when(side, F.col(value))).alias(f"{name}{i}")
            for i, side in ((1, flag), (2, ~flag))
            for f, name in ((F.avg, "m"), (F.var_samp, "s"), (F.count, "n"))
        ]
    )
    spread = F.sqrt(F.col("s1") / F.col("n1") + F.col("s2") / F.col("n2"))
    return sides.select("n1", "n2", F.round(F.abs(F.col("m1") - F.col("m2")) / spread, 4).alias("t"))


def bucketed_p(t: Column) -> Column:
    """The coarse p value of a t statistic."""
    return F.when(t > 2.0, 0.05).when(t > 1.5, 0.1).when(t.isNotNull(), 0.5).otherwise(1.0)


def improvement(before: Column, after: Column) -> Column:
    """Per cent by which ``after`` is lower; 0 without a positive ``before``."""
    return F.when(before > 0, (before - after) / before * 100).otherwise(0.0)


def deep_equal(a: Column, b: Column, kind: T.DataType, tolerance: float = 1e-9) -> Column:
    """Equal values of a type: floating numbers up to a tolerance, arrays and structs part by part.

    Two nulls are equal, one null is not; arrays of different length are not.
    """
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        same = (a == b) | (F.abs(a - b) < tolerance)
    elif isinstance(kind, T.ArrayType):
        parts = F.zip_with(a, b, lambda x, y: deep_equal(x, y, kind.elementType, tolerance))
        same = (F.size(a) == F.size(b)) & F.forall(parts, lambda x: x)
    elif isinstance(kind, T.StructType):
        same = reduce(Column.__and__, [deep_equal(a[f.name], b[f.name], f.dataType, tolerance) for f in kind.fields], F.lit(True))
    else:
        same = a == b
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(same)


def compare_outputs(original: DataFrame, optimized: DataFrame, keys: list[str], output: str, tolerance: float = 1e-9) -> DataFrame:
    """(keys, equal): outputs of both sides case by case; a case that one side lacks is not equal."""
    kind = original.schema[output].dataType
    a = original.select(*keys, F.col(output).alias("_a"), F.lit(True).alias("_in_a"))
    b = optimized.select(*keys, F.col(output).alias("_b"), F.lit(True).alias("_in_b"))
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    return a.join(b, keys, "full").select(*keys, (both & deep_equal(F.col("_a"), F.col("_b"), kind, tolerance)).alias("equal"))
