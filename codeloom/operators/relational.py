"""Nested-loop algorithms as relational operators: equi joins, aggregates and windows.

Every operator takes a DataFrame and the columns it works on. Pair operators aggregate by
value before they join, so their cost follows the number of different values and not of rows;
where the answer itself is a list of row pairs, the join condition isolates one side
(``b.v = target - a.v``), which Spark plans as a hash or sort-merge join.

Nulls in the value column take part in no pair; an empty input gives an empty result, or the
neutral value where the operator returns one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.plans.durable import persist_table


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """(v, n): different values and their rows; partial aggregation takes hot values."""
    return df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))


def pair_join(df: DataFrame, key: str, value: str, target: int) -> DataFrame:
    """(i, j, v_i, v_j), i < j, of integral values that add up to ``target``.

    Joined on the value isolated on one side. Integral types only: with doubles
    ``b = t - a`` and ``a + b = t`` may round differently.
    """
    a = df.select(F.col(key).alias("i"), F.col(value).alias("v_i"))
    b = df.select(F.col(key).alias("j"), F.col(value).alias("v_j"))
    return a.join(b, (F.col("v_j") == F.lit(target) - F.col("v_i")) & (F.col("i") < F.col("j")))


def count_pairs(df: DataFrame, value: str, target: int) -> DataFrame:
    """One row: unordered row pairs that add up to ``target``, from value counts alone."""
    counts = value_counts(df, value)
    a = counts.select(F.col("v").alias("x"), F.col("n").alias("n_x"))
    b = counts.select(F.col("v").alias("y"), F.col("n").alias("n_y"))
    both = a.join(b, (F.col("y") == F.lit(target) - F.col("x")) & (F.col("x") <= F.col("y")))
    number = F.when(F.col("x") == F.col("y"), F.expr("n_x * (n_x - 1) div 2")).otherwise(F.col("n_x") * F.col("n_y"))
    return both.agg(F.coalesce(F.sum(number), F.lit(0)).cast("long").alias("n_pairs"))


def pair_exists(df: DataFrame, value: str, target: int) -> DataFrame:
    return count_pairs(df, value, target).select((F.col("n_pairs") > 0).alias("pair_exists"))


def two_sum_first(df: DataFrame, group: str, position: str, value: str, target: int) -> DataFrame:
    """Per group the pair a single hash pass meets first: least j, then the latest i before it."""
    a = df.select(F.col(group).alias("_g"), F.col(position).alias("_i"), F.col(value).alias("_v"))
    b = df.select(F.col(group).alias("_h"), F.col(position).alias("_j"), F.col(value).alias("_w"))
    on = (F.col("_h") == F.col("_g")) & (F.col("_w") == F.lit(target) - F.col("_v")) & (F.col("_i") < F.col("_j"))
    first = F.min(F.struct(F.col("_j"), (-F.col("_i")).alias("_minus")))
    pairs = a.join(b, on).groupBy("_g").agg(first.alias("_p"))
    return pairs.select(F.col("_g").alias(group), (-F.col("_p._minus")).alias("i"), F.col("_p._j").alias("j"))


def three_sum(df: DataFrame, value: str, target: int, buckets: int = 64) -> DataFrame:
    """Different triplets x <= y <= z of rows that add up to ``target``.

    Values fall into ``buckets`` ranges of equal width. Which triples of ranges can reach the target
    is worked out over the ranges alone, and both joins are then equi-joins on ranges and values, so
    no nested loop over all pairs of values is planned. An answer may hold every pair of values.
    """
    counts = value_counts(df, value)
    low, high = counts.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return counts.select(F.col("v").alias("x"), F.col("v").alias("y"), F.col("v").alias("z")).limit(0)
    width = (high - low) // buckets + 1
    # Per range of x the ranges of y that some z completes: at most buckets ** 2 literal entries.
    fits = {
        i: [j for j in range(i, buckets) if any(low * 3 + (i + j + k) * width <= target <= low * 3 + (i + j + k + 3) * width - 3 for k in range(j, buckets))]
        for i in range(buckets)
    }
    table = F.array(*[F.array(*map(F.lit, fits[i])).cast("array<int>") for i in range(buckets)])
    bucket = ((F.col("v") - low) / width).cast("int")
    a = counts.select(F.col("v").alias("x"), F.col("n").alias("n_x"), F.explode(F.get(table, bucket)).alias("j"))
    b = counts.select(F.col("v").alias("y"), F.col("n").alias("n_y"), bucket.alias("j"))
    c = counts.select(F.col("v").alias("z"), F.col("n").alias("n_z"))
    pairs = a.join(b, "j").where(F.col("x") <= F.col("y"))
    found = pairs.join(c, F.col("z") == F.lit(target) - F.col("x") - F.col("y")).where(F.col("y") <= F.col("z"))
    enough = (
        ((F.col("x") < F.col("y")) | (F.col("n_x") > 1))
        & ((F.col("y") < F.col("z")) | (F.col("n_y") > 1))
        & ((F.col("x") < F.col("z")) | (F.col("n_x") > 2))
    )
    return found.where(enough).select("x", "y", "z")


def duplicates(df: DataFrame, value: str) -> DataFrame:
    return value_counts(df, value).where("n > 1")


def contains_duplicate(df: DataFrame, value: str) -> DataFrame:
    return value_counts(df, value).agg(F.coalesce(F.max("n") > 1, F.lit(False)).alias("contains_duplicate"))


def missing_numbers(df: DataFrame, value: str, low: int, high: int) -> DataFrame:
    """Numbers of low..high that no row has."""
    numbers = df.sparkSession.range(low, high + 1).toDF("v")
    return numbers.join(df.select(F.col(value).cast("long").alias("v")).distinct(), "v", "left_anti")


def inversions(df: DataFrame, group: str, position: str, value: str) -> DataFrame:
    """Per group the pairs i < j with a greater value at i, in n log n rows and without pairs.

    Rows are ranked by value (equal ones by position). A pair is inverted exactly if, at the
    highest bit in which its ranks differ, the earlier row has the 1; so per bit, among rows
    that agree on the higher bits, the ones before each zero are summed up.
    """
    ranked = df.where(F.col(value).isNotNull()).select(
        F.col(group).alias("g"),
        F.col(position).alias("i"),
        (F.row_number().over(Window.partitionBy(group).orderBy(value, position)) - 1).alias("r"),
    )
    longest = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    bits = max(1, int(longest - 1).bit_length())
    each = ranked.select("g", "i", "r", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("b"))
    each = each.select("g", "i", "b", F.expr("shiftright(r, b + 1)").alias("high"), F.expr("shiftright(r, b) & 1").alias("bit"))
    before = Window.partitionBy("g", "b", "high").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    ones = each.withColumn("ones", F.coalesce(F.sum("bit").over(before), F.lit(0)))
    total = F.sum(F.when(F.col("bit") == 0, F.col("ones")).otherwise(0)).cast("long")
    return ones.groupBy(F.col("g").alias(group)).agg(total.alias("n_inversions"))


def running_sum(df: DataFrame, order: str, amount: str) -> DataFrame:
    """``df`` with ``upto``, the sum of ``amount`` up to each row by a unique ``order``.

    Range partitions are summed first; one offset per partition then makes local sums global,
    so that no task sees all rows.
    """
    parts = persist_table(
        df.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "running"
    )
    sums = parts.groupBy("part").agg(F.sum(amount).alias("all"))
    offsets = sums.select(
        "part", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    local = F.sum(amount).over(Window.partitionBy("part").orderBy(order))
    return parts.withColumn("local", local).join(F.broadcast(offsets), "part").withColumn("upto", F.col("before") + F.col("local")).drop("part", "local", "before")


def greater_pairs(df: DataFrame, value: str) -> DataFrame:
    """One row: ordered row pairs with a greater first value, by a running sum over values."""
    counts = running_sum(value_counts(df, value), "v", "n")
    total = F.sum(F.col("n") * (F.col("upto") - F.col("n")))
    return counts.agg(F.coalesce(total, F.lit(0)).cast("long").alias("n_pairs"))


def position_of(df: DataFrame, position: str, value: str, target: int) -> DataFrame:
    """One row: the first position that holds ``target``, -1 if there is none."""
    hit = F.min(F.when(F.col(value) == target, F.col(position)))
    return df.agg(F.coalesce(hit, F.lit(-1)).cast("long").alias("position"))


def pairs_of_equals(df: DataFrame, value: str) -> DataFrame:
    """One row: disjoint pairs of equal values."""
    return value_counts(df, value).agg(F.coalesce(F.sum(F.expr("n div 2")), F.lit(0)).cast("long").alias("n_pairs"))


def majority(df: DataFrame, value: str) -> DataFrame:
    """One row: the value of more than half the rows, else -1; verified, not just voted."""
    counts = value_counts(df, value)
    return counts.agg(F.max_by("v", "n").alias("v"), F.max("n").alias("most"), F.sum("n").alias("total")).select(
        F.when(F.col("most") * 2 > F.col("total"), F.col("v")).otherwise(-1).cast("long").alias("majority")
    )


def sorted_letters(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(text, "")), "")


def anagram_groups(df: DataFrame, text: str) -> DataFrame:
    """(letters, n, least): groups of different texts with the same letters."""
    words = df.where(F.col(text).isNotNull()).select(F.lower(text).alias("w")).distinct()
    return words.groupBy(sorted_letters(F.col("w")).alias("letters")).agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("least"))


def _ordered(group: str, position: str) -> Window:
    return Window.partitionBy(group).orderBy(position)


def max_subarray(df: DataFrame, group: str, position: str, value: str) -> DataFrame:
    """Per group the greatest sum of a run of rows (at least one)."""
    upto = _ordered(group, position).rowsBetween(Window.unboundedPreceding, 0)
    before = _ordered(group, position).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.where(F.col(value).isNotNull()).withColumn("s", F.sum(value).over(upto))
    best = F.col("s") - F.least(F.lit(0), F.coalesce(F.min("s").over(before), F.lit(0)))
    return sums.withColumn("best", best).groupBy(group).agg(F.max("best").alias("max_sum"))


def max_product(df: DataFrame, group: str, position: str, value: str) -> DataFrame:
    """Per group the greatest product of a run of rows; the fold keeps greatest and least."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(position, value))), lambda e: e[value].cast("double"))
    start = F.struct(F.lit(1.0).alias("hi"), F.lit(1.0).alias("lo"), F.lit(None).cast("double").alias("best"))

    def step(state: Column, v: Column) -> Column:
        hi = F.greatest(v, state["hi"] * v, state["lo"] * v)
        lo = F.least(v, state["hi"] * v, state["lo"] * v)
        return F.struct(hi.alias("hi"), lo.alias("lo"), F.greatest(hi, F.coalesce(state["best"], hi)).alias("best"))

    folded = F.aggregate(rows, start, step, lambda state: F.when(state["best"] == 0, 0.0).otherwise(state["best"]))  # no negative zero
    return df.where(F.col(value).isNotNull()).groupBy(group).agg(folded.alias("max_product"))


def stock_profit(df: DataFrame, group: str, position: str, value: str) -> DataFrame:
    """Per group the greatest rise from an earlier row, 0 at least."""
    upto = _ordered(group, position).rowsBetween(Window.unboundedPreceding, 0)
    rise = df.withColumn("rise", F.col(value) - F.min(value).over(upto))
    return rise.groupBy(group).agg(F.max("rise").alias("profit"))


def sliding_max(df: DataFrame, group: str, position: str, value: str, width: int) -> DataFrame:
    """The greatest value of every full window of ``width`` rows."""
    order = _ordered(group, position)
    rows = df.select(
        group,
        position,
        F.max(value).over(order.rowsBetween(1 - width, 0)).alias("window_max"),
        F.row_number().over(order).alias("rn"),
    )
    return rows.where(F.col("rn") >= width).drop("rn")


def subarrays_with_sum(df: DataFrame, group: str, position: str, value: str, target: int) -> DataFrame:
    """Per group the runs of rows that add up to ``target``, by counts of prefix sums."""
    upto = _ordered(group, position).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.select(F.col(group).alias("_g"), F.col(position).alias("_at"), F.sum(value).over(upto).alias("_s"))
    kinds = {name: sums.schema[name].dataType for name in ("_at", "_s")}
    zero = sums.select("_g").distinct().select("_g", F.lit(None).cast(kinds["_at"]).alias("_at"), F.lit(0).cast(kinds["_s"]).alias("_s"))
    a = sums.unionByName(zero).select(F.col("_g").alias("_h"), F.col("_at").alias("_from"), F.col("_s").alias("_r"))
    on = (F.col("_h") == F.col("_g")) & (F.col("_s") == F.col("_r") + target) & (F.col("_from").isNull() | (F.col("_from") < F.col("_at")))
    return sums.join(a, on, "left").groupBy("_g").agg(F.count("_h").alias("n_runs")).select(F.col("_g").alias(group), "n_runs")


def difference_array(updates: DataFrame, first: str, last: str, amount: str) -> DataFrame:
    """One row: the greatest total after all range additions, 0 at least."""
    marks = updates.select(F.col(first).alias("p"), F.col(amount).alias("d")).unionAll(
        updates.select((F.col(last) + 1).alias("p"), (-F.col(amount)).alias("d"))
    )
    changes = marks.groupBy("p").agg(F.sum("d").alias("d"))
    running = running_sum(changes, "p", "d")
    return running.agg(F.greatest(F.lit(0), F.coalesce(F.max("upto"), F.lit(0))).cast("long").alias("greatest"))


def longest_unique_run(text: str) -> Column:
    """Length of the longest substring of column ``text`` without a repeated character.

    One fold: a repeated character cuts the run behind its earlier place.
    """
    return F.expr(
        f"aggregate(split({text}, ''), struct('' AS run, 0 AS best), (st, c) -> struct("
        "concat(substr(st.run, locate(c, st.run) + 1), c) AS run, "
        "greatest(st.best, length(st.run) - locate(c, st.run) + 1) AS best), st -> st.best)"
    )


def house_robber(df: DataFrame, group: str, position: str, value: str) -> DataFrame:
    """Per group the greatest sum of rows of which no two are neighbours."""
    rows = f"transform(array_sort(collect_list(struct({position}, {value}))), e -> cast(e.{value} AS bigint))"
    fold = F.expr(
        f"aggregate({rows}, struct(0L AS without, 0L AS best), (st, v) -> struct("
        "st.best AS without, greatest(st.best, st.without + v) AS best), st -> st.best)"
    )
    return df.where(F.col(value).isNotNull()).groupBy(group).agg(fold.alias("loot"))


def product_except_self(df: DataFrame, group: str, position: str, value: str) -> DataFrame:
    """Each row's product of all other rows of its group; zeros are counted, not divided by."""
    own = Window.partitionBy(group)
    v = F.col(value).cast("double")
    zeros = F.count_if(v == 0).over(own)
    rest = F.product(F.when(v != 0, v)).over(own)
    out = F.when(zeros > 1, 0.0).when(zeros == 1, F.when(v == 0, F.coalesce(rest, F.lit(1.0))).otherwise(0.0)).otherwise(rest / v)
    return df.select(group, position, out.alias("product"))


def kth_largest(df: DataFrame, value: str, k: int) -> DataFrame:
    """One row: the k-th largest value, equal values counted; a top-k, no full sort."""
    top = df.where(F.col(value).isNotNull()).select(value).orderBy(F.desc(value)).limit(k)
    return top.agg(F.min(value).alias("kth_largest"))


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their rank; planned with a window group limit."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def repeats(df: DataFrame, value: str, position: str) -> DataFrame:
    """Rows whose value stood at an earlier position; positions are unique.

    The first positions come from a map-side aggregate, so a value of very many rows is in no one window.
    """
    first = df.groupBy(F.col(value).alias("_v")).agg(F.min(position).alias("_first"))
    return df.join(first, df[value].eqNullSafe(F.col("_v"))).where(F.col(position) > F.col("_first")).drop("_v", "_first")


def pairs_used_once(df: DataFrame, value: str, target: int) -> DataFrame:
    """One row: pairs that add up to ``target`` when every row is used at most once."""
    counts = value_counts(df, value)
    a = counts.select(F.col("v").alias("x"), F.col("n").alias("n_x"))
    b = counts.select(F.col("v").alias("y"), F.col("n").alias("n_y"))
    both = a.join(b, (F.col("y") == F.lit(target) - F.col("x")) & (F.col("x") <= F.col("y")))
    number = F.when(F.col("x") == F.col("y"), F.expr("n_x div 2")).otherwise(F.least("n_x", "n_y"))
    return both.agg(F.coalesce(F.sum(number), F.lit(0)).cast("long").alias("n_pairs"))


def position_in(values: Column, target: Column) -> Column:
    """Index of the first element that equals ``target``, -1 if there is none."""
    return F.coalesce(F.array_position(values, target) - 1, F.lit(-1)).cast("long")


def is_anagram(a: Column, b: Column) -> Column:
    return sorted_letters(F.lower(a)) == sorted_letters(F.lower(b))


def top_by_size(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The k rows of the greatest absolute value, ties to the smaller key."""
    return df.select(key, value).where(F.col(value).isNotNull()).orderBy(F.desc(F.abs(value)), key).limit(k)


def longest_common(a: str, b: str) -> Column:
    """Length of the longest common subsequence of two text columns: one row of the table folded over ``a``."""
    return F.expr(
        f"aggregate(split({a}, ''), transform(sequence(0, length({b})), x -> 0), (row, c) -> aggregate(sequence(1, length({b})), array(0), "
        f"(new, j) -> concat(new, array(IF(substr({b}, j, 1) = c, row[j - 1] + 1, greatest(row[j], element_at(new, -1)))))), row -> element_at(row, -1))"
    )


def knapsack(weights: Column, values: Column, capacity: int) -> Column:
    """The greatest value of items, each used once, whose weights fit: one row of the table folded over the items."""
    start = F.transform(F.sequence(F.lit(0), F.lit(capacity)), lambda _: F.lit(0).cast("long"))

    def step(row: Column, item: Column) -> Column:
        return F.transform(row, lambda best, at: F.when(at >= item["w"], F.greatest(best, F.get(row, (at - item["w"]).cast("int")) + item["v"])).otherwise(best))

    items = F.zip_with(weights, values, lambda w, v: F.struct(w.cast("long").alias("w"), v.cast("long").alias("v")))
    return F.aggregate(items, start, step, lambda row: F.element_at(row, -1))
