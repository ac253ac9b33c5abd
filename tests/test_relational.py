"""Golden cases of the relational algorithms, and brute force where there are none."""

import itertools
import random

import pytest

from codeloom.operators import relational as R


def frame(spark, groups):
    rows = [(g, i, v) for g, values in groups.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "g string, i long, v long")


def column(df, group, value):
    return {r[group]: r[value] for r in df.collect()}


def test_two_sum_first(spark):
    cases = {"a": ([2, 7, 11, 15], 9, (0, 1)), "b": ([3, 2, 4], 6, (1, 2)), "c": ([3, 3], 6, (0, 1)), "d": ([1, 2, 3, 4, 5], 8, (2, 4)), "e": ([1, 2, 2, 3], 4, (1, 2))}
    for name, (values, target, wanted) in cases.items():
        found = R.two_sum_first(frame(spark, {name: values}), "g", "i", "v", target).collect()
        assert [(r.i, r.j) for r in found] == [wanted]


def test_pairs_and_counts(spark):
    values = [random.Random(4).randint(-5, 5) for _ in range(60)] + [None]
    df = frame(spark, {"a": values})
    own = [v for v in values if v is not None]
    for target in (0, 3, 99):
        wanted = [(i, j) for i, j in itertools.combinations(range(len(own)), 2) if own[i] + own[j] == target]
        assert sorted((r.i, r.j) for r in R.pair_join(df, "i", "v", target).collect()) == wanted
        assert R.count_pairs(df, "v", target).first()[0] == len(wanted)
        assert R.pair_exists(df, "v", target).first()[0] == bool(wanted)
    triples = {tuple(sorted(t)) for t in itertools.combinations(own, 3) if sum(t) == 0}
    assert {tuple(r) for r in R.three_sum(df, "v", 0).collect()} == triples
    assert R.greater_pairs(df, "v").first()[0] == sum(a > b for a in own for b in own)
    assert R.pairs_of_equals(df, "v").first()[0] == sum(own.count(v) // 2 for v in set(own))


@pytest.mark.parametrize(("values", "wanted"), [([1, 2, 3, 1], True), ([1, 2, 3, 4], False), ([1, 1, 1, 3, 3, 4, 3, 2, 4, 2], True), ([], False), ([1], False)])
def test_contains_duplicate(spark, values, wanted):
    assert R.contains_duplicate(frame(spark, {"a": values}), "v").first()[0] is wanted


def test_max_subarray(spark):
    groups = {"a": [-2, 1, -3, 4, -1, 2, 1, -5, 4], "b": [1], "c": [5, 4, -1, 7, 8], "d": [-1], "e": [-2, -1]}
    found = column(R.max_subarray(frame(spark, groups), "g", "i", "v"), "g", "max_sum")
    assert found == {"a": 6, "b": 1, "c": 23, "d": -1, "e": -1}


def test_windows_against_brute_force(spark):
    draw = random.Random(9)
    groups = {f"g{k}": [draw.randint(-4, 4) for _ in range(draw.randint(1, 30))] for k in range(8)}
    df = frame(spark, groups)
    every = {g: [v[i:j] for i in range(len(v)) for j in range(i + 1, len(v) + 1)] for g, v in groups.items()}
    inverted = {g: sum(v[i] > v[j] for i in range(len(v)) for j in range(i + 1, len(v))) for g, v in groups.items()}
    assert column(R.inversions(df, "g", "i", "v"), "g", "n_inversions") == inverted
    assert column(R.subarrays_with_sum(df, "g", "i", "v", 2), "g", "n_runs") == {g: sum(sum(r) == 2 for r in runs) for g, runs in every.items()}
    profit = {g: max(v[j] - v[i] for i in range(len(v)) for j in range(i, len(v))) for g, v in groups.items()}
    assert column(R.stock_profit(df, "g", "i", "v"), "g", "profit") == profit
    import math

    assert column(R.max_product(df, "g", "i", "v"), "g", "max_product") == {g: max(math.prod(r) for r in runs) for g, runs in every.items()}
    others = {(g, i): math.prod(v[:i] + v[i + 1 :]) for g, v in groups.items() for i in range(len(v))}
    assert {(r.g, r.i): r.product for r in R.product_except_self(df, "g", "i", "v").collect()} == others

    def loot(v):
        a = b = 0
        for x in v:
            a, b = b, max(b, a + x)
        return b

    assert column(R.house_robber(df, "g", "i", "v"), "g", "loot") == {g: loot(v) for g, v in groups.items()}
    full = {(g, i): max(v[i - 2 : i + 1]) for g, v in groups.items() for i in range(2, len(v))}
    assert {(r.g, r.i): r.window_max for r in R.sliding_max(df, "g", "i", "v", 3).collect()} == full


def test_difference_array_of_negatives_is_zero(spark):
    df = spark.createDataFrame([(1, 3, -5), (2, 4, -1)], "a long, b long, k long")
    assert R.difference_array(df, "a", "b", "k").first()[0] == 0
    more = spark.createDataFrame([(1, 3, 5), (2, 4, 7), (4, 4, 1)], "a long, b long, k long")
    assert R.difference_array(more, "a", "b", "k").first()[0] == 12
    assert R.difference_array(more.limit(0), "a", "b", "k").first()[0] == 0


def test_texts(spark):
    df = spark.createDataFrame([(1, "abcabcbb"), (2, "bbbb"), (3, ""), (4, "über"), (5, None), (6, "pwwkew")], "k long, s string")
    found = {r.k: r.n for r in df.select("k", R.longest_unique_run("s").alias("n")).collect()}
    assert found == {1: 3, 2: 1, 3: 0, 4: 4, 5: None, 6: 3}
    words = spark.createDataFrame([(w,) for w in ("eat", "Tea", "tan", "ate", "nat", "bat", "eat", None)], "w string")
    assert {r.least: r.n for r in R.anagram_groups(words, "w").collect()} == {"ate": 3, "nat": 2, "bat": 1}


def test_single_values(spark):
    df = frame(spark, {"a": [3, 1, 3, 3, 2]})
    assert R.majority(df, "v").first()[0] == 3 and R.majority(frame(spark, {"a": [1, 2]}), "v").first()[0] == -1
    assert R.position_of(df, "i", "v", 3).first()[0] == 0 and R.position_of(df, "i", "v", 9).first()[0] == -1
    assert R.kth_largest(df, "v", 4).first()[0] == 2
    assert sorted(r.v for r in R.missing_numbers(df, "v", 1, 5).collect()) == [4, 5]
    assert sorted(r.i for r in R.repeats(df, "v", "i").collect()) == [2, 3]
