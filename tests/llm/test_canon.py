"""p3: canonical keys and the scan over range partitions against plain grouping."""

from collections import defaultdict

import pytest

from codeloom.llm import canon

SCHEMA = "rec int, id long, text string, extra string"


def keyed(spark, rows):
    df = spark.createDataFrame([(r, i, t, "x") for r, i, t in rows], SCHEMA)
    from pyspark.sql import functions as F

    return canon.keyed_records(df, "id", "text").join(df.select("id", "rec"), "id").select("rec", "id", "canon").where(F.col("canon").isNotNull())


def brute(rows):
    groups = defaultdict(list)
    for rec, i, text in rows:
        if text and any(c.isalnum() for c in canon.canonical_text(text)):
            groups[rec, canon.canonical_json(text) or canon.canonical_text(text)].append(i)
    return {(rec, min(g), i) for (rec, _), g in groups.items() for i in g if i != min(g)}


def test_rule():
    same = canon.canonical_text
    assert same("Def F_(x):\n\treturn x + 1") == same("def f(x): return x+1;") != same("def f(x): return x-1")
    assert same("a​b c") == "abc" and same("größe") == "größe"
    a, b = '{"A": {"x": 1.0, "y": "B c"}, "z": [1, 2]}', ' {"Z":[1,2],"a":{"Y":"bC","x":1}}\n'
    assert canon.canonical_json(a) == canon.canonical_json(b)
    assert canon.canonical_json('{"z": [2, 1]}') != canon.canonical_json('{"z": [1, 2]}')
    assert canon.canonical_json("[1]") is None and canon.canonical_json("{broken") is None


def test_hot_key_over_many_partitions(spark):
    rows = [(0, i, "Hot text ; %d" % 7) for i in range(900, 0, -1)]
    rows += [(1, 2000 + i, "hot TEXT 7") for i in range(50)] + [(0, 5000 + i, f"text {i % 40}") for i in range(120)]
    rows += [(0, 6000, None), (0, 6001, ""), (0, 6002, " ;;( "), (0, 6003, "+ -"), (0, 6004, "é" * 50000), (0, 6005, "É " * 50000)]
    rows += [(0, 7000, '{"b":1,"a":"X y"}'), (0, 7001, '{"A": "xy", "B": 1}'), (0, 7002, '{"a": "xy", "b": 2}')]
    found = canon.find_copies(keyed(spark, rows)).collect()
    assert len(found) == len({tuple(r) for r in found})
    assert {tuple(r) for r in found} == brute(rows)


def test_empty(spark):
    assert canon.find_copies(keyed(spark, [])).count() == 0


@pytest.mark.parametrize("text", ["{" * 3000, '{"a":' * 2000 + "1" + "}" * 2000])
def test_deep_json_is_no_crash(text):
    canon.canonical_json(text)
