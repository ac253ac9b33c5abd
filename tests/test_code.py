"""Syntax features, risks and rewrites on hand-counted snippets; text features agree with Python."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.functions import rewrite, syntax, text

NESTED = "def two(nums, target):\n    for i in range(len(nums)):\n        for j in range(i + 1, len(nums)):\n            if nums[i] + nums[j] == target:\n                return [i, j]\n    return []"


def test_features():
    own = syntax.numbers(syntax.parse(NESTED))
    wanted = {"loop_depth": 2, "n_loops": 2, "n_functions": 1, "n_ifs": 1, "n_returns": 2, "return_in_loop": 1, "equality": 1, "range_loops": 2, "most_inner_loops": 1, "names_target": 1}
    assert {k: own[k] for k in wanted} == wanted
    fib = syntax.numbers(syntax.parse("def f(n):\n    return n if n < 2 else f(n - 1) + f(n - 2)"))
    assert fib["n_recursive_calls"] == 2 and fib["loop_depth"] == 0
    side = syntax.numbers(syntax.parse("for a in x: pass\nfor b in x: pass"))
    assert side["n_loops"] == 2 and side["loop_depth"] == 1


def test_risks_and_functions():
    found = {(r["severity"], r["what"]) for r in syntax.risks("import os\nfrom subprocess import run\neval('1')\nx.__globals__")}
    assert found == {("high", "import os"), ("high", "import subprocess"), ("critical", "call eval"), ("high", "attribute __globals__")}
    assert syntax.risks("def f(:")[0]["what"] == "syntax error" and syntax.risks(None) == []
    assert syntax.defined_functions(syntax.parse(NESTED)) == [{"name": "two", "n_args": 2, "first_line": 1, "last_line": 6, "has_return": True}]


@pytest.mark.parametrize(
    ("code", "wanted", "rule"),
    [
        ("x = 5 + 3", "x = 8", "constant_folding"),
        ("z = 100 / 4", "z = 25.0", "constant_folding"),
        ("x = 2 ** 1000000", "x = 2 ** 1000000", None),
        ("x = 1 / 0", "x = 1 / 0", None),
        ("if 1 > 2:\n    a()\nelse:\n    b()", "b()", "dead_branch"),
        ("def f():\n    return 1\n    print(2)", "def f():\n    return 1", "unreachable_code"),
        ("def f(a):\n    unused = 3\n    return a", "def f(a):\n    return a", "unused_variable"),
        ("def f(a):\n    kept = a()\n    return 1", "def f(a):\n    kept = a()\n    return 1", None),
        ("r = []\nfor x in y:\n    if x:\n        r.append(x)", "r = [x for x in y if x]", "list_comprehension"),
        ("x = a and True and b", "x = a and b", "boolean_simplification"),
        ("def f(:", "def f(:", None),
    ],
)
def test_rewrites(code, wanted, rule):
    done, rules = rewrite.rewrite(code)
    assert done == wanted and (rule in rules if rule else rules == [])


@pytest.mark.parametrize(
    ("code", "wanted"),
    [
        ("def f(x):\n    for i in range(len(x)):\n        print(x[i])", "def f(x):\n    for value_i in x:\n        print(value_i)"),
        ("def f(x):\n    for i in range(len(x)):\n        print(i, x[i])", "def f(x):\n    for i, value_i in enumerate(x):\n        print(i, value_i)"),
        ("def f(x):\n    for i in range(len(x)):\n        print(x[i])\n    return i", "def f(x):\n    for i, value_i in enumerate(x):\n        print(value_i)\n    return i"),
        ("def f(x, y):\n    for i in range(len(x)):\n        print(x[i])\n    for i in range(len(y)):\n        print(y[i])", "def f(x, y):\n    for value_i in x:\n        print(value_i)\n    for value_i_ in y:\n        print(value_i_)"),
        ("r = []\nfor i in range(len(x)):\n    r.append(x[i])", "r = [value_i for value_i in x]"),
        (NESTED, NESTED.replace("for i in range(len(nums))", "for i, value_i in enumerate(nums)").replace("nums[i]", "value_i")),
    ],
)
def test_direct_loops(code, wanted):
    done, rules = rewrite.rewrite(code)
    assert done == wanted and "direct_loop" in rules


@pytest.mark.parametrize(
    "body",
    ["x[i] = x[i] + 1", "x[i] += 1", "del x[i]", "x.append(x[i])", "g(x, x[i])", "i = x[i]", "x = x[i]", "y = [x[i] for i in z]", "h = lambda: x[i]", "print(i)", "yield x[i]", "locals()[x[i]]"],
)
def test_loops_that_stay(body):
    code = f"def f(x, z):\n    for i in range(len(x)):\n        {body}\n    return (x, y, h)"
    assert rewrite.rewrite(code) == (code, [])
    assert rewrite.rewrite("def len(x):\n    return 1\nfor i in range(len(x)):\n    print(x[i])")[1] == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 50), st.sampled_from(["+", "-", "*", "//", "%"])), min_size=1, max_size=6))
def test_folding_keeps_the_value(parts):
    code = "x = 7" + "".join(f" {op} ({n})" for n, op in parts)
    before, after = {}, {}
    try:
        exec(code, before)  # noqa: S102 - arithmetic made above
    except ZeroDivisionError:
        return
    exec(rewrite.rewrite(code)[0], after)  # noqa: S102
    assert before["x"] == after["x"]


def test_text_features(spark):
    codes = [NESTED, "", "for for\nwhile x:\n\n", "été = sum(x)\n", None, "a" * 100000]
    df = spark.createDataFrame(list(enumerate(codes)), "id long, code string")
    from pyspark.sql import functions as F

    cols = [c.alias(n) for n, c in text.features10(F.col("code")).items()]
    found = {r.id: r for r in df.select("id", *cols, text.word_count(F.col("code"), "for|while").alias("loops"), text.loop_depth_by_indent(F.col("code")).alias("depth")).collect()}
    for i, code in enumerate(codes):
        if code is None:
            assert found[i].n_for is None
            continue
        assert found[i].n_lines == len(code.split("\n")) and found[i].n_for == code.count("for") and found[i].n_len == code.count("len")
        assert found[i].loops == len(re.findall(r"(?a)\b(for|while)\b", code))
    assert found[0].depth == 3 and found[1].depth == 0


def test_per_snippet_rows(spark):
    df = spark.createDataFrame([(1, NESTED), (2, NESTED), (3, None), (4, "def (")], "id long, code string")
    assert {r.id: r.valid for r in syntax.features(df, "id", "code").collect()} == {1: True, 2: True, 3: False, 4: False}
    assert syntax.functions(df, "id", "code").count() == 2
    assert rewrite.rewrites(df.limit(0), "id", "code").count() == 0


def test_generated_code_runs_as_said(spark):
    from pyspark.sql import functions as F

    from codeloom.functions import generate

    rows = [(n, "def work(values: list, goal=3):\n    pass") for n in generate.TEMPLATES] + [("other", "x = 1"), ("hash_set", "no header")]
    df = spark.createDataFrame(rows, "t string, code string").select("t", generate.generated(F.col("code"), F.col("t")).alias("made"))
    made = [(r.t, r.made) for r in df.collect()]
    assert made[-2] == ("other", "x = 1") and made[-1][1].startswith("def main(items, target):\n    seen = set()\n    for value in items:")
    said = {"hash_map": [1, 2], "hash_set": True, "dynamic_programming": 6, "two_pointers": [(1, 2), (1, 2)], "sliding_window": 2, "frequency_map": {1: 2, 2: 2}}
    for technique, code in made[:-2]:
        names = {}
        exec(code, names)  # noqa: S102 - our own templates
        values = [1, 1, 2, 2]
        assert names["work"](values, 3) == said[technique], technique
