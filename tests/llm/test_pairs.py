"""p1: each defect, what only looks like one, and the language models."""

import pytest

from codeloom.llm import pairs as P

ASKED = "def f(rows, k=3):\n    out = []\n    for a in rows:\n        for b in rows:\n            if a + b == k:  # pair\n                out.append(a)\n    return out"
FAST = "def f(rows, k=3):\n    seen = set(rows)\n    out = [a for a in rows if k - a in seen]\n    return out"
SAID = "The nested loop over rows was replaced by a lookup in seen, so each element is visited once."
GO = "func f(rows []int) int {\n\ttotal := 0\n\tfor _, v := range rows {\n\t\ttotal += v\n\t}\n\treturn total\n}"

CASES = [
    (ASKED, FAST, SAID, None),
    (ASKED, FAST, "Use a set.", None),
    (ASKED, FAST + "\n# sorry, I can't rename this", "I am sorry for the long name seen; it matches the old one.", None),
    (ASKED, FAST, 'We can\'t drop the check on rows, so it stays. The word "größe" was left alone.', None),
    (ASKED, ASKED.replace("== k", "== k + 1"), SAID, None),
    (None, FAST, SAID, None),
    (ASKED[:60], FAST, SAID, None),
    (ASKED, "# I cannot assist with this request.", "No change was made.", "refusal"),
    (ASKED, FAST, "My guidelines do not allow me to answer this. Try again.", "refusal"),
    (ASKED, "raise NotImplementedError()", "It would not be appropriate for me to rewrite f.", "refusal"),
    (ASKED, None, SAID, "empty"),
    (ASKED, FAST, "​", "empty"),
    (ASKED, "```python\n```", SAID, "empty"),
    (ASKED, "def f(rows, k=3):\n    pass", SAID, "empty"),
    (ASKED, FAST, "(empty)", "empty"),
    (ASKED, "Here is the optimized version:\n\n" + ASKED.replace("  # pair", "") + "\n", SAID, "copied"),
    (ASKED, "```python\n" + ASKED + "\n```", SAID, "copied"),
    (ASKED, FAST, "You asked: " + ASKED, "copied"),
    ("x = y + 1", "x = y+1", SAID, "copied"),
    ("x = y + 1", "x = y + 2", SAID, None),
    (ASKED, FAST, "Here is what you asked for, as it was sent to me by the people of the second floor who keep the old ledger of all the pairs and never throw a single page of it away:\n" + ASKED, "copied"),
    (ASKED, "\n\n".join(f"def f{i}(rows, k=3):\n    pass" for i in range(60)), SAID, "empty"),
    (ASKED, FAST, "As an AI model, I only give general advice.", "refusal"),
    (ASKED, GO, SAID, "other_language"),
    (ASKED, FAST, "Die innere Schleife wurde durch einen Zugriff auf seen ersetzt. Der Aufwand sinkt von O(n²) auf O(n).", "other_language"),
    (ASKED, FAST, "Порядок вывода не меняется.", "other_language"),
    (ASKED, FAST, "每个元素现在只访问一次。", "other_language"),
    (ASKED, FAST[:70], SAID, "truncated"),
    (ASKED, FAST[: FAST.index("    return")].rstrip(), SAID, "truncated"),
    (ASKED, FAST, SAID[:40], "truncated"),
    (ASKED, "def f(rows, k=3):\n    # ... rest unchanged\n    return rows", SAID, "truncated"),
]


def test_defects(spark):
    filler = [(1000 + i, ASKED, FAST.replace("seen", f"seen{i}").replace("out", f"out{i}"), SAID + " Done!") for i in range(300)]
    rows = [(i, *case[:3]) for i, case in enumerate(CASES)]
    df = spark.createDataFrame(rows + filler, "result_id long, original_code string, optimized_code string, explanation string")
    found = {r.result_id: r.defect_type for r in P.defective_pairs(df).collect()}
    assert found == {i: case[3] for i, case in enumerate(CASES) if case[3]}


def test_long_and_empty(spark):
    schema = "result_id long, original_code string, optimized_code string, explanation string"
    long = [(1, ASKED * 300, FAST * 300, SAID * 300), (2, None, None, None)]
    assert {r.result_id for r in P.defective_pairs(spark.createDataFrame(long, schema)).collect()} >= {2}
    assert P.defective_pairs(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("text", ["Memoized.", "A heap suffices here.", SAID, "Note that rows cannot be shared between threads."])
def test_english_stays_english(text):
    assert P._model("natural").margin([text], "en")[0] > 0
