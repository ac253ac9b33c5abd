"""p5: the weighted cosine join against all pairs, and the general join with other weights."""

import math
import random
import re

from codeloom.llm import crosssplit as C

SCHEMA = "id long, split_name string, original string, optimized string"


def runs(text):
    words = re.findall(r"\w+", (text or "").lower())
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def test_against_all_pairs(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(["same", "old", "start"] + draw.choices(words, k=draw.randint(1, 40))) for _ in range(60)]
    rows = []
    for i in range(260):
        pick = [draw.choice(texts).split() for _ in range(2)]
        for text in pick:
            for _ in range(draw.randint(0, 2)):
                text[draw.randrange(len(text))] = draw.choice(words)
        rows.append((i, draw.choice(["train", "train", " Train", "test", "validation"]), " ".join(pick[0]), draw.choice([" ".join(pick[1]), None, ""])))
    rows += [(900, None, texts[0], texts[0]), (901, "test", texts[0], "a b c"), (902, "train", "A  b, c", texts[0])]
    train = {r[0]: r[1] and r[1].strip().lower() == "train" for r in rows}
    wanted = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[1] is None or b[1] is None or train[a[0]] == train[b[0]]:
                continue
            for f in (2, 3):
                x, y = runs(a[f]), runs(b[f])
                if x and y and 10 * len(x & y) >= 7 * len(x | y):
                    wanted.add((min(a[0], b[0]), max(a[0], b[0])))
    found = [tuple(r) for r in C.cross_split_pairs(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted and len(wanted) > 50


def test_weighted_join_is_exact(spark):
    draw = random.Random(8)
    vectors = []
    for cid in range(80):
        terms = sorted(draw.sample(range(40), draw.randint(1, 12)))
        vectors.append((0, cid, draw.choice([1, 2, 3]), terms, [draw.choice([0.2, 1.0, 3.5]) for _ in terms]))
    df = spark.createDataFrame(vectors, "field int, cid long, sides int, terms array<long>, weights array<double>")
    found = {(r.x, r.y): r.cosine for r in C.weighted_cosine_pairs(df, C.frequent_terms(df), 0.6).collect()}
    wanted = {}
    for _, x, s, tx, wx in vectors:
        for _, y, t, ty, wy in vectors:
            if x != y and s & 1 and t & 2:
                a, b = dict(zip(tx, wx)), dict(zip(ty, wy))
                dot = sum(a[k] * b[k] for k in a.keys() & b.keys())
                cos = dot / math.sqrt(sum(v * v for v in wx) * sum(v * v for v in wy))
                if cos >= 0.6:
                    wanted[x, y] = cos
    assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 1e-9 for k in wanted)


def test_empty(spark):
    assert C.cross_split_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
