"""p2: the chosen-path join against all pairs, with hot tokens, copies, nulls and forced recursion."""

import random
from types import SimpleNamespace

import pytest

from codeloom.llm import neardup
from codeloom.llm.canon import canonical_json, canonical_text


def runs(text):
    import re

    words = re.findall(r"\w+", text.lower())
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def brute(rows):
    sets = [(k, runs(t), canonical_json(t) or canonical_text(t)) for k, t in rows if t and runs(t)]
    out = set()
    for i, (a, x, cx) in enumerate(sets):
        for b, y, cy in sets[i + 1 :]:
            if a % 16 == b % 16 and cx != cy and 10 * len(x & y) >= 7 * len(x | y):
                out.add((min(a, b), max(a, b)))
    return out


def corpus(seed, hot):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    head = [f"licence{i}" for i in range(30)]
    rows, key = [], 16
    for _ in range(150):
        base = (head if draw.random() < hot else []) + draw.choices(words, k=draw.randint(5, 60))
        for _ in range(draw.choice([1, 1, 2, 3])):
            text = list(base)
            for _ in range(draw.randint(0, 3)):
                text[draw.randrange(len(text))] = draw.choice(words)
            rows.append((key + draw.randint(0, 1), " ".join(text)))
            key += 16
    rows += [(key, None), (key + 16, ""), (key + 32, "two words"), (key + 48, rows[0][1]), (key + 64, rows[0][1].upper())]
    return rows


def expand(pairs, copies):
    members = {}
    for key, cls in copies:
        members.setdefault(cls, [cls]).append(key)
    out = set()
    for a, b in pairs:
        for x in members.get(a, [a]):
            for y in members.get(b, [b]):
                out.add((min(x, y), max(x, y)))
    return out


@pytest.mark.parametrize("limit", [600, 3])
def test_against_all_pairs(spark, limit, monkeypatch):
    monkeypatch.setattr(neardup, "BRUTE_FORCE", limit)  # forces splits and the exact remainder
    rows = corpus(limit, 0.5)
    df = spark.createDataFrame(rows, "key long, text string")
    pairs, copies = neardup.near_duplicates(df)
    found = expand([tuple(r) for r in pairs.collect()], [tuple(r) for r in copies.collect()])
    wanted = brute(rows)
    assert found <= wanted
    assert len(found) >= 0.999 * len(wanted) > 20


def pairs_at_the_threshold(n):
    """Texts 2i and 2i + 1 share 70 of 100 runs, and none with any other text."""
    out = []
    for i in range(n):
        both = " ".join(f"b{i}x{j}" for j in range(72))
        out += [both + " " + " ".join(f"{side}{i}x{j}" for j in range(15)) for side in "pq"]
    return out


def test_recall_of_pairs_whose_tokens_are_all_hot():
    import numpy as np
    import pyarrow as pa

    n = 4000
    keys = pa.array(np.arange(2 * n) * neardup.TABLES)
    texts = pa.RecordBatch.from_arrays([keys, keys, keys, pa.array(pairs_at_the_threshold(n))], names=["key", "c1", "c2", "text"])
    rows = pa.Table.from_batches(neardup._features([texts])).combine_chunks().to_batches()[0]
    nodes = next(neardup._roots(SimpleNamespace(value=None))([rows.select(["key", "n", "mins", *neardup.SKETCH])]))

    def missed():
        node, key = nodes["node"].to_numpy(), nodes["key"].to_numpy()
        seen = np.unique(np.stack([node, key // (2 * neardup.TABLES), key]), axis=1)
        met = (seen[:2, 1:] == seen[:2, :-1]).all(axis=0)
        return n - len(np.unique(seen[1, 1:][met]))

    assert missed() <= 1
    for depth in range(neardup.DEPTH):  # every node is large and is split, none reaches the exact remainder
        own = rows.select(["mins", *neardup.SKETCH]).take(pa.array(nodes["key"].to_numpy() // neardup.TABLES))
        large = [nodes[c] for c in ("node", "at", "key", "n")] + own.columns
        nodes = next(neardup._children(depth)([pa.RecordBatch.from_arrays(large, names=["node", "at", "key", "n", *own.schema.names])]))
        assert missed() <= 1


def test_splits_keep_the_target_recall():
    import numpy as np

    for splits in range(neardup.DEPTH + 1):
        whole = neardup.miss(0.7, splits, neardup.CHILD_SPLITS) + neardup.sketch_miss(0.7, neardup.SKETCH_AGREE, neardup.POSITIONS)
        assert whole <= 1 - neardup.TARGET_RECALL
    runs = np.arange(neardup.ROOT_RUNS) // neardup.RUNS_PER_GROUP
    used = [set(neardup.split_positions(d)[runs == g].ravel()) for d in range(neardup.DEPTH) for g in range(neardup.GROUPS)]
    assert sum(map(len, used)) == len(set().union(*used)) == neardup.CHILD_POSITIONS


def test_scan_joins_rows_across_batches():
    import numpy as np
    import pyarrow as pa

    node = np.repeat([1, 2, 3], [3, 2, neardup.BRUTE_FORCE + 50])
    n = len(node)
    columns = [node, np.zeros(n), np.arange(n), np.zeros(n), np.full(n, 10), np.zeros(n)]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list("abcdef"))
    out = [r for b in neardup._scan(batch.slice(i, 4) for i in range(0, n, 4)) for r in b.to_pylist()]
    assert {(r["a"], r["b"]) for r in out if r["at"] < 0} == {(0, 1), (0, 2), (1, 2), (3, 4)}
    assert {r["a"] for r in out if r["at"] >= 0} == set(range(5, n))


def test_empty(spark):
    pairs, copies = neardup.near_duplicates(spark.createDataFrame([], "key long, text string"))
    assert pairs.count() == 0 and copies.count() == 0


ODD = [
    None, "", " \t", "+-*", "_ _ _", "___", "Two Words", "\x00a\x7fB_9", "İx é", "K k", "á", "²½", "日本 語", "x y", "{'a': 1}", '{"a": "é", "B": [1.0, {"c": null}]}',
    '﻿ {"b": "X y", "a": "\\ud800 z"}\n', '{"a": 1} tail', "{}", '{"a": 1, "a": 2}', "[1]", "{" + '"a":{' * 3000 + "}" * 3001,
]


def test_features_read_each_text_once_in_the_jvm(spark):
    texts = spark.createDataFrame([(16 * i, x) for i, x in enumerate(ODD)], "key long, text string")
    plan = neardup.features(texts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and "EvalPython" not in plan


def test_keys_of_single_texts_are_those_of_the_column(spark):
    from pyspark.sql import functions as F

    from codeloom.llm.canon import canonical_key, key_of, plain_key

    texts = spark.createDataFrame([(x,) for x in ODD], "text string")
    rows = texts.select("text", plain_key(F.col("text")).alias("plain"), canonical_key(F.col("text")).alias("canon")).collect()
    for r in rows:
        assert key_of(r.text, r.plain) == r.canon
        if r.text is not None and r.text.isascii():
            assert key_of(r.text, None) == r.canon


def test_words_by_table_are_those_of_the_pattern():
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from codeloom.llm import leak, shingles

    draw = random.Random(5)
    texts = ODD + ["".join(draw.choices("aB9_ .\n-éİ" if i % 2 else "aB9_ .\n-", k=draw.randint(0, 30))) for i in range(300)]
    for whole in (pa.array(texts, pa.string()), pa.array(ODD[:8]), pa.array([None, ""], pa.string()), pa.array([], pa.string())):
        for array in (whole, whole.slice(1)):
            for pattern in (shingles.NOT_WORD, leak.NOT_WORD):
                words, rows = shingles.split_words(array, pattern)
                lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(array, "")), pattern).to_pylist()
                assert list(zip(rows.tolist(), words.to_pylist(), strict=True)) == [(i, w) for i, ws in enumerate(lists) for w in ws if w]
                assert np.all(np.diff(rows) >= 0)
