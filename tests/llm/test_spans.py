"""p4: shared spans against a brute-force search, with hot signatures, repeats and odd texts."""

import random

import numpy as np
import pytest

from codeloom.llm import spans


def brute(rows, length):
    owner = {}
    for rec, _, text in rows:
        for i in range(len(text or "") - length + 1):
            owner.setdefault(text[i : i + length], set()).add(rec)
    out = set()
    for rec, field, text in rows:
        marked = [False] * len(text or "")
        for i in range(len(text or "") - length + 1):
            if len(owner[text[i : i + length]]) > 1:
                marked[i : i + length] = [True] * length
        start = None
        for i, m in enumerate([*marked, False]):
            if m and start is None:
                start = i
            if not m and start is not None:
                out.add((rec, field, start + 1, i))
                start = None
    return out


def corpus(seed):
    draw = random.Random(seed)
    text = lambda n: "".join(draw.choices("abcdefgh \n", k=n))
    shared = [text(200) for _ in range(6)]
    head = text(260)
    rows = []
    for rec in range(120):
        for field in range(2):
            body = text(draw.randint(0, 150)) + draw.choice([*shared, ""])[draw.randint(0, 40) :] + text(draw.randint(0, 150))
            rows.append((rec, field, (head if draw.random() < 0.6 else "") + body))
    rows += [(200, 0, rows[5][2]), (201, 0, "z" * 700), (202, 0, "z" * 300), (203, 0, None), (204, 0, ""), (205, 0, "ü🙂" * 150), (206, 1, "x" + "ü🙂" * 100)]
    rows += [(207, 0, shared[0] + "#" + shared[0]), (208, 0, text(400)), (208, 1, None)]
    rows.append((208, 2, rows[-2][2]))
    return rows


@pytest.mark.parametrize("pairwise", [48, 2])
def test_against_brute_force(spark, pairwise, monkeypatch):
    monkeypatch.setattr(spans, "PAIRWISE", pairwise)
    rows = corpus(pairwise)
    df = spark.createDataFrame(rows, "rec long, field int, text string")
    found = [tuple(r) for r in spans.shared_spans(df).collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute(rows, spans.LENGTH)


def test_compact_windows_cover_every_piece():
    draw = np.random.default_rng(3)
    for n, width, high in ((500, 40, 2**60), (300, 20, 3), (200, 30, 1)):
        hashes = draw.integers(0, high, n, dtype=np.uint64)
        for windows in (spans.compact_windows(hashes, width), spans._windows_by_stack(hashes, width)):
            held = {(l, c, r) for l, c, r in windows}
            for p in range(n - width + 1):
                centre = p + int(hashes[p : p + width].argmin())
                assert any(l <= p and p + width - 1 <= r and c == centre for l, c, r in held)


def test_empty(spark):
    assert spans.shared_spans(spark.createDataFrame([], "rec long, field int, text string")).count() == 0


def test_shared_signatures_across_batches():
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(3)
    for _ in range(100):
        n = int(draw.integers(1, 30))
        sign = np.sort(draw.integers(0, 6, n))
        salt = np.where(draw.random(n) < 0.1, 1, 0)
        rec, centre = draw.integers(0, 3, n), np.where(draw.random(n) < 0.1, -1, np.arange(n))
        columns = [pa.array(sign), pa.array(salt, pa.int32()), pa.array(rec), pa.array(np.zeros(n), pa.int32()), pa.array(centre, pa.int32())]
        batch = pa.RecordBatch.from_arrays(columns, names=["sign", "salt", "rec", "field", "centre"])
        size = int(draw.integers(1, 6))
        got = sorted(r["centre"] for b in spans._shared_only(batch.slice(i, size) for i in range(0, n, size)) for r in b.to_pylist())
        shared = {s for s in set(sign.tolist()) if len(set(rec[sign == s].tolist())) > 1}
        assert got == sorted(int(c) for s, t, c in zip(sign, salt, centre) if c >= 0 and (s in shared or t > 0))
