"""p7: text parts of messages, greedy string tiling, and leaked items in awkward encodings."""

import base64
import quopri

import numpy as np

from codeloom.llm import leak, mime

ITEM = "Write a function that merges 59 sorted fiddle lists without holding more than 29518 values at once, please."
HEAD = "From: a@b.example\nSubject: x\nMIME-Version: 1.0\n"


def mail(body, kind="text/plain", encoding=None):
    return f"{HEAD}Content-Type: {kind}; charset=utf-8\n" + (f"Content-Transfer-Encoding: {encoding}\n" if encoding else "") + f"\n{body}"


def cases():
    words = ITEM.split()
    quoted = "\n".join("> " + " ".join(words[i : i + 4]) for i in range(0, len(words), 4))
    html = "<html><style>p{}</style><p>" + ITEM.replace(" ", "&nbsp;").replace("sorted", "<b>sorted</b>") + "</p>"
    multi = f"{HEAD}Content-Type: multipart/mixed; boundary=\"b1\"\n\n--b1\nContent-Type: text/plain\n\nhi\n--b1\nContent-Type: text/csv\nContent-Disposition: attachment\nContent-Transfer-Encoding: base64\n\n"
    split = f"{HEAD}Content-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/plain\n\n{' '.join(words[:8])}\n--b\nContent-Type: text/plain\n\n{' '.join(words[8:])}\n--b--"
    return {
        1: (mail(ITEM.upper()), True),
        2: (mail(quoted), True),
        3: (mail(html, "text/html"), True),
        4: (mail(base64.encodebytes(ITEM.encode()).decode(), encoding="base64"), True),
        5: (mail(quopri.encodestring(("é " + ITEM).encode()).decode(), encoding="Quoted-Printable").replace("\n", "\r\n"), True),
        6: (multi + base64.b64encode(ITEM.encode()).decode(), True),  # no end boundary
        7: (split, False),
        8: (mail(" ".join(words[:11])), False),
        9: (mail(" ".join(words[2:14])), True),
        10: (mail(ITEM.replace("merges", "joins")), True),
        11: (None, False),
        12: ("", False),
        13: (multi.replace("text/csv", "application/pdf") + base64.b64encode(ITEM.encode()).decode(), False),
        14: (ITEM, True),  # no header at all
        15: (mail("word " * 100000 + ITEM), True),
    }


def test_messages(spark):
    rows = [(i, t, 7) for i, (t, _) in cases().items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, ITEM), (2, "too short to match anything"), (3, None), (4, ITEM + " Again, with a longer tail.")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in leak.tile_corpus(docs, items).collect()}
    hits = {i for i, (_, hit) in cases().items() if hit}
    assert {d for d, i in found if i == 1} == hits == {d for d, i in found if i == 4}
    assert not {i for _, i in found} - {1, 4}
    assert leak.tile_corpus(docs, items.limit(0)).count() == 0 == leak.tile_corpus(docs.limit(0), items).count()


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leak, "BLOCK_WORDS", 20)
    docs = spark.createDataFrame([(1, mail(ITEM))], "doc_id long, text string")
    items = spark.createDataFrame([(i, ITEM + f" tail {i}") for i in range(9)], "item_id long, text string")
    assert {r.item_id for r in leak.tile_corpus(docs, items).collect()} == set(range(9))


def test_tiling_marks_longest_first_and_covers_reordered_passages():
    a = np.array([1, 2, 3, 4, 5, 90, 6, 7, 8, 9], np.uint64)
    b = np.array([6, 7, 8, 9, 91, 1, 2, 3, 4, 5], np.uint64)
    assert leak.tiles(a, b, 3) == [(0, 5, 5), (6, 0, 4)]
    assert leak.tiles(np.array([1, 1, 1, 1], np.uint64), np.array([1, 1], np.uint64), 2) == [(0, 0, 2)]


def test_tiling_equals_brute_force():
    def brute(a, b, k):
        used_a, used_b, out = set(), set(), []
        while True:
            best = (0, 0, 0)
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                        n += 1
                    if n > best[2]:
                        best = (i, j, n)
            i, j, n = best
            if n < k:
                return out
            used_a |= set(range(i, i + n))
            used_b |= set(range(j, j + n))
            out.append(best)

    draw = np.random.default_rng(5)
    for _ in range(200):
        a, b = draw.integers(0, 3, draw.integers(0, 24)).astype(np.uint64), draw.integers(0, 3, draw.integers(0, 16)).astype(np.uint64)
        assert leak.tiles(a, b, 2) == brute(a.tolist(), b.tolist(), 2)


def test_one_word_over_and_over_is_no_hot_pair():
    import time

    start = time.perf_counter()
    assert leak.tiles(np.full(100_000, 7, np.uint64), np.full(300, 7, np.uint64), 12) == [(0, 0, 300)]
    assert time.perf_counter() - start < 2


def test_broken_mime():
    assert mime.text_parts("") == [mime.Part("plain", "", False)]
    assert mime.text_parts("Content-Type: multipart/mixed\n\nbody")[0].text == "body"
    assert mime.text_parts(mail("###", encoding="base64"))[0].text == ""
    assert mime.text_parts("Content-Type: text/plain; charset=nope\nContent-Transfer-Encoding: base64\n\naGk=")[0].text == "hi"
