"""p8: whose words count, what is evidence, and the classifier on hosts it never saw."""

import random

import numpy as np

from codeloom.llm import residue as R

HEAD = "From: a@{host}\nSubject: note\nContent-Type: text/plain\n\n"
BAD = [
    "Dear {{ first_name }},\n\nyour order %%ORDER%% is ready.", "Lorem ipsum velbaa norloum norfenis.", "404 Not Found\nThe page you asked for is not available",
    "Please enable JavaScript to view this message", "Hola [INSERT NOMBRE HERE]:\n\nGracias por confiar en *|EMPRESA|*.", "Placeholder paragraph number 4. Your text goes here.",
    "Bitte aktivieren Sie JavaScript, um diese Nachricht anzuzeigen.", "Error 503\nServicio no disponible por el momento", "Dear <<NAME>>,\n\nthank you.",
]
GOOD = [
    'The build page showed "404 Not Found" twice on Monday, but a reload fixed it.', "For the mail merge please write {{name}} where the name belongs; the script fills it in.",
    "The designer used lorem ipsum text in the mockup; I will send the real copy.", "> Dear {{ first_name }},\n> your order is ready.\n\nThanks, I will look at it on Friday.",
    "On Monday, A B wrote:\n> 500 Internal Server Error\n\nLet us talk about it tomorrow.", "def total(rows):\n    text = '{name}'.format(name=1)\n    x = rows[0]\n    return rows[x]",
    "Let us meet at 404 past ten.", "Hello,\n\nthe report is fine again.\n-- \nA B\n{{ signature }}", "",
    'Customers tell us they see "This page needs scripts to work. Switch them on and reload" with an old browser.',
]


def test_evidence():
    for body in BAD:
        assert any(map(R.evidence, R.sentences(HEAD + body))), body
    for body in GOOD:
        assert not any(map(R.evidence, R.sentences(HEAD + body))), body


def messages():
    """(doc_id, text, subject, from_addr, case); some fillers hold no phrase that any label knows."""
    draw = random.Random(2)
    plain = ["Let us talk about the report.", "I will be out on Friday.", "Thanks for the hint about the table.", "We found rows without a key."]
    latin = lambda: " ".join(draw.choice("mar vel dor sil nor tal".split()) + draw.choice("ibum enus oris atit".split()) for _ in range(6)).capitalize() + "."
    for i in range(600):
        kind = i % 6
        body = {0: draw.choice(BAD), 1: f"Lorem ipsum {latin()} {latin()} {latin()}"}.get(kind) or draw.choice(GOOD[:3] + plain)
        if i % 60 == 7:
            body = f"{latin()} {latin()} {latin()}"  # no label rule marks it
        yield i, HEAD.format(host=f"h{i % 11}.example") + body + ("\n\n" + draw.choice(plain) if kind != 1 else ""), "note", f"a@h{i % 11}.example", kind < 2


def test_classifier_decides(spark):
    rows = list(messages())
    rows += [(900, None, None, None, False), (901, "", None, None, False), (902, "   ", "x", "y", False), (903, HEAD + " ".join(f"We found {k} rows without a key." for k in range(30000)) + "\n\nDear {{ first_name }},\n\nyour order %%ORDER%% is ready.", "note", None, True)]
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, subject string, from_addr string")
    found = {r.doc_id for r in R.residue(docs).collect()}
    assert found == {r[0] for r in rows if r[4]}
    unmarked = [r for r in rows if r[0] % 60 == 7 and r[0] < 600]
    assert unmarked and not any(R.evidence(x) for r in unmarked for x in R.sentences(r[1]))
    sample = R.weak_sample(docs)
    assert 0 < sample.held.mean() < 0.5
    seen = sample.held & (sample.labels >= 0)
    said = R.scores(R.train(sample), sample.x)[seen] >= R.THRESHOLD
    assert (said == (sample.labels[seen] > 0)).mean() > 0.95


def test_own_text():
    two = "Content-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/plain\n\nSee below.\n--b\nContent-Type: text/html\n\n<p>Dear {{ name }},</p>\n--b\nContent-Type: text/plain\nContent-Disposition: attachment\n\n{{ other }}\n--b--"
    assert [x.text for x in R.sentences(two)] == ["See below.", "Dear {{ name }},"]
    assert "404 Not Found" in R.own_lines(HEAD + "Server message\n=====\n404 Not Found")
    assert R.own_lines(HEAD + "Hello\n*****\nThis mail is meant for one reader.") == ["Hello", ""]


def test_one_class_and_empty(spark):
    docs = spark.createDataFrame([(1, HEAD + "Hello there.", "s", "a@b")], "doc_id long, text string, subject string, from_addr string")
    assert R.residue(docs).count() == 0 and R.residue(docs.limit(0)).count() == 0
    assert np.isfinite(R.fit(R.features([], [], []), np.empty(0))).all()


def test_every_phrase_holds_a_key():
    import itertools
    import re

    def parts(pattern):
        depth, out = 0, [""]
        for c in pattern:
            depth += (c == "(") - (c == ")")
            if c == "|" and not depth:
                out.append("")
            else:
                out[-1] += c
        return out

    plain = R.PHRASES.pattern.replace(r"\b", "").replace("[45]", "4").replace(r"\d", "9").replace("[ :]+", " ")
    phrases = []
    for part in parts(plain):
        pieces = re.split(r"\(\?:([^()]*)\)", part)
        choices = [piece.split("|") if at % 2 else [piece] for at, piece in enumerate(pieces)]
        phrases += ["".join(choice) for choice in itertools.product(*choices)]
    assert "switch them on" in phrases and "499 gone" in phrases
    assert all(R.PHRASES.search(phrase) for phrase in phrases)
    assert [p for p in phrases if not any(key in p.lower() for key in R._KEYS)] == []
