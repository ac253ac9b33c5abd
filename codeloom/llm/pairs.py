"""Broken prompt and response pairs (problem 1).

Method: the language posteriors of prompt and response are compared with character n-gram
naive Bayes models, one for natural languages (the explanation ought to be in the prompt's
surrounding language, English) and one for programming languages (the answer ought to be in
the prompt's). Truncation is found by end-of-text n-gram likelihood: over the whole corpus,
how often a text, or a line of code, that ends in a given n-gram of character classes is the
last one; code must also close what it opened. Refusals, stand-ins, copies and remarks for omitted code are told by exact rules.

Every row is judged on whole texts in one pass; the end likelihoods are the only statistics
gathered before, counted over all rows into a table whose size the classes bound.

Types, the first that fits: refusal, empty, copied, other_language, truncated. Defined cases:
a null question can only have answers of the types that need no question; repeated rows are
each judged; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.syntax import parse
from codeloom.llm.seeds import CODE, NATURAL
from codeloom.llm.shingles import mix
from codeloom.sources.tables import table

TYPES = ("refusal", "empty", "copied", "other_language", "truncated")
BUCKETS = 1 << 16
#: Smoothing count of an n-gram, and the odds (in nats) that favour the expected language.
SMOOTHING = 0.05
PRIOR = 6.0
#: A text that ends in an n-gram that ends a text less often than this is truncated.
END_LIKELIHOOD = 0.02
SLICE = 2000


# --- language posteriors ------------------------------------------------------------------


def _ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character 2- and 3-grams of all texts in their order, and their number."""
    padded = [f"  {t} " for t in texts]
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in padded]) - 2
    three = chars[:-2] * np.uint64(0x1F123BB5) + chars[1:-1] * np.uint64(0x9E3779B1) + chars[2:] * np.uint64(0x85EBCA77)
    two = chars[1:-1] * np.uint64(0xC2B2AE3D) + chars[2:] * np.uint64(0x27D4EB2F)
    grams = (mix(np.stack([three, two], axis=1)) & np.uint64(BUCKETS - 1)).astype(np.int64)
    inside = np.ones(len(grams), bool)
    ends = np.cumsum(sizes + 2)
    inside[ends[:-1] - 1] = inside[ends[:-1] - 2] = False
    return grams[inside].ravel(), 2 * sizes


class NaiveBayes:
    """Character n-gram naive Bayes over the seed texts of some languages."""

    def __init__(self, seeds: dict[str, str], prepare) -> None:
        self.names = list(seeds)
        self.prepare = prepare
        grams, sizes = _ngrams([prepare(t) for t in seeds.values()])
        counts = np.zeros((BUCKETS, len(seeds)))
        np.add.at(counts, (grams, np.repeat(np.arange(len(seeds)), sizes)), 1)
        counts += SMOOTHING
        self.log = np.log(counts / counts.sum(axis=0)).astype(np.float32)

    def margin(self, texts: list[str], expected: str) -> np.ndarray:
        """Log odds of the expected language against the best other one, prior included."""
        own = self.names.index(expected)
        out = []
        for start in range(0, len(texts), 200):
            grams, sizes = _ngrams([self.prepare(t) for t in texts[start : start + 200]])
            sums = np.add.reduceat(self.log[grams], np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)
            out.append(sums[:, own] - np.max(np.delete(sums, own, axis=1), axis=1) + PRIOR)
        return np.concatenate(out) if out else np.empty(0)


_IDENTIFIER = re.compile(r"\b[a-zA-Z]+(?:_\w+)+\b|\b[a-z]+[A-Z]\w*\b")
_CODE_TEXT = re.compile(r"#(?!include).*|//.*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'")
_DIGITS = {ord(d): "0" for d in "123456789"}


def _prepare_natural(text: str) -> str:
    """Plain words only: names of code, numbers and formulas say nothing of the language."""
    words = [w.strip(".,;:!?()\"'`-") for w in text.split()]
    return " ".join(w.lower() for w in words if w.replace("'", "").isalpha() and (w[1:].islower() or len(w) == 1))


def _prepare_code(text: str) -> str:
    return _IDENTIFIER.sub("x", _CODE_TEXT.sub("s", text)).translate(_DIGITS)


_MODELS: dict[str, NaiveBayes] = {}


def _model(kind: str) -> NaiveBayes:
    """The model of a kind, trained once per Python worker."""
    if kind not in _MODELS:
        _MODELS[kind] = NaiveBayes(NATURAL, _prepare_natural) if kind == "natural" else NaiveBayes(CODE, _prepare_code)
    return _MODELS[kind]


_FOREIGN_SCRIPT = re.compile(r"[^\W\d_A-Za-zÀ-ɏ]")
_LETTER = re.compile(r"[^\W\d_]")


def foreign_script(text: str) -> bool:
    """Most letters, technical words left out, are of no Latin script."""
    if text.isascii():
        return False
    bare = _IDENTIFIER.sub(" ", text)
    other = len(_FOREIGN_SCRIPT.findall(bare))
    return other > 2 and 2 * other > len(_LETTER.findall(bare))


# --- exact rules --------------------------------------------------------------------------

# How an assistant declines.
_CANNOT = (
    r"(?:can(?:no|')t|can not|could not|(?:am|'m|was) (?:not able|unable) to|(?:will not|won't)(?: be able to)?"
    r"|must (?:decline|refuse)|have to (?:decline|refuse|pass)|decline to|refuse to)"
)
_TASK = r"(?:assist|help|optimi[sz]|rewrit|modif|chang|answer|work on|comply|provid|process|fulfil|complet|this one|request|snippet)"
REFUSAL = re.compile(
    rf"\bI(?: am| 'm|'m)?(?: (?:sorry|afraid),?)?(?: but)?(?: that)?(?: I)? ?{_CANNOT}\b[^.\n]*{_TASK}"
    r"|\bI(?: am|'m) sorry,? but I\b|do(?:n't| not) feel comfortable|not be appropriate for me"
    r"|\bno (?:rewrite|answer|help|change)\b[^.\n]* can be (?:offered|given|provided)|against (?:the|my|our)\b[^.\n]*polic"
    r"|request\b[^.\n]* will not be processed|(?:guidelines|policy|policies|rules) (?:do|does) not (?:allow|permit)"
    r"|outside of what I am (?:permitted|allowed)|\bas an? (?:AI|automated|language)\b[^.\n]*(?:assistant|model)"
    r"|by this assistant",
    re.I,
)
#: Words without which no refusal can match; looked for before the pattern is tried.
_DECLINE_KEYS = tuple(
    "can't cannot unable won't decline refuse sorry comfortable appropriate offered provided polic processed guideline "
    "permitted allowed assistant model".split()
) + ("can not", "could not", "not able", "will not", "have to pass", "be given", "rules do")
# What stands in for content once signs are stripped.
STAND_INS = frozenset(
    "na none null nil empty todo tbd pass nan undefined placeholder noanswer nocontent nocode noexplanation notavailable "
    "notapplicable seeabove asabove raisenotimplementederror python".split()
)
_SIGNS = re.compile(r"[\W_]+")
# Remarks in place of code that was left out.
OMITTED = re.compile(
    r"^\s*(?:(?:#|//|\.\.\.|…)\s*)*(?:\.\.\.|…)|^\s*(?:#|//).*(?:\.\.\.|…)\s*$"
    r"|^\s*(?:#|//)\s*[\[(]?\s*(?:the )?(?:remaining|rest of|other|remainder|output limit|code omitted|omitted|truncated|snip|same as (?:before|above)|unchanged|continue as|as before|etc)\b"
    r"|^\s*(?:#|//).*\b(?:omitted|left out|truncated|rest unchanged|limit reached|and so on)\b",
    re.I | re.M,
)
_FENCE = re.compile(r"^\s*```[\w+-]*\s*$", re.M)
_COMMENT = re.compile(r"(\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|#.*")
_INVISIBLE = dict.fromkeys(map(ord, "\u200b\u200c\u200d\u2060\ufeff"))
_STATEMENT = re.compile(r"^\s*(?:def |class |return\b|import |from \w+ import|for |while |if |assert |@|[\w.\[\]]+(?:, \w+)* [+*/-]?= |print\()")
_HOLLOW = re.compile(r"^(?:pass|\.\.\.|raiseNotImplementedError(?:\(.*\))?|returnNone|return)$")
_DOCSTRING = re.compile(r"^\s*(?:\"\"\".*?\"\"\"|'''.*?''')", re.S)


def code_of(text: str) -> str:
    """Code without a fence and without a line of prose before it."""
    text = _FENCE.sub("", text).strip("\n")
    first, _, rest = text.partition("\n")
    if rest and not _STATEMENT.match(first) and first.rstrip().endswith((".", ":", "!")) and not re.search(r"[=(){}\[\]]", first):
        return rest
    return text


def _bare(text: str) -> str:
    """Without white space and invisible characters."""
    return "".join(text.split()).translate(_INVISIBLE)


def _uncommented(text: str) -> str:
    return _COMMENT.sub(lambda m: m[1] or "", text) if "#" in text else text


def bare_code(text: str) -> str:
    """Code without layout and comments; strings stay as they are but for their spaces."""
    return _bare(_uncommented(code_of(text)))


def is_refusal(text: str | None, code: bool) -> bool:
    """In code only a text without any statement declines; its comments may say anything."""
    if not text:
        return False
    low = text.lower()
    if not any(key in low for key in _DECLINE_KEYS) or not REFUSAL.search(text):
        return False
    return not code or not any(_STATEMENT.match(line) for line in code_of(text).split("\n"))


def is_stand_in(text: str | None, code: bool) -> bool:
    if text is None:
        return True
    bare = _SIGNS.sub("", _FENCE.sub("", text)).lower()
    if not bare or bare in STAND_INS:
        return True
    if not code:
        return False
    lines = [x for x in (_bare(x) for x in _uncommented(code_of(text)).split("\n")) if x]
    body = [x for x in lines if not x.startswith(("def", '"""', "'''", "class", "import", "from"))]
    return len(lines) > 0 and all(map(_HOLLOW.match, body)) and (len(body) > 0 or not lines[-1].startswith("def"))


def _introduced(code: str, text: str) -> bool:
    """``text`` without layout is ``code``, or an introduction of one or two sentences and then ``code``.

    The code begins a line, or stands behind a colon on the line of the introduction.
    """
    if not _bare(text).endswith(code):
        return False
    lines = text.split("\n")
    rest = ""
    for at in range(len(lines) - 1, -1, -1):
        for head, tail in (("", lines[at]), *((lines[at][: m.end()], lines[at][m.end() :]) for m in re.finditer(":", lines[at]))):
            if _bare(tail) + rest == code:
                before = "\n".join([*lines[:at], head]).strip()
                return len(_SENTENCE.split(before)) <= 2
        rest = _bare(lines[at]) + rest
        if len(rest) > len(code):
            return False
    return False


_SENTENCE = re.compile(r"(?<=[.!?:])\s+")


def is_copy(question: str | None, answer: str, explanation: str) -> bool:
    if not question:
        return False
    own = bare_code(question)
    if not own:
        return False
    if bare_code(answer) == own:
        return True
    # An introduction may stand before the code in the explanation, on its line or above it.
    said = _FENCE.sub("", explanation)
    return _introduced(_bare(_FENCE.sub("", question)), said) or _introduced(own, _uncommented(said))


# --- end-of-text likelihood ---------------------------------------------------------------

_KEYWORDS = frozenset(
    "def class return if elif else for while import from assert try except finally with raise print yield break continue pass del global".split()
)


class _Classes(dict):
    """Class of each character: letters a, digits 0, other ASCII itself, the rest a or ?."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "0" if c.isdigit() else "a" if c.isalpha() else c if code < 128 else "?"
        return self[code]


_CLASSES = _Classes()
_WORD = re.compile(r"[A-Za-z_]\w*")


def _shape(text: str) -> str:
    return text.translate(_CLASSES)


def line_gram(line: str, unit: int) -> str:
    """First keyword, depth of indentation and the classes of the last characters of a line."""
    body = line.strip()
    first = _WORD.match(body)
    word = first[0] if first and first[0] in _KEYWORDS else ("x" if first else _shape(body[:1]))
    depth = min(2, -(-(len(line) - len(line.lstrip())) // unit))
    rest = body[len(first[0]) :] if first and first[0] in _KEYWORDS else body
    return f"c|{word}|{depth}|{_shape(rest.strip()[-2:])}"


def code_lines(text: str) -> list[str]:
    """Lines of code that are not blank, without comments that end the text."""
    lines = [x.rstrip() for x in code_of(text).split("\n") if x.strip()]
    while len(lines) > 1 and lines[-1].lstrip().startswith("#"):
        lines.pop()
    return lines


def code_grams(answer: str | None, last: bool = False) -> list[str]:
    """line_gram of every line of an answer, or of the last one only."""
    if not answer or not answer.strip():
        return []
    own = code_lines(answer)
    inner = next((x for x in own if x[:1] in " \t"), "    ")
    unit = max(1, len(inner) - len(inner.lstrip()))
    return [line_gram(x.split("  #")[0], unit) for x in (own[-1:] if last else own)]


def prose_gram(explanation: str) -> str:
    return f"e|{_shape(explanation.rstrip()[-2:])}"


COUNTS = "gram string, ends long, places long"


def _count_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends, places = Counter(), Counter()
        prose = Counter()
        for answer, explanation in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if grams := code_grams(answer):
                places.update(grams)
                ends[grams[-1]] += 1
            if explanation and explanation.strip():
                shape = _shape(explanation.rstrip())
                prose.update(map(add, shape, shape[1:]))
                ends[prose_gram(explanation)] += 1
        places.update({f"e|{gram}": n for gram, n in prose.items()})
        names = list(places)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([ends[g] for g in names], pa.int64()), pa.array([places[g] for g in names], pa.int64())],
            names=["gram", "ends", "places"],
        )


def end_likelihoods(pairs: DataFrame) -> dict[str, float]:
    """P(text ends | n-gram) for every n-gram of the corpus.

    The classes bound the table: about 30 first words, 3 depths and 40 x 40 class pairs.
    """
    found = pairs.select("optimized_code", "explanation").mapInArrow(_count_ends, COUNTS)
    rows = found.groupBy("gram").agg(F.sum("ends").alias("ends"), F.sum("places").alias("places")).collect()
    return {r.gram: r.ends / (r.places + 1) for r in rows}


_TRIPLE = re.compile(r"\"\"\".*?\"\"\"|'''.*?'''", re.S)
_STRING = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|#[^\n]*")


_LEAVES = re.compile(r"\b(?:return|raise|yield)\b|^\s*print\(")


def is_open(code: str) -> bool:
    """A string, a bracket or a block is not closed where the code ends."""
    bare = _STRING.sub("", _TRIPLE.sub("", code)).rstrip()
    if '"' in bare or "'" in bare or bare.endswith((":", "\\", ",")):
        return True
    return any(bare.count(a) > bare.count(b) for a, b in ("()", "[]", "{}"))


def is_truncated(question: str | None, answer: str, explanation: str, likelihood: dict[str, float]) -> bool:
    asked = question or ""
    for found in OMITTED.finditer(answer):
        line = found[0].strip()
        if line not in asked:
            return True
    if any(likelihood.get(g, 0) < END_LIKELIHOOD for g in (*code_grams(answer, True), prose_gram(explanation))):
        return True
    if is_open(code_of(answer)):
        return True
    own = code_lines(answer)
    # A last line that breaks off within a name names something the code never had.
    last = _WORD.findall(own[-1].split("  #")[0]) if own else []
    if len(own) > 1 and last and own[-1].rstrip().endswith(last[-1]):
        before = set(_WORD.findall("\n".join(own[:-1])))
        if last[-1] not in before and last[-1] not in last[:-1] and last[-1] not in ("None", "True", "False"):
            return True
    # A question that ends in a return asks for an answer that does; by any other, it must parse.
    if own and asked.strip() and _LEAVES.search(code_lines(asked)[-1]):
        if not _LEAVES.search(own[-1]):
            return True
    elif own and parse(code_of(answer)) is None:
        return True
    asked_for = re.findall(r"^def (\w+)", asked, re.M)
    return bool(asked_for) and len(re.findall(r"^def ", code_of(answer), re.M)) < len(asked_for)


# --- operator -----------------------------------------------------------------------------


def _judge(likelihood: dict[str, float], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, SLICE):
            batch = whole.slice(start, SLICE)
            ids = batch.column(0).to_pylist()
            rows = list(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True))
            kinds: list[str | None] = [None] * len(ids)
            rest = []
            for i, (question, answer, explanation) in enumerate(rows):
                if is_refusal(explanation, False) or is_refusal(answer, True):
                    kinds[i] = "refusal"
                elif is_stand_in(answer, True) or is_stand_in(explanation, False):
                    kinds[i] = "empty"
                elif is_copy(question, answer, explanation):
                    kinds[i] = "copied"
                else:
                    rest.append(i)
            if rest:
                said = _model("natural").margin([rows[i][2] for i in rest], "en")
                given = _model("code").margin([code_of(rows[i][1]) for i in rest], "python")
                # The question's language is the one that the answer is expected in.
                other = [at for at in range(len(rest)) if given[at] < 0]
                asked = dict(zip(other, _model("code").margin([rows[rest[at]][0] or "" for at in other], "python"), strict=True))
                for at, i in enumerate(rest):
                    question, answer, explanation = rows[i]
                    if said[at] < 0 or foreign_script(explanation) or given[at] < min(0.0, asked.get(at, 0.0)):
                        kinds[i] = "other_language"
                    elif is_truncated(question, answer, explanation, likelihood):
                        kinds[i] = "truncated"
            hit = [i for i, kind in enumerate(kinds) if kind]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in hit], pa.int64()), pa.array([kinds[i] for i in hit], pa.string())],
                names=["result_id", "defect_type"],
            )


def defective_pairs(pairs: DataFrame) -> DataFrame:
    """(result_id, defect_type) of the rows with a defect.

    ``pairs`` has (result_id, original_code, optimized_code, explanation).
    """
    columns = ("result_id", "original_code", "optimized_code", "explanation")
    pairs = pairs.select(*columns)
    shared = pairs.sparkSession.sparkContext.broadcast(end_likelihoods(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _judge(shared.value, batches)

    return pairs.mapInArrow(run, "result_id long, defect_type string")


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return defective_pairs(table(spark, directory, "optimization_result"))


def p1_counts(spark: SparkSession, directory: str) -> DataFrame:
    """Defective rows per type."""
    return p1_found(spark, directory).groupBy("defect_type").agg(F.count(F.lit(1)).alias("n_rows"))


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts}
ORACLES: dict[str, str] = {}
