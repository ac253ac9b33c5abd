"""Template residue, filler and error-page text in messages (problem 8).

Method: a regularized linear classifier over hashed word n-grams, hashed word endings, length and
title features of the sentences that a message's own author wrote. It alone decides: a message is
a case if one of its sentences scores THRESHOLD or more.

Its training labels are weak. A sentence with a slot, a response-status line or a phrase of
templates, fillers, error pages and script notices is positive, unless it quotes, shows code or
talks about such things; so is the rest of a paragraph of filler or error text. Sentences of messages
without any such sign are negative. The other sentences of marked messages, and negatives that a
model fitted on the other half of the sample takes for residue, are relabelled by that model or
left out, so that wording no rule knows (filler without its usual opening) is learned.

It is fitted on the TRAIN_DOCS messages of at most TRAIN_CHARS characters with the smallest hashed
ids, a bounded sample, and validated on senders' hosts and on phrases that training never saw; every message is scored.

The author's own text is every inline text part, decoded, without quoted lines, quoted
blocks after an attribution, forwarded originals, signatures and disclaimers.

Defined cases: null, empty and blank texts and messages without a text body are no case;
repeated rows are each judged; extra columns are ignored; with fewer than two classes in the
sample nothing is found; an empty table gives an empty result. Whole bodies are read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.mime import _HIDDEN, _TAG, text_parts
from codeloom.llm.shingles import hash_words, mix, split_words
from codeloom.sources.tables import table

#: Bounds of the training sample, in messages and in characters of each; every message is scored, however long.
TRAIN_DOCS, TRAIN_CHARS = 8000, 20_000
FEATURES = 1 << 18
L2 = 1e-6
EPOCHS = 80
THRESHOLD = 0.7
#: Out-of-fold scores over which a sentence counts as residue, and under which one of a marked message does not.
RELABEL, CLEAN = 0.5, 0.1
#: Weight of each group of features; within a sentence a feature counts 1 / sqrt(their number + SHRINK).
GROUPS, SHRINK = (1.0, 1.0, 0.3), 12
#: One host in so many, at least one, is kept from training and used to validate.
HELD_HOSTS = 5
#: One phrase in so many is kept from training in the second validation.
HELD_PHRASES = 5
SLICE = 2000

# Marks of quoting in archived mail, in the languages of the archive.
_ORIGINAL = re.compile(
    r"^-{3,} ?(?:original message|urspr\S+ nachricht|message d.origine|mensaje original|forwarded message|"
    r"weitergeleitete nachricht|message transf\S+|mensaje reenviado)",
    re.I,
)
_SAID = r"(?:wrote|a écrit|écrit|schrieb|escribió)"
_ATTRIBUTION = re.compile(rf"^(?:On|Le|Am|El)\b.*\b{_SAID}\b.*:\s*$")
_ATTRIBUTION_WRAPPED = re.compile(rf"^(?:On|Le|Am|El)\b[^:]*\d[^\n]*$")
_QUOTED = re.compile(r"^\s{0,3}[>|]")
_INDENTED = re.compile(r"^(?:    |\t)")
_SIGNATURE = re.compile(r"^-- ?$")
_RULE = re.compile(r"^(?:\*{5,}|_{5,})\s*$")
_BREAK = re.compile(r"<br\s*/?>\n?|</(?:p|div|li|tr|h\d|blockquote)\s*>", re.I)
_CITED = re.compile(r"<blockquote\b.*?(?:</blockquote\s*>|\Z)", re.I | re.S)

# Ways to write a slot that a mail merge should have filled.
_NAME = r"[A-Za-zÀ-ÿ][\wÀ-ÿ .-]{0,40}"
PLACEHOLDER = re.compile(
    rf"\{{\{{\s*{_NAME}\}}\}}|[$#]\{{\s*{_NAME}\}}|%%{_NAME}%%|%\(\w+\)s|<%=?\s*{_NAME}%>|\*\|\s*{_NAME}\|\*"
    rf"|@@{_NAME}@@|<<\s*{_NAME}>>|\[\[\s*{_NAME}\]\]|«\s*{_NAME}»|(?<!\w)__[A-Z][A-Z0-9_]*?__(?!\w)"
    rf"|\[(?:INSERT|ENTER|ADD|YOUR|YOUR_)\b[^\]\n]{{0,60}}\]|(?<![\w\])'\"])\[{_NAME}\](?![\w(\[])"
    r"|(?<![\w{$#%'\"])\{[A-Za-z]\w*\}(?!\})|(?<![\w%])%[A-Z][A-Z_]+%(?![\w%])"
)

_SLOT_SIGN = re.compile(r"[{}%<\[«@|]|__")
_DIGITS = {ord(d): "0" for d in "123456789"}

# Phrases of fillers, error pages and script notices (en, de, fr, es); they only make training labels.
PHRASE_LIST = (
    r"lorem ipsum", r"dummy (?:text|content)", r"(?:placeholder|filler) (?:text|paragraph)", r"sample text, replace",
    r"text goes here", r"copy to be supplied", r"catchy headline", r"introduction here", r"will follow here", r"blindtext",
    r"platzhalter", r"überschrift einfügen", r"hier steht", r"texte de remplissage", r"votre texte ici", r"titre accrocheur",
    r"à compléter", r"texto de relleno", r"escriba aquí", r"inserte un título", r"párrafo de ejemplo",
    r"\b[45]\d\d (?:not found|bad gateway|forbidden|unauthorized|bad request|gone|internal|service|gateway|server)",
    r"(?:error|fehler|erreur|http)[ :]+[45]\d\d\b", r"internal server error", r"page you (?:asked|requested|are looking)",
    r"access denied", r"temporarily unavailable", r"down for maintenance", r"session has expired", r"too many requests",
    r"unhandled exception", r"database connection", r"upstream server", r"document has moved", r"went wrong", r"\boops\b",
    r"seite wurde nicht gefunden", r"interner serverfehler", r"zugriff verweigert", r"nicht erreichbar", r"page demandée",
    r"erreur interne", r"accès refusé", r"momentanément indisponible", r"no se encontró la página", r"error interno",
    r"acceso denegado", r"no disponible por",
    r"(?:enable|allow|activate|turn on|aktivieren sie|activer|active|habilite) javascript",
    r"scripts are (?:blocked|disabled|turned off)", r"scripting is (?:turned off|disabled)",
    r"(?:needs|requires) (?:scripts|javascript)", r"not run scripts", r"benötigt (?:skripte|javascript)",
    r"besoin de (?:scripts|javascript)", r"necesita (?:scripts|javascript)", r"switch them on", r"schalten sie sie ein",
)
PHRASES = re.compile("|".join(PHRASE_LIST), re.I)
# Signs that a sentence talks about such text; they only make training labels.
TALK = re.compile(
    r"\b(?:my patch|our docs|mail merge|the template|rendered mails?|designer|mockup|handler|customers|tell us|build page|reload\s+fixed"
    r"|we dropped|hint about|real copy|showed|shows|is replaced|fills it in|writes a line|they see|log\b|screenshot|ticket says)\b",
    re.I,
)
_SPOKEN = re.compile(r"`[^`]*`|\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«\s[^»]*\s»|(?<!\w)'[^'\n]{4,}'(?!\w)")
_END = re.compile(r"(?<=[.!?])\s+")
_CODE_LINE = re.compile(
    r"^\s*(?:def |class |return\b|for .+:|if .+:|elif |else:|while .+:|import |from \w+ import|assert |print\(|@\w+$|#|\"\"\"|[\w.\[\]]+(?:, [\w.]+)* [+*/-]?= )"
)


#: Words without which no phrase can match; looked for before the pattern is tried.
_KEYS = tuple(
    "lorem dummy placeholder filler sample goes supplied headline introduction follow blindtext platzhalter einfügen steht "
    "remplissage votre accrocheur compléter relleno escriba título ejemplo error fehler erreur http server page denied "
    "unavailable maintenance expired requests exception database moved wrong oops seite zugriff erreichbar demandée "
    "interne refusé indisponible página interno denegado disponible script skript switch schalten found gateway forbidden "
    "unauthorized bad gone internal service".split()
)
_REPEATED = re.compile(r"\b(\w+)(?: \1){3}\b", re.I)


class Sentence(NamedTuple):
    text: str
    code: bool
    block: int


def _plain_lines(kind: str, text: str) -> list[str]:
    if kind == "html":
        text = _CITED.sub("\n", _HIDDEN.sub(" ", text))
        text = html.unescape(_TAG.sub("", _BREAK.sub("\n", text)))
    return text.replace("\xa0", " ").split("\n")


def own_lines(text: str) -> list[str]:
    """Lines of the inline text parts that the message's author wrote."""
    out: list[str] = []
    for part in text_parts(text):
        if not part.attached and part.kind in ("plain", "html"):
            out += [*_own(_plain_lines(part.kind, part.text)), ""]
    return out


def _own(lines: list[str]) -> list[str]:
    out: list[str] = []
    mode = "own"
    for at, line in enumerate(lines):
        if _ORIGINAL.match(line.strip()):
            break
        if _ATTRIBUTION.match(line):
            mode = "quote"
            continue
        if _ATTRIBUTION_WRAPPED.match(line) and at + 1 < len(lines) and _ATTRIBUTION.match(f"{line} {lines[at + 1]}"):
            mode = "wrapped"
            continue
        if mode == "wrapped":
            mode = "quote"
            continue
        if mode == "quote":
            if not line.strip() or _QUOTED.match(line) or _INDENTED.match(line):
                continue
            mode = "own"
        if _QUOTED.match(line):
            continue
        if _SIGNATURE.match(line) or _RULE.match(line):
            mode = "tail"
        if mode == "own":
            out.append(line)
    return out


def sentences(text: str) -> list[Sentence]:
    """Sentences of the author's own blocks of lines, each as one line of text and once a message."""
    found: dict[str, Sentence] = {}
    number, block = 0, []
    for line in [*own_lines(text), ""]:
        if line.strip():
            block.append(line)
        elif block:
            code = sum(bool(_CODE_LINE.match(x)) for x in block)
            is_code = code * 3 >= len(block) and code > 1
            whole = " ".join(" ".join(block).split())
            # What is quoted goes first, for a quotation may hold several sentences.
            for x in [whole] if is_code else _END.split(_SPOKEN.sub(" zzspoken ", whole)):
                found.setdefault(x, Sentence(x, is_code, number))
            number, block = number + 1, []
    return list(found.values())


# --- weak labels --------------------------------------------------------------------------

SLOT, PHRASE = 1, 2


def evidence(sentence: Sentence, phrases: re.Pattern = PHRASES) -> int:
    """PHRASE, SLOT or 0: a sign of residue outside quotation marks, backticks, code and talk."""
    if sentence.code:
        return 0
    said = sentence.text
    low = said.lower()
    if any(key in low for key in _KEYS) and phrases.search(said) or _REPEATED.search(said):
        kind = PHRASE
    elif _SLOT_SIGN.search(said) and PLACEHOLDER.search(said):
        kind = SLOT
    else:
        return 0
    return 0 if TALK.search(said) else kind


def weak_labels(found: list[Sentence], phrases: re.Pattern = PHRASES) -> list[int]:
    """1, 0 or -1 (unknown) of the sentences of one message."""
    signs = [evidence(x, phrases) for x in found]
    marked = {x.block for x, sign in zip(found, signs, strict=True) if sign == PHRASE}
    rest = -1 if any(signs) else 0
    return [1 if sign or x.block in marked else rest for x, sign in zip(found, signs, strict=True)]


# --- classifier ---------------------------------------------------------------------------


class Features(NamedTuple):
    """Sparse rows: feature number, row and value of every entry."""

    feature: np.ndarray
    row: np.ndarray
    value: np.ndarray
    n: int

    def of(self, keep: np.ndarray) -> Features:
        """The rows that ``keep`` marks, numbered anew."""
        use = keep[self.row]
        return Features(self.feature[use], (np.cumsum(keep) - 1)[self.row[use]], self.value[use], int(keep.sum()))


def _runs(hashes: np.ndarray, rows: np.ndarray, k: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """A number and the row of every run of ``k`` words within a row."""
    n = max(0, len(hashes) - k + 1)
    runs = hashes[:n].copy()
    for j in range(1, k):
        runs = mix(runs) + hashes[j : n + j]
    same = rows[:n] == rows[k - 1 :][:n]
    return mix(runs + np.uint64(salt))[same], rows[:n][same]


def features(found: list[Sentence], titles: list[str], sizes: list[int]) -> Features:
    """Of every sentence: word 1- to 3-grams, 1- and 2-grams of word endings, length, title words
    and the number of sentences of its message."""
    texts = [f"zzcode {t}" if code else PLACEHOLDER.sub(" zzslot ", t) if _SLOT_SIGN.search(t) else t for t, code, _ in found]
    marked = [t.translate(_DIGITS) for t in texts]
    words, rows = split_words(pa.array(marked, pa.string()))
    hashes, ends = hash_words(words), hash_words(pc.utf8_slice_codeunits(words, -3))
    title_words, title_rows = split_words(pa.array([t.translate(_DIGITS) for t in titles], pa.string()))
    every = np.arange(len(texts))
    length = np.floor(2 * np.log2(np.array([len(t) for t in texts], np.float64) + 1)).astype(np.uint64)
    number = np.minimum(np.array(sizes, np.uint64), np.uint64(8))
    groups = (
        [_runs(hashes, rows, k, k) for k in (1, 2, 3)],
        [_runs(ends, rows, k, 30 + k) for k in (1, 2)],
        [(mix(hash_words(title_words) + np.uint64(77)), title_rows), (mix(length + np.uint64(991)), every), (mix(number + np.uint64(5001)), every)],
    )
    out: tuple[list, list, list] = ([], [], [])
    for group, weight in zip(groups, GROUPS, strict=True):
        row = np.concatenate([r for _, r in group])
        counts = np.bincount(row, minlength=len(texts))
        out[0].append(np.concatenate([f for f, _ in group]) & np.uint64(FEATURES - 1))
        out[1].append(row)
        out[2].append((weight / np.sqrt(counts + SHRINK))[row])
    return Features(np.concatenate(out[0]).astype(np.int64), np.concatenate(out[1]).astype(np.int64), np.concatenate(out[2]), len(texts))


def scores(weights: np.ndarray, x: Features) -> np.ndarray:
    """Probability of each row."""
    sums = np.bincount(x.row, weights[x.feature] * x.value, x.n) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(sums, -30, 30)))


def fit(x: Features, labels: np.ndarray) -> np.ndarray:
    """Weights of an L2-regularized logistic regression with balanced classes, by full-batch Adam."""
    weights = np.zeros(FEATURES + 1)
    if not x.n or labels.min() == labels.max():
        weights[-1] = -30
        return weights
    share = labels.mean()
    cost = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)) / x.n
    used, feature = np.unique(x.feature, return_inverse=True)
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    own = np.zeros(len(used) + 1)
    for step in range(1, EPOCHS + 1):
        z = np.bincount(x.row, own[feature] * x.value, x.n) + own[-1]
        error = cost * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        slope = np.append(np.bincount(feature, error[x.row] * x.value, len(used)), error.sum())
        slope[:-1] += L2 * own[:-1]
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        own -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights[used], weights[-1] = own[:-1], own[-1]
    return weights


class Sample(NamedTuple):
    """Labelled sentences: features, weak labels, message numbers, ``held`` those of validation hosts."""

    x: Features
    labels: np.ndarray
    message: np.ndarray
    held: np.ndarray
    found: list[Sentence]


def _host(sender: str | None) -> str:
    found = re.search(r"@([\w.-]+)", sender or "")
    return found[1].lower() if found else ""


def weak_sample(docs: DataFrame, phrases: re.Pattern = PHRASES) -> Sample:
    """Weakly labelled sentences of the sample."""
    n_docs = docs.count()
    # The share of hashes that holds about a quarter more than the bound; no task sorts them all.
    limit = min(2**63 - 1, (2**64 * 5 * TRAIN_DOCS) // (4 * max(n_docs, 1)) - 2**63)
    rank = F.xxhash64("doc_id")
    sample = docs.where((rank <= limit) & (F.length(F.trim("text")) > 0) & (F.length("text") <= TRAIN_CHARS))
    rows = sample.select("doc_id", "text", "subject", "from_addr", rank.alias("rank")).toArrow().to_pylist()
    rows = sorted(rows, key=lambda r: (r["rank"], r["doc_id"] or 0))[:TRAIN_DOCS]
    hosts = sorted({_host(row["from_addr"]) for row in rows}, key=xxhash.xxh3_64_intdigest)
    kept_out = set(hosts[: -(-len(hosts) // HELD_HOSTS)]) if len(hosts) > 1 else set()
    found, titles, sizes, labels, message, held = [], [], [], [], [], []
    for number, row in enumerate(rows):
        own = sentences(row["text"])
        found += own
        labels += weak_labels(own, phrases)
        titles += [row["subject"] or ""] * len(own)
        sizes += [len(own)] * len(own)
        message += [number] * len(own)
        held += [_host(row["from_addr"]) in kept_out] * len(own)
    x = features(found, titles, sizes)
    return Sample(x, np.array(labels, np.int64), np.array(message, np.int64), np.array(held, bool), found)


def _fit_on(sample: Sample, labels: np.ndarray, rows: np.ndarray) -> np.ndarray:
    keep = rows & (labels >= 0)
    return fit(sample.x.of(keep), labels[keep].astype(np.float64))


def train(sample: Sample, rows: np.ndarray | None = None) -> np.ndarray:
    """Weights fitted on ``rows`` (all but the held ones) after one relabelling by out-of-fold scores."""
    rows = ~sample.held if rows is None else rows
    second = sample.message % 2 == 1
    told = np.zeros(sample.x.n)
    for fold in (second, ~second):
        told[~fold] = scores(_fit_on(sample, sample.labels, rows & fold), sample.x)[~fold]
    labels = sample.labels.copy()
    unknown = labels < 0
    labels[unknown & (told > RELABEL)] = 1
    labels[unknown & (told < CLEAN)] = 0
    labels[(sample.labels == 0) & (told > RELABEL)] = -1
    return _fit_on(sample, labels, rows)


def _judge(weights: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, SLICE):
            batch = whole.slice(start, SLICE)
            ids = batch.column(0).to_pylist()
            owners, found, titles, sizes = [], [], [], []
            for at, (text, title) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                own = sentences(text) if text else ()
                owners += [at] * len(own)
                found += own
                titles += [title or ""] * len(own)
                sizes += [len(own)] * len(own)
            if not found:
                continue
            best = np.zeros(len(ids))
            np.maximum.at(best, np.array(owners), scores(weights, features(found, titles, sizes)))
            hit = np.flatnonzero(best >= THRESHOLD)
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in hit], pa.int64()), pa.array(best[hit])], names=["doc_id", "score"])


def residue(docs: DataFrame) -> DataFrame:
    """(doc_id, score) of the messages whose own body holds residue."""
    shared = docs.sparkSession.sparkContext.broadcast(train(weak_sample(docs)).astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _judge(shared.value.astype(np.float64), batches)

    return docs.select("doc_id", "text", "subject").mapInArrow(run, "doc_id long, score double")


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    return residue(table(spark, directory, "documents")).select("doc_id")


def p8_clean(spark: SparkSession, directory: str) -> DataFrame:
    """Ids and sizes of the messages that stay when the cases are left out."""
    docs = table(spark, directory, "documents")
    return docs.select("doc_id", "n_chars").join(residue(docs), "doc_id", "left_anti")


def _agreement(kind: str, true: np.ndarray, told: np.ndarray) -> tuple[str, int, int, int, int]:
    said = told >= THRESHOLD
    return kind, len(true), int(true.sum()), int((said & true).sum()), int((said & ~true).sum())


def p8_validation(spark: SparkSession, directory: str) -> DataFrame:
    """Recall and false ones on sentences of hosts, and on wording, that training never saw.

    ``host``: weakly labelled sentences of the held-out hosts. ``phrase``: labels are made without one
    phrase in HELD_PHRASES; the sentences that only those phrases mark are then looked for.
    """
    docs = table(spark, directory, "documents")
    sample = weak_sample(docs)
    rows = []
    if sample.held.any():
        seen = sample.held & (sample.labels >= 0)
        rows.append(_agreement("host", sample.labels[seen] > 0, scores(train(sample), sample.x)[seen]))
    if sample.x.n:
        used = re.compile("|".join(x for i, x in enumerate(PHRASE_LIST) if i % HELD_PHRASES), re.I)
        told = [evidence(x, used) for x in sample.found]
        new = np.array([not t and evidence(x) == PHRASE for t, x in zip(told, sample.found, strict=True)], bool)
        # Messages with a sentence of the kept phrases train nothing.
        marked = np.isin(sample.message, sample.message[new])
        seen = new | (marked & (sample.labels == 0))
        rows.append(_agreement("phrase", new[seen], scores(train(sample, ~marked), sample.x)[seen]))
    return spark.createDataFrame(rows, "kind string, n_sentences long, n_residue long, n_recalled long, n_false long")


QUERIES = {"p8_found": p8_found, "p8_clean": p8_clean, "p8_validation": p8_validation}
ORACLES: dict[str, str] = {}
