"""Evaluation texts that leak into a corpus (problem 7).

Method: greedy string tiling. Runs of MIN_WORDS words that a text part shares with an item are
the seeds; they are found by joining run hashes with those of the items. For every part and
item joined by a seed, the longest common stretch that overlaps no earlier one is marked again
and again by running Karp-Rabin matching, the search length falling until no stretch of MIN_WORDS
is left. The marked words over the item's words are its coverage, whatever their order.

Words are longest runs of letters and digits, lower-cased. Text parts are read as codeloom.llm
.mime reads them: transfer encoding undone, tags as spaces, text attachments and quoted matter
included; a stretch may not run from one part into another.

The items are a query set against all rows: they are sent to the tasks in blocks of about
BLOCK_WORDS words, as many passes as the items need, so that each broadcast is bounded.

Defined cases: null, empty and short texts and items match nothing; repeated rows each give
their own rows; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.mime import readable, text_parts
from codeloom.llm.shingles import hash_words, mix, split_words
from codeloom.sources.tables import table

MIN_WORDS = 12
#: Share of an item's words from which a part counts as holding the item.
COVERAGE = 0.5
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Words of the items of one pass, on average; 8 bytes each in the broadcast, twice.
BLOCK_WORDS = 500_000
#: Messages worked on at once.
SLICE = 2000

TILES = "doc_id long, item_id long, part int, n_tiles int, longest int, n_covered int, n_words int"


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin (and the end)."""
    words, rows = split_words(pa.array(texts, pa.string()), NOT_WORD)
    begins = np.searchsorted(rows, np.arange(len(texts) + 1))
    return hash_words(words), begins


_BASE = 0x9E3779B97F4A7C15
_WHOLE = 1 << 64


class Rolling:
    """Karp-Rabin hashes of a word sequence: any run's hash in O(1), of any length."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        back = pow(_BASE, -1, _WHOLE)
        self.down = _powers(back, n + 1)
        sums = np.cumsum(mix(words) * _powers(_BASE, n), dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), sums])

    def runs(self, k: int) -> np.ndarray:
        """Hash of the ``k`` words from each position on."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.empty(0, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, _WHOLE))
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        done += more
    return out[:n]


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on; the last of them reach past their text."""
    return Rolling(words).runs(k)


def whole_runs(begins: np.ndarray, k: int) -> np.ndarray:
    """Positions whose run of ``k`` words stays within its text."""
    if not len(begins) or begins[-1] < k:
        return np.empty(0, np.int64)
    at = np.arange(begins[-1] - k + 1)
    ends = begins[1:][np.searchsorted(begins[1:], at, side="right")]
    return at[at + k <= ends]


def _open_runs(hashes: np.ndarray, marked: np.ndarray, k: int) -> np.ndarray:
    """Positions whose ``k`` words are all unmarked; ``marked`` holds running counts."""
    return np.flatnonzero(marked[k:] == marked[: len(hashes)])


def tiles(a: np.ndarray, b: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (start in a, start in b, length), longest first.

    Running Karp-Rabin matching: the search length falls from the longest stretch that is left to
    ``k``. It is found by doubling and halving over rolling hashes, for a stretch of some length
    holds all shorter ones; at each length the matches are marked in order of their places. A pass costs
    time in proportion to both lengths and never lists pairs of places, so one word over and
    over costs no more than any other text.
    """
    roll_a, roll_b = Rolling(a), Rolling(b)
    used_a, used_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    out: list[tuple[int, int, int]] = []
    most = min(len(a), len(b))
    while most >= k:
        count_a, count_b = (np.concatenate([[0], np.cumsum(used)]) for used in (used_a, used_b))

        def common(size: int, count_a=count_a, count_b=count_b) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Places in a and b of the open runs of ``size`` words that stand in both, and their hashes."""
            ha, hb = roll_a.runs(size), roll_b.runs(size)
            at_a, at_b = _open_runs(ha, count_a, size), _open_runs(hb, count_b, size)
            ha, hb = ha[at_a], hb[at_b]
            in_a, in_b = np.isin(ha, hb), np.isin(hb, ha)
            return at_a[in_a], at_b[in_b], ha[in_a], hb[in_b]

        low, high = k - 1, most + 1  # a stretch of low is there, none of high
        size = k
        while high - low > 1:
            if len(common(size)[0]):
                low, size = size, min(2 * size, (size + high + 1) // 2, high - 1)
            else:
                high, size = size, (low + size) // 2
        if low < k:
            break
        most = low
        at_a, at_b, hash_a, hash_b = common(low)
        places: dict[int, list[int]] = defaultdict(list)
        for j, h in zip(at_b[::-1].tolist(), hash_b[::-1].tolist(), strict=True):
            places[h].append(j)
        end = 0
        for i, h in zip(at_a.tolist(), hash_a.tolist(), strict=True):
            own = places[h]
            while own and used_b[own[-1] : own[-1] + low].any():
                own.pop()
            if i < end or not own or not np.array_equal(a[i : i + low], b[own[-1] : own[-1] + low]):
                continue
            j = own.pop()
            used_a[i : i + low] = used_b[j : j + low] = True
            out.append((i, j, low))
            end = i + low
        if not out or out[-1][2] != low:  # equal hashes of different runs
            most = low - 1
    return out


def _tile(block: tuple, k: int):
    """mapInArrow: (doc_id, text) to TILES rows of the items of one block."""
    item_ids, item_words, item_begins, seeds, seed_items = block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                owners, parts, numbers = [], [], []
                for doc, text in zip(ids, texts, strict=True):
                    for number, part in enumerate(text_parts(text) if text else ()):
                        owners.append(doc)
                        numbers.append(number)
                        parts.append(readable(part))
                words, begins = word_hashes(parts)
                at = whole_runs(begins, k)
                runs = run_hashes(words, k)[at] if len(at) else np.empty(0, np.uint64)
                low, high = np.searchsorted(seeds, runs, "left"), np.searchsorted(seeds, runs, "right")
                hit = np.flatnonzero(high > low)
                # Per part and item the first and the last seed; every stretch lies between them.
                reach: dict[tuple[int, int], list[int]] = {}
                part_of = np.searchsorted(begins, at[hit], side="right") - 1
                for h, part in zip(hit.tolist(), part_of.tolist(), strict=True):
                    for item in np.unique(seed_items[low[h] : high[h]]).tolist():
                        reach.setdefault((part, item), [at[h], at[h]])[1] = at[h]
                out = []
                for (part, item), (first, last) in reach.items():
                    own = item_words[item_begins[item] : item_begins[item + 1]]
                    found = tiles(words[first : last + k], own, k)
                    if found:
                        lengths = [n for _, _, n in found]
                        out.append(
                            (owners[part], item_ids[item], numbers[part], len(found), lengths[0], sum(lengths), len(own))
                        )
                columns = list(zip(*out, strict=True)) if out else [[]] * 7
                kinds = [pa.int64()] * 2 + [pa.int32()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    names=["doc_id", "item_id", "part", "n_tiles", "longest", "n_covered", "n_words"],
                )

    return run


def _block(rows: list, k: int) -> tuple:
    """What a pass sends to its tasks: the items' words and their runs, sorted by hash."""
    words, begins = word_hashes([r.text for r in rows])
    at = whole_runs(begins, k)
    runs = run_hashes(words, k)[at] if len(at) else np.empty(0, np.uint64)
    order = np.argsort(runs, kind="stable")
    owner = np.searchsorted(begins, at, side="right") - 1
    return [r.item_id for r in rows], words, begins, runs[order], owner[order].astype(np.int64)


def tile_corpus(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """TILES of every text part and item that share a run of ``min_words`` words.

    ``docs`` has (doc_id, text), ``items`` (item_id, text).
    """
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    n_words = items.select(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first().n or 0
    n_blocks = max(1, -(-n_words // BLOCK_WORDS))
    passes = []
    docs = docs.select("doc_id", "text")
    for number in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == number).collect()
        shared = docs.sparkSession.sparkContext.broadcast(_block(rows, min_words))

        def run(batches, shared=shared):
            return _tile(shared.value, min_words)(batches)

        passes.append(docs.select("doc_id", "text").mapInArrow(run, TILES))
    return reduce(DataFrame.unionByName, passes)


def _tiles(spark: SparkSession, directory: str) -> DataFrame:
    return tile_corpus(table(spark, directory, "documents"), table(spark, directory, "heldout_items"))


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    return _tiles(spark, directory).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, directory: str) -> DataFrame:
    """Per leaked item: messages that hold some of it, the best coverage in one part, and the
    messages with a part that covers COVERAGE of it or more, in whatever order."""
    covered = F.col("n_covered") / F.col("n_words")
    return (
        _tiles(spark, directory)
        .groupBy("item_id")
        .agg(
            F.countDistinct("doc_id").alias("n_docs"),
            F.max("longest").alias("longest"),
            F.round(F.max(covered), 6).alias("coverage"),
            F.countDistinct(F.when(covered >= COVERAGE, F.col("doc_id"))).alias("n_covering"),
        )
    )


QUERIES = {"p7_found": p7_found, "p7_items": p7_items}
ORACLES: dict[str, str] = {}
