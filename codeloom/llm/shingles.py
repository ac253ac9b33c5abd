"""Sets of runs of consecutive words, as hashed numbers, for whole Arrow batches.

A word is a longest run of letters, digits and underscores, lower-cased. A run of ``k`` words
becomes a 52-bit number; two different runs of a compared pair get the same number with a
probability of about 2e-16. Null and short texts have an empty set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

NOT_WORD = r"[^\p{L}\p{N}_]+"

#: Rows worked on at once: 4,096 leave 52 bits of a 64-bit sort key for the run.
SLICE = 4096
_ROW_BITS = 12
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


@cache
def _word_bytes(not_word: str) -> np.ndarray:
    """Which ASCII characters the pattern leaves in words."""
    inside = np.zeros(256, bool)
    inside[:128] = ~pc.match_substring_regex(pa.array(map(chr, range(128))), not_word).to_numpy(zero_copy_only=False)
    return inside


def _ascii_words(texts: pa.Array, not_word: str) -> tuple[pa.Array, np.ndarray]:
    """split_words of ASCII texts without nulls, whose characters are told by a table."""
    if not len(texts):
        return pa.array([], pa.string()), np.empty(0, np.int64)
    texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    chars = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    inside = _word_bytes(not_word)[chars]
    opens = np.zeros(len(chars) + 1, bool)
    opens[bounds] = True
    breaks = ~inside
    first, last = inside.copy(), inside.copy()
    first[1:] &= breaks[:-1] | opens[1:-1]
    last[:-1] &= breaks[1:] | opens[1:-1]
    at = np.flatnonzero(first)
    ends = np.cumsum(np.flatnonzero(last) + 1 - at)
    begins = np.concatenate([[0], ends]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(begins), pa.py_buffer(_LOWER[chars[inside]]))
    return words, np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(at, bounds)))


def split_words(texts: pa.Array, not_word: str = NOT_WORD) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, one after the other, and each word's row."""
    texts = pc.fill_null(texts, "")
    plain = pc.string_is_ascii(texts).to_numpy(zero_copy_only=False)
    if plain.all():
        return _ascii_words(texts, not_word)
    found = _ascii_words(texts.filter(pa.array(plain)), not_word), _regex_words(texts.filter(pa.array(~plain)), not_word)
    rows = np.concatenate([np.flatnonzero(plain)[found[0][1]], np.flatnonzero(~plain)[found[1][1]]])
    order = np.argsort(rows, kind="stable")
    return pa.concat_arrays([words.cast(pa.string()) for words, _ in found]).take(pa.array(order)), rows[order]


def _regex_words(texts: pa.Array, not_word: str) -> tuple[pa.Array, np.ndarray]:
    """split_words of any texts without nulls."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), not_word)
    words = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(texts)), counts)
    keep = pc.not_equal(words, "")
    return words.filter(keep), rows[keep.to_numpy(zero_copy_only=False)]


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit number for each word; every distinct word is hashed once."""
    coded = words.dictionary_encode()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(coded.dictionary))
    return known[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.uint64)


def run_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The different ``k``-word runs of at most SLICE texts: (runs, number of runs of each row).

    The runs of a row are sorted.
    """
    words, rows = split_words(texts)
    hashes = hash_words(words)
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    runs = hashes[:n].copy()
    for j in range(1, k):
        runs = mix(runs) + hashes[j : n + j]
    whole = rows[:n] == rows[k - 1 :]
    runs, rows = mix(runs)[whole], rows[:n][whole].astype(np.uint64)
    shift = np.uint64(64 - _ROW_BITS)
    tagged = np.sort((rows << shift) | (runs >> np.uint64(_ROW_BITS)))
    tagged = tagged[np.append(True, tagged[1:] != tagged[:-1])[: len(tagged)]]
    counts = np.bincount((tagged >> shift).astype(np.int64), minlength=len(texts))
    return tagged & np.uint64((1 << (64 - _ROW_BITS)) - 1), counts


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, SLICE):
        yield batch.slice(start, SLICE)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind))
