"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 6).

Method: distinct-word table. Spark splits every text into the tokenizer's words; the
vocabulary holds every distinct word with its exact count, encoded once. To encode texts, the
words that recur are gathered into one table, each is encoded once, and the ids are joined back
by position. A word that does not recur within a batch has too few positions to gain from that
table and is encoded where it stands, once per batch. Decoding is a join of ids to pieces.

Defined cases: null and empty texts give an empty id list; ids keep the row multiplicity of
the input (a repeated row is encoded again); extra columns are ignored; an empty table gives
an empty result. Whole texts are encoded, however long.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.sources.tables import table

TOKENIZER_DIR = "/opt/tokenizers"
RANKS_FILE = "byte_bpe_50k.tiktoken"

# Fixed value: the word pattern of the public byte-level BPE vocabulary, in Java syntax.
WORD_PATTERN = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)

#: Rows of the word table that are sent to every task, at most, and the longest word in it:
#: 200,000 words of at most 48 bytes bound the broadcast at about 12 MB for any corpus.
TABLE_WORDS = 200_000
TABLE_WORD_BYTES = 48


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


_CODERS: dict[str, object] = {}


def _coder(path: str):
    """The tokenizer, built once per Python worker."""
    if path not in _CODERS:
        import public_tokenizers
        import tiktoken

        _CODERS[path] = tiktoken.Encoding(
            "codeloom", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens={}
        )
    return _CODERS[path]


def _encode_words(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every word, one after the other, and how many each word has."""
    encode = _coder(path).encode_ordinary
    ids = [encode(word) for word in words]
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((i for own in ids for i in own), np.int32, int(counts.sum())), counts


def _gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The slices values[start : start + count], one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts - (ends - counts), counts)]


def split_words(text: str = "text") -> F.Column:
    """The words of a text in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.col(text), F.lit(WORD_PATTERN), F.lit(0)), F.array().cast("array<string>"))


def _batch_counts(docs: DataFrame, text: str, least: int, longest: int | None) -> DataFrame:
    """(word, n), a row per batch: words at ``least`` positions of the batch and at most ``longest`` bytes long.

    Batches count in Arrow, so the shuffle carries vocabulary and never positions; a hot word
    arrives as one row per batch.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = pc.value_counts(batch.column(0).flatten())
            words, n = seen.field("values"), seen.field("counts")
            keep = pc.greater_equal(n, least)
            if longest is not None:
                keep = pc.and_(keep, pc.less_equal(pc.binary_length(words), longest))
            yield pa.RecordBatch.from_arrays([words.filter(keep), n.filter(keep)], names=["word", "n"])

    return docs.select(split_words(text).alias("words")).mapInArrow(count, "word string, n long")


def recurring_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): short words that recur within a batch of rows, with the count of those positions.

    These only pick what encode_corpus sends to every task; the choice has no effect on the ids.
    """
    return _batch_counts(docs, text, 2, TABLE_WORD_BYTES).groupBy("word").agg(F.sum("n").alias("n"))


def distinct_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): every word of the corpus, however rare or long, with the count of all its positions."""
    return _batch_counts(docs, text, 1, None).groupBy("word").agg(F.sum("n").alias("n"))


def _with_ids(words: DataFrame, directory: str) -> DataFrame:
    """(word, n, ids) of (word, n) rows."""
    path = os.path.join(directory, RANKS_FILE)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = _encode_words(batch.column(0).to_pylist(), path)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(ids))],
                names=["word", "n", "ids"],
            )

    return words.mapInArrow(encode, "word string, n long, ids array<int>")


def word_table(docs: DataFrame, text: str = "text", directory: str = TOKENIZER_DIR) -> DataFrame:
    """(word, n, ids) of the recurring words, every one encoded once."""
    return _with_ids(recurring_words(docs, text), directory)


def vocabulary(docs: DataFrame, text: str = "text", directory: str = TOKENIZER_DIR) -> DataFrame:
    """(word, n, ids): the distinct-word table of the whole corpus, every word encoded once."""
    return _with_ids(distinct_words(docs, text), directory)


def encode_corpus(
    docs: DataFrame, key: str = "doc_id", text: str = "text", directory: str = TOKENIZER_DIR
) -> DataFrame:
    """(key, ids) of every row of ``docs`` by the tokenizer, without special tokens.

    The most frequent TABLE_WORDS rows of the word table, a bounded number of bounded rows,
    go to every task; all other words are encoded at their own positions.
    """
    path = os.path.join(directory, RANKS_FILE)
    docs = docs.select(key, text)
    top = (
        word_table(docs, text, directory)
        .orderBy(F.desc("n"), "word")
        .limit(TABLE_WORDS)
        .select("word", "ids")
        .toArrow()
    )
    known_ids = top.column("ids").combine_chunks() if top.num_rows else pa.array([], pa.list_(pa.int32()))
    shared = docs.sparkSession.sparkContext.broadcast(
        (
            top.column("word").combine_chunks() if top.num_rows else pa.array([], pa.string()),
            known_ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32),
            pc.list_value_length(known_ids).to_numpy(zero_copy_only=False).astype(np.int64),
        )
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids, counts = shared.value
        words = words.cast(pa.string())
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().cast(pa.string())
            place = pc.index_in(flat, value_set=words)
            rare = flat.filter(pc.is_null(place)).unique()
            rare_ids, rare_counts = _encode_words(rare.to_pylist(), path)
            place = pc.fill_null(place, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(rare):
                at = pc.index_in(flat, value_set=rare)
                at = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
                place = np.where(place < 0, at + len(words), place)
            all_ids, all_counts = np.concatenate([ids, rare_ids]), np.concatenate([counts, rare_counts])
            starts = np.cumsum(all_counts) - all_counts
            own = all_counts[place]
            out = _gather(all_ids, starts[place], own)
            ends = np.concatenate([[0], np.cumsum(own)])
            at_row = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            offsets = pa.array(ends[at_row.astype(np.int64)].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.astype(np.int32)))], names=[key, "ids"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), split_words(text).alias("words")).mapInArrow(join, f"{key} {kind}, ids array<int>")


def decode_corpus(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", directory: str = TOKENIZER_DIR) -> DataFrame:
    """(key, text): every id joined to its piece of the vocabulary, pieces concatenated.

    The id-to-piece table has as many rows as the vocabulary (50,256), whatever the corpus, and is
    sorted by id, so a batch joins all of its ids to it by position at once; no position is shuffled.
    A null list gives null, an empty one an empty text. Bytes that are not UTF-8 show as U+FFFD.
    """
    path = os.path.join(directory, RANKS_FILE)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array([piece for piece, _ in sorted(_ranks(path).items(), key=lambda x: x[1])], pa.large_binary())
        for batch in batches:
            lists = batch.column(1)
            joined = pieces.take(lists.flatten())
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            raw = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)])), joined), pa.scalar(b"", pa.large_binary()))
            try:
                texts = raw.cast(pa.large_string())
            except pa.ArrowInvalid:  # ids that some other encoder cut within a character
                texts = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.large_string())
            texts = pc.if_else(lists.is_null(), pa.scalar(None, pa.large_string()), texts).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(join, f"{key} {kind}, text string")


def p6_ids(spark: SparkSession, directory: str) -> DataFrame:
    return encode_corpus(table(spark, directory, "documents"))


def p6_vocabulary(spark: SparkSession, directory: str) -> DataFrame:
    """The distinct-word table of the corpus: every word, the number of its positions and its ids."""
    return vocabulary(table(spark, directory, "documents"))


def p6_token_counts(spark: SparkSession, directory: str) -> DataFrame:
    """Per language label: documents, their characters, and documents that encoding and decoding gives back.

    Every document is encoded and decoded; n_same counts those that come back unchanged.
    """
    docs = table(spark, directory, "documents")
    # Only hashes of the texts are joined; the texts stay where they are.
    mark = lambda text: F.xxhash64(F.coalesce(text, F.lit("")))
    back = decode_corpus(encode_corpus(docs)).select("doc_id", mark("text").alias("back"))
    return (
        docs.select("doc_id", "lang", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), mark("text").alias("own"))
        .join(back, "doc_id")
        .groupBy("lang")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.count_if(F.col("own") == F.col("back")).alias("n_same"))
    )


QUERIES = {"p6_ids": p6_ids, "p6_vocabulary": p6_vocabulary, "p6_token_counts": p6_token_counts}

ORACLES = {
    "p6_token_counts": "SELECT lang, count(*) AS n_docs, sum(length(coalesce(text, '')))::BIGINT AS n_chars, count(*) AS n_same FROM documents GROUP BY lang",
}
