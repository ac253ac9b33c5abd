"""p6: ids equal the library's own encoding of whole texts; decoding gives the texts back."""

from codeloom.llm import tokens

TEXTS = [
    None, "", " ", "\n\n  x", "Hello  world's 12345 it'll", "größe и 日本語 🙂🙂", "a" * 5000, "  \t\r\n ", "\u0085x y", "end ",
    "for i in range(10):\n    x += 1\n", "<|endoftext|> is text here", "�​", "don't DON'T",
]


def test_ids_and_round_trip(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS + TEXTS)] + [(100, "word word word " * 3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = tokens.encode_corpus(docs)
    found = {r.doc_id: r.ids for r in encoded.collect()}
    own = tokens._coder(f"{tokens.TOKENIZER_DIR}/{tokens.RANKS_FILE}")
    assert found == {i: own.encode_ordinary(t) if t else [] for i, t, _ in rows}
    back = {r.doc_id: r.text for r in tokens.decode_corpus(encoded).collect()}
    assert back == {i: t or "" for i, t, _ in rows}


def test_decoding_of_nulls_and_cut_characters(spark):
    own = tokens._coder(f"{tokens.TOKENIZER_DIR}/{tokens.RANKS_FILE}")
    cut = own.encode_ordinary("日")[:1]
    rows = spark.createDataFrame([(1, None), (2, []), (3, cut), (4, own.encode_ordinary("größe"))], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in tokens.decode_corpus(rows).collect()} == {1: None, 2: "", 3: "\ufffd", 4: "größe"}


def test_word_table_encodes_each_word_once(spark):
    docs = spark.createDataFrame([(1, "red red green blue"), (2, "red green green")], "doc_id long, text string").coalesce(1)
    found = {r.word: (r.n, list(r.ids)) for r in tokens.word_table(docs).collect()}
    own = tokens._coder(f"{tokens.TOKENIZER_DIR}/{tokens.RANKS_FILE}")
    assert found[" green"] == (3, own.encode_ordinary(" green")) and " blue" not in found


def test_empty(spark):
    assert tokens.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_vocabulary_counts_every_word(spark, tmp_path):
    import re
    from collections import Counter

    long = "x" * 60
    texts = ["red once", f"red {long}", "red red again", None, "", f"{long} red"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = tokens._coder(f"{tokens.TOKENIZER_DIR}/{tokens.RANKS_FILE}")
    wanted = Counter(word for text in texts if text for word in re.findall(r" ?\w+", text))
    for parts in (1, 3):  # counts do not depend on how rows lie in batches
        docs.repartition(parts).write.mode("overwrite").parquet(f"{tmp_path}/{parts}/documents.parquet")
        rows = tokens.p6_vocabulary(spark, f"{tmp_path}/{parts}").collect()
        assert len(rows) == len(wanted)
        assert {r.word: (r.n, list(r.ids)) for r in rows} == {w: (n, own.encode_ordinary(w)) for w, n in wanted.items()}
