import random

import pytest

from turnloom.llm.encode import SPLIT_PATTERN, TOKENIZER_DIR, encode_corpus, encoder, ranks_of

PATH = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
with open(PATH, "rb") as f:
    CONTENT = f.read()


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks_of(CONTENT), special_tokens={})


def ids_of(texts):
    offsets, ids = encoder(CONTENT).encode_batch(texts)
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def test_equals_the_merge_loop_on_random_texts(reference):
    rng = random.Random(7)
    parts = ["the ", "ing", " ", "\n", "  \t", "世界", "ーティ", "の", "é", "龍喚士", "'s", "12", "...", "e", "th", "​", "👍🏽", "а", " Ristev", "\r\n", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    assert ids_of(texts) == [reference.encode_ordinary(t) for t in texts]


def test_backtracking_alone_equals_the_merge_loop(reference):
    rng = random.Random(3)
    for _ in range(400):
        word = "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 30)))
        assert encoder(CONTENT).backtrack(word) == reference.encode_ordinary(word)


def test_very_long_pieces(reference):
    texts = ["a" * 30_000, "世" * 9_000, "ab" * 20_000 + " end"]
    assert ids_of(texts) == [reference.encode_ordinary(t) for t in texts]


def test_null_and_empty_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "hello world", "z"), (3, "hello world", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode_corpus(df).collect())
    assert got[:2] == [(1, []), (2, [])]
    assert got[2] == got[3] and bytes.join(b"", (encoder(CONTENT).token[i] for i in got[2][1])) == b"hello world"


def test_empty_table(spark):
    assert encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_round_trip_on_the_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    token = encoder(CONTENT).token
    for r in encode_corpus(docs).collect():
        assert b"".join(token[i] for i in r.ids).decode() == texts[r.doc_id]


def test_entries_of_any_length():
    """A vocabulary whose longest entry has 512 bytes."""
    import tiktoken

    from turnloom.llm.encode import BpeEncoder

    ranks = {bytes([b]): b for b in range(256)} | {b"a" * (2 << k): 256 + k for k in range(9)}
    own, reference = BpeEncoder(ranks), tiktoken.Encoding("x", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    for n in (1, 511, 512, 513, 1400):
        assert own.backtrack("a" * n) == reference.encode_ordinary("a" * n)


def test_sizes_of_the_packing_are_lengths_of_the_ids(spark, sf):
    from turnloom.llm.packing import token_counts

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {r.doc_id: r.size for r in token_counts(docs).collect()} == {r.doc_id: len(r.ids) for r in encode_corpus(docs).collect()}
