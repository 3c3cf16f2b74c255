"""Encoding by the trie equals the public tokenizer and decodes to the text."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import p5_encode as P

tokenizers = pytest.importorskip("tokenizers")
THEIRS = tokenizers.Tokenizer.from_file(P.VOCABULARY)
THEIRS.encode_special_tokens = True
OURS = P.TrieEncoder()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_same_ids(text):
    text = text.encode("utf-8", "ignore").decode()
    assert OURS.encode([text])[0] == THEIRS.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aAbeé ", max_size=80))
def test_repeated_letters(text):
    assert OURS.encode([text])[0] == THEIRS.encode(text, add_special_tokens=False).ids


def test_operator(spark):
    texts = ["Hello world", None, "", "  \n\t ", "<|endoftext|>", "x" * 20000, "naïve 東京 🙂", "Hello world"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit(1)).withColumn("key", F.lit(1))
    got = {r["doc_id"]: r["ids"] for r in P.encode_corpus(df).collect()}
    assert got == {i: THEIRS.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(texts)}
    counts = {r["doc_id"]: r["n_tokens"] for r in P.token_counts(df, ["doc_id"]).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert P.encode_corpus(df.where("false")).count() == 0


def test_the_core_encodes_alike(spark):
    import os

    from corpusmill.operators import bpe

    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    ours = {r["doc_id"]: r["ids"] for r in P.encode_corpus(documents).collect()}
    assert ours == {r["doc_id"]: r["ids"] for r in bpe.encode(documents).collect()}
