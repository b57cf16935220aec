import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import tokens as T

PATH = f"{T.VOCABULARIES}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return T.Encoder(T.Vocabulary(PATH)), t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_equal_to_the_library_on_any_text(both, text):
    assert both[0].encode(text) == both[1].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "\n\n \t x", "don't we'll I'VE", "<|endoftext|> a", "a" * 5000, "é" * 999, "​﻿⁠", "日本語テキスト 123 ４５６", "🎵🎶 x" * 50, " " * 4000 + "x", "ab" * 3000, "\x00\x01"])
def test_odd_texts(both, text):
    ids = both[0].encode(text)
    assert ids == both[1].encode(text, add_special_tokens=False).ids
    assert both[0].vocabulary.decode(ids) == text


def test_very_long_piece_is_not_quadratic(both):
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdefghij") for _ in range(200_000))
    ids = both[0].encode(text)
    assert both[0].vocabulary.decode(ids) == text


def test_documents(spark, both):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "hello world", 7), (3, "hello world", 7)], "doc_id long, text string, ids int")
    got = sorted((r["doc_id"], list(r["ids"])) for r in T.encode_texts(docs, path=PATH).collect())
    assert got == [(1, []), (2, []), (3, both[0].encode("hello world")), (3, both[0].encode("hello world"))]
    assert T.encode_texts(docs.limit(0), path=PATH).collect() == []


def test_corpus_equals_library(spark, both):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r["doc_id"]: both[1].encode(r["text"] or "", add_special_tokens=False).ids for r in docs.select("doc_id", "text").collect()}
    assert {r["doc_id"]: list(r["ids"]) for r in T.encode_texts(docs, path=PATH).collect()} == want
