"""Token ids against the public library."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from memloom.llm import tokenise as T
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def ready():
    t = Tokenizer.from_file(T.TOKENIZER)
    t.encode_special_tokens = True
    return t


OWN = T.encoder(T.TOKENIZER)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=40))
def test_any_text(texts):
    t = Tokenizer.from_file(T.TOKENIZER)
    t.encode_special_tokens = True
    assert OWN.encode(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("text", ["a" * 4000, "q9z" * 20_000, " " * 3000, "日本語" * 400, "<|endoftext|> x", "​﻿", "I'll don't 'S", "x\r\n\r\n\ty"])
def test_odd(ready, text):
    assert OWN.encode([text]) == [ready.encode(text, add_special_tokens=False).ids]


def test_rows_and_single_agree():
    pieces = [bytes((i * j) % 97 + 32 for j in range(1, 9 + i % 8)) for i in range(200)]
    assert OWN.merge_rows(pieces, 16) == [OWN.merge_one(p) for p in pieces]


def test_table(spark):
    df = spark.createDataFrame([(1, "hello world", 0), (2, None, 0), (3, "", 0), (1, "hello world", 0)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, list(r.ids)) for r in T.encode(df, "doc_id", "text").collect())
    assert got == [(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]
    assert T.encode(df.limit(0), "doc_id", "text").count() == 0
