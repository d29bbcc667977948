from __future__ import annotations

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import encode

PATH = f"{encode.TOKENIZERS}/{encode.DEFAULT}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")
DOCS = "doc_id bigint, text string, source string, ids int"


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_exact_on_any_text(reference, text):
    assert encode.encoder(PATH)(text) == reference(text)


@settings(max_examples=200, deadline=None)
@given(st.text("abcdeéß漢 \n\t01?!'<|endoftext>", max_size=120))
def test_exact_on_dense_merges(reference, text):
    assert encode.encoder(PATH)(text) == reference(text)


@pytest.mark.parametrize("text", ["a" * 20_000, "ing" * 5000, "=-" * 3000, " " * 4000, "<|endoftext|>", "\r\n" * 50, "🌊🧀" * 300])
def test_exact_on_long_runs(reference, text):
    assert encode.encoder(PATH)(text) == reference(text)


def test_table(spark, reference):
    rows = [(1, "Hello world", "a", 0), (2, "", "a", 0), (3, None, "a", 0), (4, "Hello world", None, 0)]
    got = {r.doc_id: r.ids for r in encode.encode(spark.createDataFrame(rows, DOCS).drop("ids"), ["doc_id"]).collect()}
    assert got == {1: reference("Hello world"), 2: [], 3: [], 4: reference("Hello world")}
    assert encode.encode(spark.createDataFrame([], DOCS), ["doc_id"]).count() == 0
    counts = {r.doc_id: r.tokens for r in encode.count_tokens(spark.createDataFrame(rows, DOCS), ["doc_id"]).collect()}
    assert counts == {1: 2, 2: 0, 3: 0, 4: 2}
