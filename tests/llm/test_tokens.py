from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from motifloom.llm import tokens as K

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [
    "Hello world", "", None, "it's we'll 'S they're''ve", "a  b\n\n c\t\td  ", "naïve ½ ²³ straße", "日本語 text 😀", "a  b   c   d", "x<|endoftext|>y <|endoftext|>", "a\x1cb\x85c᠎d",
    "word " * 30_000, "z" * 20_000, "<|endoftext", "   x", "ȟ Ƞ ǅ ĳ ſ",
]


def count(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("size", [3, 1000])
def test_counts_equal_the_library(spark, size):
    rows = [(i, t, 0) for i, t in enumerate(TEXTS)] + [(None, "no id", 0), (0, "Hello world", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    got = K.count_tokens(docs, PATH, table_size=size).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "no id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        assert (r["n_tokens"], r["n_bytes"]) == (count(text), len(text.encode()))
    assert K.count_tokens(docs.where("false"), PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'a1sré½  .!日"), st.characters(max_codepoint=0x21F, exclude_categories=["Cs"]), st.characters(min_codepoint=0x2000, max_codepoint=0x206F)), max_size=40))
def test_split_texts_sum_up(text):
    if K._safe(text, ("<|endoftext|>",)):
        parts = K._SPLIT.findall(text)
        assert "".join(parts) == text
        assert sum(K._lengths(PATH, parts)) == count(text)


def test_frequent_come_first(spark):
    docs = spark.createDataFrame([(i, "common words here " + f"rare{i}") for i in range(50)], "doc_id long, text string").repartition(9)
    top = K.frequent_pretokens(docs.select("text"), 4, fan_in=2)
    assert set(top) >= {"common", " words", " here"}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'as1λж日\u3000ـ€😀\u0301"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_texts_of_all_scripts_are_split(text):
    parts = K._pretokens(PATH, text)
    assert parts is not None and "".join(parts) == text
    assert sum(K._lengths(PATH, parts)) == count(text)


def test_other_scripts_are_looked_up():
    texts = ["λόγος λόγος", "слово €", "x<|endoftext|>λόγος"]
    table = SimpleNamespace(value={"λόγος": 100, " λόγος": 1000, "слово": 10_000})
    batch = pa.RecordBatch.from_pydict({"doc_id": [0, 1, 2], "text": texts})
    (got,) = K._count(PATH, table)([batch])
    assert got.column("n_tokens").to_pylist() == [1100, 10_000 + count(" €"), count(texts[2])]
