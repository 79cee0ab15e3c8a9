import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionloom.llm import bpe

RAW = open(f"{bpe.VOCABULARIES}/byte_bpe_50k.tiktoken", "rb").read()
ENC = bpe.encoder_of(RAW)
PLAIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TIK = tiktoken.Encoding("own", pat_str=PLAIN, mergeable_ranks=ENC.ranks, special_tokens={})
ODD = ["<|endoftext|> hi", "\x1c\x1d a\x85b", "=" * 5000, "ab" * 3000, "ñ" * 700 + "    x", "᠎ ​ c", "\U0001f469‍\U0001f4bb" * 50, "Ⅷ ² ½ ٣", "don't I'll THEY'RE", " \n\n x\t"]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_equals_public_library(text):
    ids = ENC.encode(text)
    assert ids == TIK.encode_ordinary(text)
    assert TIK.decode(ids) == text


@pytest.mark.parametrize("text", ODD)
def test_unusual_texts(text):
    assert ENC.encode(text) == TIK.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=120))
def test_heap_merges_like_the_array(word):
    assert bpe.merge_long(word, ENC.ranks) == bpe.merge_short(word, ENC.ranks)


def test_corpus_column(spark):
    rows = [(1, "hello world", "a"), (1, "hello world", "a"), (2, None, None), (3, "", "b"), (4, "x " * 50_000, "c")]
    got = sorted(bpe.encode_corpus(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect(), key=lambda r: r.doc_id)
    assert [len(r.ids) for r in got] == [2, 2, 0, 0, len(TIK.encode_ordinary("x " * 50_000))] and got[0].lang == "a"
    assert bpe.encode_corpus(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []
