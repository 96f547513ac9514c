import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attestor.llm import bpe_codec, token_counts

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["'s", "don't ", "<|endoftext|>", "<|startoftext|>", "hello ", "WORLD", "  ", "\n\n", "a" * 30, "!" * 9, "0000", "ΑΣ ", "İ", "é", "\x1c", "\x85", "漢字", "😀", "½", "<|"]


def texts():
    rnd = random.Random(3)
    out = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 25))) for _ in range(400)]
    return out + ["".join(rnd.choice("theandingor ") for _ in range(rnd.randint(0, 300))) for _ in range(100)] + ["", " ", "ab" * 5000]


@pytest.fixture(scope="module")
def libraries():
    return {p: Tokenizer.from_file(p) for p in (WORDS, BYTES)}


def test_counts_equal_the_library(libraries):
    count = token_counts.counter(WORDS)
    xs = texts()
    assert [count(x) for x in xs] == [len(e.ids) for e in libraries[WORDS].encode_batch(xs, add_special_tokens=False)]


def test_codec_equals_the_library(libraries):
    codec = bpe_codec.codec(BYTES)
    xs = texts()
    mine = [np.frombuffer(codec.encode(x), "<u4").tolist() for x in xs]
    assert mine == [e.ids for e in libraries[BYTES].encode_batch(xs, add_special_tokens=False)]
    assert [codec.decode(codec.encode(x)).decode() for x in xs] == [libraries[BYTES].decode(i, skip_special_tokens=False) for i in mine]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    library = Tokenizer.from_file(BYTES) if not hasattr(test_any_text, "t") else test_any_text.t
    test_any_text.t = library
    codec = bpe_codec.codec(BYTES)
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert codec.decode(codec.encode(text)).decode() == text


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, score double, token_ids string, lang string")


def test_frames(spark):
    rows = [(1, "Hello world", 0.0, "x", "en"), (1, "Hello world", 0.0, "x", "en"), (2, None, None, None, None), (3, "", 0.0, "", ""), (None, "word " * 30000, 0.0, "", "")]
    got = [tuple(r) for r in token_counts.count_tokens(frame(spark, rows), WORDS).collect()]
    assert got[:4] == [(1, 11, 2, False)] * 2 + [(2, 0, 0, False), (3, 0, 0, False)] and got[4] == (None, 150000, 30000, True)
    out = [tuple(r) for r in bpe_codec.encode_decode(frame(spark, rows), BYTES).collect()]
    empty = hashlib.sha256(b"").hexdigest()
    assert out[2] == (2, 0, empty, empty) and out[0] == out[1] and out[4][3] == hashlib.sha256(b"word " * 30000).hexdigest()
    coded = bpe_codec.encoded(frame(spark, rows), BYTES, ids_col="token_ids", decoded_col="decoded").collect()
    assert [r.decoded for r in coded[:4]] == ["Hello world", "Hello world", "", ""] and coded[0].token_ids == [15496, 995]
    assert token_counts.count_tokens(frame(spark, []), WORDS).count() == bpe_codec.encode_decode(frame(spark, []), BYTES).count() == 0
