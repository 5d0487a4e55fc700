"""The backtracking encoder against the two public libraries, round trips, and the cases it defines."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import encode

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def enc():
    return encode.encoder(encode.vocabulary_path())


@pytest.fixture(scope="module")
def want():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_pattern_is_public():
    assert encode.PIECES == P.PATTERN


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    e = encode.encoder(encode.vocabulary_path())
    assert e.decode(e.encode(text)) == text


def test_same_ids(enc, want):
    rng = random.Random(1)
    for _ in range(1500):
        kind = rng.randrange(4)
        if kind == 0:
            s = "".join(rng.choice("abcdeABC 1,'\n\t") for _ in range(rng.randint(0, 80)))
        elif kind == 1:
            s = "".join(chr(rng.choice([rng.randint(32, 0x2FF), rng.randint(0x400, 0xD7FF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(30))
        elif kind == 2:
            s = rng.choice("a =-_*\n ") * rng.randint(0, 300)
        else:  # entries glued together, so that greedy choices go wrong
            s = "".join(rng.choice(enc.texts).encode("latin-1").decode("utf-8", "ignore") for _ in range(12)).replace(" ", "")
        assert enc.encode(s) == want(s)


def test_specials_are_text(enc):
    assert len(enc.encode("<|endoftext|>")) > 1


def test_long_piece(enc, want):
    s = "ab" * 60_000 + " " * 50_000 + "é" * 20_000
    assert enc.encode(s) == want(s)


def test_table(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (4, " \n", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode.encode_texts(df, "doc_id", "text").collect())
    assert got[0] == got[1] and got[2] == (2, []) and got[3] == (3, []) and got[4][1]
    assert encode.encode_texts(df.limit(0), "doc_id", "text").count() == 0
