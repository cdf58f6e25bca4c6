import random

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import tokenizer as t

RANKS = t.read_ranks(f"{t.TOKENIZERS}/{t.VOCABULARY}")
MODEL = t.serialise(RANKS)
ENCODER = t.Encoder(MODEL)


@pytest.fixture(scope="module")
def other():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=t.PATTERN, mergeable_ranks={b: i for i, b in enumerate(RANKS)}, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_decode_to_the_text(text):
    ids = ENCODER.encode([text])[0]
    assert b"".join(RANKS[i] for i in ids).decode() == text
    assert ENCODER.count([text]) == [len(ids)]


def test_ids_equal_another_library(other):
    r = random.Random(1)
    alphabet = [chr(c) for c in [*range(32, 127), 9, 10, 13, 0x1C, 0x85, 0xA0, 0x2028, 0x200B, 0xE9, 0x3B1, 0x4E2D, 0x1F600, 0xBD, 0x2160]] + [" ", " ", "'s", "'ll"]
    texts = ["".join(r.choices(alphabet, k=r.randrange(1, 80))) for _ in range(2000)] + ["a" * 30_000, " " * 2000 + "x", "<|endoftext|>", "x\r\n\r\n y"]
    assert ENCODER.encode(texts) == [other.encode_ordinary(x) for x in texts]


def test_encode_and_decode_over_tables(spark):
    data = [(1, "Hello world", "p"), (2, None, "q"), (3, "", "r"), (4, "Hello world", "s"), (5, "né\u4e2d\n" * 5000, "u")]
    df = spark.createDataFrame(data, "doc_id long, text string, ids string")
    got = t.encode(df, keep=["doc_id"])
    assert [f.simpleString() for f in got.schema.fields] == ["doc_id:bigint", "ids:array<int>"]
    by = {r["doc_id"]: r["ids"] for r in got.collect()}
    assert by[2] == by[3] == [] and by[1] == by[4] == [15496, 995]
    assert dict(rows(t.decode(got))) == {1: "Hello world", 2: "", 3: "", 4: "Hello world", 5: data[4][1]}
    assert t.encode(df.limit(0), keep=["doc_id"]).count() == 0


def test_decode_skips_unknown_ids(spark):
    df = spark.createDataFrame([(1, [15496, 99999, -1]), (2, None)], "k long, ids array<int>")
    assert rows(t.decode(df)) == [(1, "Hello"), (2, None)]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(t, "KEPT", 10)
    e = t.Encoder(MODEL)
    assert e.encode([f"word{i}" for i in range(50)]) == ENCODER.encode([f"word{i}" for i in range(50)])
    assert len(e.known) <= 10 + 50
    e.encode(["z" * 100])
    assert "z" * 100 not in e.known
