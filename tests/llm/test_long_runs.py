"""Token counts of texts without a place to cut them, against the library."""

import random
import string
import time

import public_tokenizers
import pytest

from stowage.llm import token_counts as tc

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return tc.PieceModel(PATH)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


PARTS = ["the", "ing", "Er", " ", "   ", "\t", "\n", "=", "==", "00", "123", "é", "日本", "\U0001f600", "▁", "a" * 9, "-" * 7]


@pytest.mark.parametrize("long", [1, 2, 8])
def test_every_chunk_by_itself(monkeypatch, model, library, long):
    monkeypatch.setattr(tc, "LONG", long)
    rng = random.Random(long)
    texts = ["", "a", " ", "  ", *("".join(rng.choices(PARTS, k=rng.randint(1, 60))) for _ in range(400))]
    assert model.count(texts, {}) == [len(library.encode(t)) for t in texts]


@pytest.mark.parametrize("text", [
    pytest.param("".join(random.Random(1).choices(string.ascii_letters, k=1_000_000)), id="letters"),
    pytest.param(" " * 1_000_000, id="spaces"),
    pytest.param("".join(random.Random(2).choices(string.ascii_letters + string.digits + "+/", k=400_000)), id="base64"),
    pytest.param("ab" * 200_000 + "=" * 100_000, id="repeats"),
])
def test_long_runs_are_linear(model, library, text):
    begin = time.perf_counter()
    assert model.count([text], {}) == [len(library.encode(text))]
    assert time.perf_counter() - begin < 60
