"""The encoder of packing: calls it makes, and long runs of white space."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lectern.llm import packing


class Counted:
    """Hands every call on and counts it."""

    def __init__(self, of):
        self.of, self.calls = of, 0

    def __getattr__(self, name):
        def call(*args, **named):
            self.calls += 1
            return getattr(self.of, name)(*args, **named)

        return call


def own_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    return [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_text_takes_one_call():
    """Calls for each new word cost more than all else where most words are new."""
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("aehinorst", k=9)) for _ in range(200)) for _ in range(50)]
    encoder = packing.WordEncoder(packing.tokenizer_path())
    encoder.encoder = counted = Counted(encoder.encoder)
    got = encoder.encode(texts)
    assert [np.frombuffer(x, np.uint32).tolist() for x in got] == own_ids(texts)
    assert counted.calls <= len(texts)


@pytest.mark.parametrize("text", [" " * 1_000_100 + "x", "a" + "\n" * 1_000_100, ("x" + " " * (packing.CAPACITY * 4)) * 3 + "y"], ids=["lead", "trail", "short"])
def test_long_white_space(text):
    got = packing.WordEncoder(packing.tokenizer_path()).encode([text])[0]
    assert np.frombuffer(got, np.uint32).tolist() == own_ids([text])[0]


def test_mixed_white_space():
    rng = random.Random(7)
    parts = [" ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", "\xa0", " ", "　", "​", "a", "Wort", "'s", "don't", "12", "-", "...", "é", "é", "漢字", "\0", "<|endoftext|>", "<|"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(2000)]
    got = packing.WordEncoder(packing.tokenizer_path()).encode(texts)
    assert [np.frombuffer(x, np.uint32).tolist() for x in got] == own_ids(texts)
