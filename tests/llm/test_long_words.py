"""Text without blanks reaches the network whole."""

import random

import numpy as np

from tidemark.llm import toxicity


def test_long_words_are_covered():
    rng = random.Random(2)
    for n in [0, 1, 63, 64, 65, 111, 112, 113, 500, 5000]:
        text = "".join(rng.choice("的是不了人我在有他这") for _ in range(n))
        seen = {g for w in toxicity.words(text) for g in toxicity.grams(w)}
        raw = text.encode()
        assert all(raw[i : i + 4] in seen for i in range(len(raw) - 3))
        assert all(len(w) <= toxicity.PIECE for w in toxicity.words(text))


def test_score_depends_on_the_end():
    net = toxicity.Network([], [b"idio", b"diot"], np.random.default_rng(1))
    net.p["grams"][:] = 3.0
    net.p["out"][:] = 2.0
    clean, toxic = toxicity.Scorer(net).scores(["é" * 200, "é" * 200 + "idiot"])
    assert clean != toxic
