"""The bounded sample, the calibration, and long texts."""

import random

import numpy as np

from tidemark.llm import toxicity


def test_one_text_a_document(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y: seen.append((list(texts), y.tolist())))
    monkeypatch.setattr(toxicity, "SAMPLE", 10)
    docs = spark.createDataFrame([(i % 40, f"text {i % 3} of {i % 40}") for i in range(4000)] + [(None, "x"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    toxicity.learn(docs.repartition(4), labels)
    toxicity.learn(docs, labels.repartition(3))
    assert seen[0] == seen[1] and len(seen[0][0]) <= 20 and len(set(seen[0][0])) == len(seen[0][0])


def test_calibration():
    rng = np.random.default_rng(2)
    y = (rng.random(3000) < 0.2).astype(int)
    best = 3 * rng.normal(size=3000) + 9 * y + 20
    scale, shift = toxicity.calibration(best, y, np.ones(3000))
    assert 0.85 < scale < 1.15  # two normals 9 apart, with deviation 3: their log-odds have slope 1
    score = 1 / (1 + np.exp(-(scale * best + shift)))
    f1 = lambda t: 2 * y[score >= t].sum() / ((score >= t).sum() + y.sum())
    assert f1(toxicity.LIMIT) >= max(f1(t) for t in np.linspace(0.01, 0.99, 99)) - 1e-9
    scale, shift = toxicity.calibration(np.array([-5.0, -4, 4, 5]), np.array([0, 0, 1, 1]), np.array([1.0, 1, 9, 1]))
    assert 0 < scale < 10 and abs(shift - np.log(toxicity.LIMIT / (1 - toxicity.LIMIT))) < 1e-9


def test_long_text_is_scored_to_its_end():
    rng = random.Random(1)
    clean = " ".join(rng.choice(["one", "two", "three"]) for _ in range(200_000))
    net = toxicity.Network([b"one", b"two", b"three", b"idiot"], [b"idio"], np.random.default_rng(1))
    net.p["words"][4] = 5.0
    moved = []
    for sign in (2.0, -2.0):  # the word pushes the last window's score up under one of the signs
        net.p["out"][:] = sign
        a, b = toxicity.Scorer(net).scores([clean, clean + " idiot"])
        moved.append(b - a)
    assert max(moved) > 0
