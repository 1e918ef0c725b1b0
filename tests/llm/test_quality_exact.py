"""Repeated words on long texts and under colliding hashes; verdicts against a plain minimum-covariance-determinant."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality


def brute_repeats(w):
    windows = list(zip(w, w[1:], w[2:]))
    count = Counter(windows)
    return len({j for i, x in enumerate(windows) if count[x] > 1 for j in (i, i + 1, i + 2)})


def test_long_text_without_repeats(spark):
    n = 8_000_000
    words = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: F.concat(F.lit("w"), F.hex(x)))
    docs = spark.range(1).select(F.lit(1).alias("doc_id"), F.array_join(words, " ").alias("text"))
    row = quality.text_stats(docs, keep=["doc_id"]).first()
    assert (row.n_words, row.n_repeat_words, row.base_failed) == (n, 0, False)


@pytest.mark.parametrize("values", [1, 2, 7])
def test_colliding_hashes(spark, monkeypatch, values):
    monkeypatch.setattr(quality, "window_hash", lambda a, b, c: F.pmod(F.xxhash64(a, b, c), F.lit(values)))
    rng = random.Random(values)
    texts = [" ".join(rng.choice("abcde")[: rng.randrange(2)] or rng.choice("xyz") for _ in range(rng.randrange(40))) for _ in range(60)]
    texts += ["a b c a b c", "a b c x a b c y a b c", " ".join(map(str, range(50))), "a a a a a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality.text_stats(df, keep=["doc_id"]).collect()}
    assert got == {i: brute_repeats(t.split()) for i, t in enumerate(texts)}


def distance(x, m, c):
    z = np.linalg.solve(np.linalg.cholesky(c), (x - m).T)
    return (z * z).sum(0)


def plain_mcd(x, prior=None, starts=12):
    """The estimate of least determinant over many random starts; the nearest H share by sorting."""
    floors = np.array(list(quality.FLOORS.values()))
    rng, best = np.random.default_rng(3), None
    for s in range(starts):
        m = np.median(x, 0) if s == 0 else x[rng.integers(len(x))]
        c, last = np.diag(np.maximum(x.std(0), floors) ** 2), np.inf
        for _ in range(100):
            order = np.argsort(distance(x, m, c), kind="stable")
            w = np.clip(quality.H * len(x) - np.arange(len(x)), 0, 1)
            y = x[order]
            mean = w @ y / w.sum()
            c = quality.CONSISTENCY * ((y * w[:, None]).T @ y / w.sum() - np.outer(mean, mean))
            m = mean
            if prior is not None:
                k = quality.PRIOR / (len(x) + quality.PRIOR)
                m, c = k * prior[0] + (1 - k) * m, k * prior[1] + (1 - k) * c
            c = c + np.diag(np.maximum(0, floors**2 - np.diag(c)))
            det = np.linalg.slogdet(c)[1]
            if abs(det - last) < 1e-9:
                break
            last = det
        if best is None or det < best[2]:
            best = m, c, det
    return best


def test_verdicts(spark):
    rng = random.Random(11)
    word = lambda k: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(max(1, round(rng.gauss(k, 2)))))
    rows = []
    for i in range(700):
        lang, source = rng.choice([("en", "a")] * 8 + [("de", "b")] * 3 + [("fr", None), (None, "a"), ("xx", f"s{i}")])
        n = int(rng.lognormvariate(5, 0.8)) + 50
        t = " ".join(word(5 if lang != "de" else 6) for _ in range(n))
        if i % 9 == 0:
            t = {0: t.replace(" ", " ### "), 1: "\n".join(["same line again"] * 30) + "\n" + t, 2: " ".join(word(25) for _ in range(n))}[i % 3 if i % 2 else (i // 9) % 3]
        rows.append((i, t, lang, source))
    rows += [(9000, None, "en", "a"), (9001, "", None, None), (9002, rows[0][1], rows[0][2], rows[0][3])]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)).collect()}
    x = np.array([[got[r[0]][f] for f in quality.FEATURES] for r in rows])
    whole = plain_mcd(x)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault((r[2], r[3]), []).append(i)
    assert min(map(len, groups.values())) == 1 < 200 < max(map(len, groups.values()))
    rejected = 0
    for own in groups.values():
        m, c, _ = plain_mcd(x[own], whole)
        for i, d2 in zip(own, distance(x[own], m, c), strict=True):
            r = got[rows[i][0]]
            assert abs(r.d2 - d2) <= 0.05 * (1 + d2)
            if abs(d2 - quality.CUTOFF) > 0.1 * quality.CUTOFF:
                assert r.kept == (not r.base_failed and d2 <= quality.CUTOFF)
                rejected += not r.kept and not r.base_failed
    assert rejected > 20


def test_chi_square():
    assert abs(quality.chi2_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(quality.chi2_cdf(14.0671, 7) - 0.95) < 1e-4
    assert abs(quality.CUTOFF - 30.856) < 0.01 and abs(quality.CONSISTENCY - 1.41) < 0.01
