"""Sketch similarities against brute force over all pairs."""

import random

import pytest
import xxhash

from tidemark.operators import sketches


def shingles(text):
    w = text.split()
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 5]), 42) for i in range(max(1, len(w) - 4))]
    return {h - (1 << 64) if h >> 63 else h for h in hashes}


def brute(texts, least):
    """{(i, j): share of the 256 smallest of the union that both hold}"""
    sets = [shingles(t) for t in texts]
    small = [set(sorted(s)[:256]) for s in sets]
    out = {}
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            union = sorted(sets[i] | sets[j])[:256]
            share = sum(h in sets[i] and h in sets[j] for h in union) / len(union)
            if small[i] != small[j] and share >= least:
                out[i, j] = share
    return out


@pytest.fixture(scope="module")
def texts():
    """Pairs of 300 to 2,000 words, one contained in the other or both changed, and short ones."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    out = []
    for n in [300, 400, 600, 900, 1300, 1600, 2000] * 4:
        long = [word() for _ in range(n)]
        out += [" ".join(long), " ".join(long[: int(n * rng.uniform(0.74, 0.97))])]
    for n in [4, 5, 9, 14, 19, 40]:
        short = [word() for _ in range(n)]
        out += [" ".join(short), " ".join([*short, word()]), " ".join([*short, word(), word()])]
    return out


def test_pairs_of_unequal_length(spark, texts):
    want = brute(texts, 0.8)
    assert len([p for p in want if len(texts[p[0]].split()) > 300 and want[p] < 0.88]) > 3
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.a, r.b): r.similarity for r in sketches.sketch_pairs(df, "id", "text", 0.8).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_classes_hold_every_row(spark, texts):
    rng = random.Random(4)
    base = [f"v{rng.randrange(5000)}" for _ in range(500)]
    near = [" ".join([*base[:i], "other", *base[i + 1 :]]) for i in range(0, 500, 25)]
    rows = [*texts, *near, *["one text in many copies and nothing else near it"] * 50, "", None, "...", ""]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    got = {r.id: r["class"] for r in sketches.sketch_classes(df, "id", "text", 0.8).collect()}
    have = [i for i, t in enumerate(rows) if (t or "").strip(".")]
    want = list(range(len(rows)))
    pairs = [(have[i], have[j]) for i, j in brute([rows[i] for i in have], 0.8)]
    pairs += [(i, j) for i in have for j in have if i < j and sorted(shingles(rows[i]))[:256] == sorted(shingles(rows[j]))[:256]]
    for _ in range(50):
        for i, j in pairs:
            want[i] = want[j] = min(want[i], want[j])
    assert [got[i] for i in range(len(rows))] == want
