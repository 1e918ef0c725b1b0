"""License passages: verified spans against a plain search, and texts that only look like licenses."""

import random

import pytest

from tidemark.llm import licenses as L


def plain(text):
    """labels and score: every text word aligned with every template word, by the longest forward sequence of five-word matches."""
    w = [x.decode() for x in L.words(text.encode())]
    labels, score = set(), 0.0
    for t, label, k in L._templates():
        tw = t.split()
        hits = [(i, j) for j in range(len(tw) - k + 1) for i in range(len(w) - k + 1) if w[i : i + k] == tw[j : j + k]]
        if k == L.PHRASE_K:
            if any(w[i : i + len(tw)] == tw for i in range(len(w))):
                labels.add(label)
                score = 1.0
            continue
        best = 0.0
        for d in {i - j for i, j in hits}:
            own = sorted((i, j) for i, j in hits if d - L.NEAR <= i - j <= d)
            chains = []
            for n, (i, j) in enumerate(own):  # the longest chain that ends here, and the template words in it
                before = max((c for c, (a, b) in zip(chains, own[:n]) if a < i and b < j), key=len, default=())
                chains.append((*before, j))
            best = max(best, *[len({x for j in c for x in range(j, j + k)}) / len(tw) for c in chains if len(c) == max(map(len, chains))])
        if best >= L.COVER:
            labels.add(label)
        score = max(score, best if best >= L.COVER else best / 2)
    return sorted(labels), score


def edited(rng, label):
    w = L.PASSAGES[label].split()
    for _ in range(rng.randrange(12)):
        at = rng.randrange(len(w))
        w[at : at + rng.randrange(2)] = rng.choice([[], ["very"], ["new", "word"]])
    cut = rng.choice([0, 0, len(w) // 4, len(w) // 2])
    return w[cut:] if rng.random() < 0.5 else w[: len(w) - cut]


def test_against_plain(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(3)):
            parts += ["lorem", "ipsum"] * rng.randrange(6) + edited(rng, rng.choice(list(L.PASSAGES)))
        rows.append((i, " ".join([*parts, "dolor"])))
    got = {r.doc_id: (r.labels, r.score) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = 0
    for i, text in rows:
        labels, score = plain(text)
        # of several longest sequences either may be taken: they differ by a few words at an edit
        assert abs(got[i][1] - score) < 0.05 and (got[i][0] == labels or abs(score - L.COVER) < 0.05), i
        found += bool(labels)
    assert found > 15


@pytest.mark.parametrize(("text", "times"), [
    ("this work is licensed under", 4), ("redistribution and use in source", 30), ("without warranty of any kind express or implied", 40), ("the software is provided as is", 200),
])
def test_repeated_fragments_are_no_license(spark, text, times):
    for sep in (" ", " more words ", ". "):
        row = L.scan(spark.createDataFrame([(1, sep.join([text] * times))], "doc_id long, text string")).first()
        assert row.labels == [] and row.score < 0.3


def test_whole_texts_and_disordered_ones(spark):
    rows = [(i, f"Copyright 2020. {t.capitalize()}.") for i, t in enumerate(L.PASSAGES.values())]
    for i, t in enumerate(L.PASSAGES.values()):
        w = t.split()
        pieces = [" ".join(w[j : j + 6]) for j in range(0, len(w), 6)]
        pieces.reverse()
        rows.append((100 + i, " ".join(pieces)))
    rows.append((300, (L.PASSAGES["mit"] + " filler ") * 300))
    got = {r.doc_id: (r.labels, r.score) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in enumerate(L.PASSAGES):
        assert got[i][0] == [label] and got[i][1] == 1
    for i, text in rows[len(L.PASSAGES) : -1]:
        assert got[i][0] == sorted({v for k, v in L.PHRASES.items() if k in text})  # out of order, only phrases count
    assert got[300] == (["mit"], 1.0)
