"""The splitting tree over many sources: exact, even, and with the spread of draws without replacement; local shuffles."""

from collections import Counter

from tidemark.llm import mixing


def test_many_sources(spark):
    n = 400
    q = spark.createDataFrame([(f"s{i}", 3) for i in range(n)] + [(None, 3), ("", 3)], "source string, quota long")
    got = mixing.split_tree(q, 4).collect()
    own = Counter()
    for r in got:
        own[r.source] += r.quota
    assert set(own.values()) == {3} and len(own) == n + 2
    per = Counter()
    for r in got:
        per[r.shard] += r.quota
    assert max(per.values()) - min(per.values()) <= 2
    left = Counter()
    for r in got:
        left[r.source] += r.quota * (r.shard < 2)
    spread = Counter(left[s] for s in own)
    for k, share in enumerate((1 / 8, 3 / 8, 3 / 8, 1 / 8)):
        assert abs(spread[k] / (n + 2) - share) < 4 * (share * (1 - share) / n) ** 0.5
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.split_tree(q.repartition(3), 4).collect()), key=repr)


def test_rows_lie_in_shuffled_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICES", 2)
    rows = [(i, f"w{i} " * (i % 7 + 1), "ab"[i % 3 == 0], "x") for i in range(300)]
    df = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string, position string"), shards=4)
    parts = [p for p in df.rdd.glom().collect() if p]
    seen = []
    for p in parts:
        assert [(r.shard, r.position) for r in p] == sorted((r.shard, r.position) for r in p)
        slices = [(r.shard, int(r.position * 2)) for r in p]
        seen += sorted(set(slices))
    assert len(seen) == len(set(seen)) > 4  # a slice of a shard lies in one partition
    ids = [r.doc_id for p in parts for r in p]
    assert ids != sorted(ids)


def test_long_text(spark):
    rows = [(0, "w " * 1_000_000, "a"), *[(i, "w " * 10, "ab"[i % 2]) for i in range(1, 200)], (500, None, None), (501, "", "c")]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0]["size"] == 1_000_000 and got[0].copies in (1, 2) and got[500].copies == got[501].copies == 0
    assert abs(sum(r["size"] * r.copies for r in got.values() if r.source == "b") - got[1].target) <= 10
