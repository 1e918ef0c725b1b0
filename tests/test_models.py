"""Series with a break, fixed effects in two ways, and document volumes, against plain numpy."""

import numpy as np
import pytest

from tidemark.operators import intensity, models


def test_interrupted_series():
    rng = np.random.default_rng(4)
    series = [(24_000 + i, 2 + 0.1 * i + (5 + 0.3 * (i - 40)) * (i >= 40) + 0.5 * np.sin(i % 12) + 0.7 * np.log(50 + i) + 0.01 * rng.normal(), 50.0 + i) for i in range(72)]
    r = models.interrupted(series, 24_040)
    assert abs(r["step"] - 5) < 0.05 and abs(r["slope_change"] - 0.3) < 0.01 and r["r2"] > 0.999 and 0 < r["se_step"] < 0.1
    sweep = models.break_sweep(series, range(24_030, 24_051, 5))
    assert [x["event"] for x in sweep if x["best_fit"]] == [24_040]
    assert models.interrupted([*series, (30_000, None, 1.0)], 24_040) == r


def test_newey_west_by_hand():
    rng = np.random.default_rng(1)
    x, y = np.stack([np.ones(30), rng.normal(size=30)], 1), rng.normal(size=30)
    b, se = models.newey_west(x, y, 2)
    u = (y - x @ np.linalg.lstsq(x, y, rcond=None)[0])[:, None] * x
    s = sum((1 - abs(i - j) / 3) * np.outer(u[i], u[j]) for i in range(30) for j in range(30) if abs(i - j) <= 2)
    inv = np.linalg.inv(x.T @ x)
    assert np.allclose(se, np.sqrt(np.diag(inv @ s @ inv)))


def test_difference_in_differences_unbalanced(spark):
    rng = np.random.default_rng(2)
    rows = [(u, t, int(u < 8), int(t >= 4), float(u + 2 * t + 3 * (u < 8) * (t >= 4) + 0.01 * rng.normal())) for u in range(20) for t in range(8) if rng.random() < 0.8]
    r = models.difference_in_differences(spark.createDataFrame([*rows, (1, 1, 1, 0, None)], "u int, t int, e int, p int, y double"), "y", "e", "p", "u", "t", rounds=60)
    d = np.array([[e * p, *[u == k for k in range(20)], *[t == k for k in range(1, 8)]] for u, t, e, p, _ in rows], float)
    want = np.linalg.lstsq(d, np.array([x[4] for x in rows]), rcond=None)[0][0]
    assert abs(r["effect"] - want) < 1e-5 and r["se"] > 0 and r["n"] == len(rows)


@pytest.mark.parametrize("errors", ["plain", "hc1", "cluster"])
def test_fit_against_numpy(spark, errors):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=200)
    g = rng.integers(0, 20, 200)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(k)) for (a, b), c, k in zip(x, y, g, strict=True)] + [(None, 1.0, 1.0, 1)], "a double, b double, y double, g int")
    m = models.fit(df, "y", ["a", "b"], errors, "g")
    full = np.column_stack([np.ones(200), x])
    inv = np.linalg.inv(full.T @ full)
    e = y - full @ (inv @ full.T @ y)
    cov = {"plain": inv * (e @ e) / 197, "hc1": inv @ (full.T * e**2) @ full @ inv * 200 / 197}.get(errors)
    if cov is None:
        s = np.array([(full[g == k] * e[g == k, None]).sum(0) for k in range(20)])
        cov = inv @ s.T @ s @ inv * 20 / 19 * 199 / 197
    assert np.allclose(m["se"], np.sqrt(np.diag(cov))) and m["n"] == 200
    t = m["coef"][1:] @ np.linalg.inv(m["cov"][1:, 1:]) @ m["coef"][1:] / 2
    assert abs(models.wald(m, ["a", "b"]) - t) < 1e-6


def test_volumes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "d int, k string")
    paras = spark.createDataFrame([(1, " two words ", True), (1, "x", False), (2, "one", True), (3, "a b\nc", True)], "d int, paragraph_text string, is_scorable boolean")
    frames = spark.createDataFrame([(1, True), (1, None), (9, True)], "d int, promo boolean")
    from pyspark.sql import functions as F

    t = intensity.document_table(docs, paras, frames, "d", {"n_promo": F.col("promo")})
    assert sorted(map(tuple, t.select("d", "n_paragraphs", "n_words", "n_frames", "n_promo").collect())) == [(1, 1, 2, 2, 1.0), (2, 1, 1, 0, 0.0), (3, 1, 3, 0, 0.0)]
    g = {r.k: r for r in intensity.aggregate(t, "d", ["k"], ["n_promo"], ["n_promo"]).collect()}
    assert (g["a"].n_docs, g["a"].frames_per_1k, g["a"].promo_rate, g["a"].any_frames) == (2, 2000 / 3, 0.5, 1.0) and g["b"].promo_rate is None and g["b"].any_frames == 0
    years = spark.sql("SELECT DATE'2024-06-30' AS d, 6 AS m UNION ALL SELECT DATE'2024-07-01', 6 UNION ALL SELECT DATE'2024-12-31', NULL").select(intensity.fiscal_year(F.col("d"), F.col("m")).alias("y")).collect()
    assert [r.y for r in years] == [2024, 2025, 2024]
