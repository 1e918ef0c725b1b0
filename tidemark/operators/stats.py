"""Regressions from distributed moments, resampling by hash, and small matrix models.

A regression's rows never leave the cluster: one aggregate returns the Gram matrix (a number for each pair of
regressors), and the cluster sandwich is one more aggregate over score sums per cluster. Only those numbers are solved
with numpy on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gram(df: DataFrame, y: str, x: Sequence[str]) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X (with a constant first), X'y, y'y and n of the complete rows, in one aggregate."""
    ok = df.where(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in [y, *x])))
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in x], F.col(y).cast("double")]
    k = len(cols)
    row = ok.agg(*[F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    return g[:-1, :-1], g[:-1, -1], float(g[-1, -1]), int(g[0, 0])


def ols(df: DataFrame, y: str, x: Sequence[str], cluster: str | None = None) -> list[dict]:
    """Terms with coef, se (plain, or robust to clusters with the usual small-sample factor), t, n and r2."""
    xx, xy, yy, n = gram(df, y, x)
    inverse = np.linalg.pinv(xx)
    b = inverse @ xy
    k = len(b)
    rss = yy - b @ xy
    tss = yy - xy[0] ** 2 / n if n else 0.0
    if cluster is None:
        v = inverse * max(rss, 0) / max(n - k, 1)
    else:
        ok = df.where(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in [y, *x])))
        fit: Column = F.lit(float(b[0]))
        for c, w in zip(x, b[1:], strict=True):
            fit = fit + F.col(c) * float(w)
        e = F.col(y) - fit
        scores = ok.groupBy(cluster).agg(F.sum(e).alias("s0"), *[F.sum(e * F.col(c)).alias(f"s{i + 1}") for i, c in enumerate(x)])
        row = scores.agg(F.count(F.lit(1)).alias("g"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
        meat = np.array([[row[f"m{i}_{j}"] for j in range(k)] for i in range(k)])
        v = inverse @ meat @ inverse * (row.g / max(row.g - 1, 1)) * ((n - 1) / max(n - k, 1))
    se = np.sqrt(np.maximum(np.diag(v), 0))
    r2 = float(1 - rss / tss) if tss > 0 else None
    return [{"term": t, "coef": float(c), "se": float(s), "t": float(c / s) if s > 0 else None, "n": n, "r2": r2} for t, c, s in zip(["const", *x], b, se, strict=True)]


def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """z-scores with the population deviation; null where a column is constant."""
    m = df.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return df.select("*", *[((F.col(c) - F.lit(m[f"m_{c}"])) / F.lit(m[f"s_{c}"] or None)).alias(f"z_{c}") for c in cols])


def absorb(df: DataFrame, cols: Sequence[str], groups: Sequence[str], rounds: int = 25) -> DataFrame:
    """cols with the means of all group sets taken out by alternating projections."""
    out = df
    for i in range(rounds):
        for g in groups:
            out = out.withColumns({c: F.col(c) - F.avg(c).over(Window.partitionBy(g)) for c in cols})
        if i % 5 == 4:
            out = out.checkpoint() if out.sparkSession.sparkContext.getCheckpointDir() else out
    return out


def newey_west(x: np.ndarray, y: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and HAC standard errors of a short series."""
    inverse = np.linalg.pinv(x.T @ x)
    b = inverse @ x.T @ y
    u = (y - x @ b)[:, None] * x
    s = u.T @ u
    for k in range(1, lag + 1):
        g = u[k:].T @ u[:-k]
        s += (1 - k / (lag + 1)) * (g + g.T)
    return b, np.sqrt(np.maximum(np.diag(inverse @ s @ inverse), 0))


def benjamini_hochberg(df: DataFrame, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Adjusted p-values (step-up) within each family of tests."""
    n = F.count(p).over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(p))
    df = df.withColumn("__q", F.col(p) * n / rank)
    down = Window.partitionBy(*by).orderBy(F.col(p).desc(), F.col("__q").asc()).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("q_value", F.least(F.lit(1.0), F.min("__q").over(down))).drop("__q")


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two raters beyond chance: n, observed, expected, kappa."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("c").alias("x"), F.lit(0).alias("y")), F.struct(F.col("b").alias("v"), F.lit(0).cast("long").alias("x"), F.col("c").alias("y")))).alias("s"), "a", "b", "c")
    per = sides.groupBy("s.v").agg(F.sum("s.x").alias("x"), F.sum("s.y").alias("y"), F.sum(F.when((F.col("a") == F.col("b")) & (F.col("s.x") > 0), F.col("c")).otherwise(0)).alias("same"))
    t = per.agg(F.sum("x").alias("n"), F.sum("same").alias("same"), F.sum(F.col("x") * F.col("y")).alias("xy"))
    po, pe = F.col("same") / F.col("n"), F.col("xy") / (F.col("n") * F.col("n"))
    return t.select("n", po.alias("observed"), pe.alias("expected"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def bootstrap_clusters(df: DataFrame, cluster: str, replicates: int, seed: str) -> DataFrame:
    """Rows of each replicate: as many clusters as there are, drawn with replacement by hash, under synthetic ids.

    Draw j of replicate r picks the cluster whose number is a hash of (seed, r, j), so partitions do not matter.
    """
    named = df.select(cluster).distinct().withColumn("__i", F.row_number().over(Window.orderBy(cluster)) - 1)
    n = named.count()
    draws = df.sparkSession.range(replicates * n).select((F.col("id") / n).cast("int").alias("replicate"), (F.col("id") % n).alias("draw"))
    draws = draws.withColumn("__i", F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), "replicate", "draw"), 256), 1, 12), 16, 10).cast("long") % n)
    return draws.join(named, "__i").join(df, cluster).drop("__i")


def permutation_p(hits: int, n: int) -> float:
    return (hits + 1) / (n + 1)


def t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t, by the incomplete beta continued fraction."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(a * math.log(x) + b * math.log(1 - x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or 1e-300)
        h = d
        for m in range(1, 300):
            k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            d, c = 1 / ((1 + k * d) or 1e-300), (1 + k / c) or 1e-300
            h *= d * c
            k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d, c = 1 / ((1 + k * d) or 1e-300), (1 + k / c) or 1e-300
            h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b


def simplex(v: np.ndarray) -> np.ndarray:
    """Rows projected to the probability simplex."""
    s = -np.sort(-v, axis=1)
    c = (np.cumsum(s, 1) - 1) / np.arange(1, v.shape[1] + 1)
    k = (s > c).sum(1)
    return np.maximum(v - c[np.arange(len(v)), k - 1][:, None], 0)


def archetypes(x: np.ndarray, k: int, steps: int = 200, starts: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """k extreme profiles and each row's weights on them, by projected gradient from furthest-sum starts.

    For a feature matrix of a few thousand rows (one per unit), so it runs in one place.
    """
    best = None
    for start in range(min(starts, len(x))):
        chosen = [start * len(x) // starts]
        for _ in range(k + 2):
            far = sum(np.linalg.norm(x - x[i], axis=1) for i in chosen)
            far[chosen] = -1
            chosen = [*chosen, int(far.argmax())][-k:]
        z = x[chosen].copy()
        a = np.full((len(x), k), 1 / k)
        b = np.zeros((k, len(x)))
        b[np.arange(k), chosen] = 1
        for _ in range(steps):
            a = simplex(a - (a @ z - x) @ z.T / (np.linalg.norm(z @ z.T, 2) + 1e-12))
            grad = a.T @ (a @ z - x) @ x.T
            b = simplex(b - grad / (np.linalg.norm(a.T @ a, 2) * np.linalg.norm(x @ x.T, 2) + 1e-12))
            z = b @ x
        loss = float(((x - a @ z) ** 2).sum())
        if best is None or loss < best[0]:
            best = (loss, z, a)
    return best[1], best[2]


def rand_index(a: np.ndarray, b: np.ndarray) -> float:
    """Adjusted Rand index of two labelings."""
    _, i = np.unique(a, return_inverse=True)
    _, j = np.unique(b, return_inverse=True)
    table = np.zeros((i.max() + 1, j.max() + 1))
    np.add.at(table, (i, j), 1)
    pairs = lambda v: (v * (v - 1) / 2).sum()
    both, rows, cols, every = pairs(table), pairs(table.sum(1)), pairs(table.sum(0)), len(a) * (len(a) - 1) / 2
    expected = rows * cols / every
    most = (rows + cols) / 2
    return float((both - expected) / (most - expected)) if most != expected else 1.0
