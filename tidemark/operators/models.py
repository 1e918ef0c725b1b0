"""Linear models whose rows stay on the cluster: fixed effects, robust errors, nested blocks, series with a break.

Each model is one or two aggregates (moments, then squared or clustered scores); only matrices as wide as its regressors
come to the driver. A series with a break is one row a period, which is what its errors need to be ordered by.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import newey_west, t_tail


def within(df: DataFrame, cols: Sequence[str], group: str) -> DataFrame:
    """cols less their mean in the group, rows with a null in any of them (or in the group) left out first."""
    own = Window.partitionBy(group)
    return df.dropna(subset=[*cols, group]).withColumns({c: F.col(c) - F.avg(c).over(own) for c in cols})


def moments(df: DataFrame, cols: Sequence[Column]) -> np.ndarray:
    """Sums of products of all pairs of cols, in one aggregate."""
    k = len(cols)
    row = df.agg(*[F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = row[f"g{i}_{j}"] or 0.0
    return out


def fit(df: DataFrame, y: str, x: Sequence[str], errors: str = "plain", cluster: str | None = None, group: str | None = None) -> dict:
    """terms, coef, cov, se, n, r2 and adj_r2 of y on x.

    group: a fixed effect that is swept out (then there is no constant; its levels count as parameters of adj_r2 and of
    plain and HC1 errors). errors: plain, hc1, or cluster (with `cluster`).
    """
    need = [c for c in (y, *x, cluster, group) if c is not None]
    df = df.dropna(subset=need).withColumns({c: F.col(c).cast("double") for c in (y, *x)})
    levels = 0
    if group is not None:
        levels = df.select(group).distinct().count()
        df = within(df, [y, *x], group)
    terms = list(x) if group is not None else ["const", *x]
    cols = [F.lit(1.0) if t == "const" else F.col(t) for t in terms]
    g = moments(df, [*cols, F.col(y), F.lit(1.0)])
    k, n = len(terms), int(g[-1, -1])
    xx, xy, yy, mean = g[:k, :k], g[:k, k], g[k, k], g[k, k + 1]
    inverse = np.linalg.pinv(xx)
    b = inverse @ xy
    rss = max(yy - b @ xy, 0.0)
    tss = yy - mean**2 / n if n else 0.0
    free = max(n - k - levels, 1)
    residual = F.col(y)
    for c, w in zip(cols, b, strict=True):
        residual = residual - c * float(w)
    if errors == "plain":
        cov = inverse * rss / free
    elif errors == "hc1":
        meat = moments(df, [residual * c for c in cols])
        cov = inverse @ meat @ inverse * n / free
    else:
        scores = df.groupBy(cluster).agg(*[F.sum(residual * c).alias(f"s{i}") for i, c in enumerate(cols)])
        meat = moments(scores, [*[F.col(f"s{i}") for i in range(k)], F.lit(1.0)])
        many = meat[-1, -1]
        cov = inverse @ meat[:k, :k] @ inverse * (many / max(many - 1, 1)) * ((n - 1) / max(n - k, 1))
    r2 = float(1 - rss / tss) if tss > 0 else None
    adjusted = None if r2 is None else 1 - (1 - r2) * (n - 1) / free
    return {"terms": terms, "coef": b, "cov": cov, "se": np.sqrt(np.maximum(np.diag(cov), 0)), "n": n, "r2": r2, "adj_r2": adjusted}


def wald(model: Mapping, terms: Sequence[str]) -> float | None:
    """F statistic of the hypothesis that the terms' coefficients are all zero."""
    at = [model["terms"].index(t) for t in terms]
    b, v = model["coef"][at], model["cov"][np.ix_(at, at)]
    return float(b @ np.linalg.pinv(v) @ b) / len(at) if at else None


def nested(df: DataFrame, y: str, blocks: Sequence[tuple[str, Sequence[str]]], group: str, cluster: str) -> list[dict]:
    """Per block, added to those before it within the group's effect: r2, adj_r2, delta_r2 and the F of the new terms.

    All models use the rows that the widest one can use and groups of at least two such rows.
    """
    every = [c for _, cols in blocks for c in cols]
    df = df.dropna(subset=[y, group, cluster, *every])
    df = df.withColumn("__size", F.count(F.lit(1)).over(Window.partitionBy(group))).where("__size > 1")
    out, used = [], []
    for name, cols in blocks:
        used += list(cols)
        m = fit(df, y, used, "cluster", cluster, group)
        before = out[-1]["r2"] if out else 0.0
        out.append({"block": name, "n": m["n"], "r2": m["r2"], "adj_r2": m["adj_r2"], "delta_r2": None if m["r2"] is None else m["r2"] - (before or 0.0), "f": wald(m, cols)})
    return out


def difference_in_differences(df: DataFrame, y: str, exposed: str, post: str, unit: str, period: str, rounds: int = 30) -> dict:
    """Effect of exposed x post with unit and period effects, errors clustered by unit.

    Both effects are swept out in turn until nothing is left of either; a balanced panel needs one round.
    """
    from .firms import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    out = df.dropna(subset=[y, exposed, post, unit, period]).select(F.col(y).cast("double").alias("__y"), (F.col(exposed).cast("double") * F.col(post).cast("double")).alias("__d"), F.col(unit).alias("__u"), F.col(period).alias("__t"))
    for _ in range(rounds):
        for g in ("__u", "__t"):
            own = Window.partitionBy(g)
            out = out.withColumns({c: F.col(c) - F.avg(c).over(own) for c in ("__y", "__d")})
        out = out.checkpoint()
        left = out.groupBy("__u").agg(F.abs(F.avg("__y")).alias("a"), F.abs(F.avg("__d")).alias("b")).agg(F.max("a"), F.max("b"), F.lit(0)).first()
        scale = out.agg(F.stddev_pop("__y"), F.stddev_pop("__d")).first()
        if all((m or 0.0) <= 1e-9 * max(s or 0.0, 1e-12) for m, s in zip(left[:2], scale, strict=True)):
            break
    g = moments(out, [F.col("__d"), F.col("__y"), F.lit(1.0)])
    b = g[0, 1] / g[0, 0] if g[0, 0] > 0 else None
    if b is None:
        return {"effect": None, "se": None, "n": int(g[2, 2])}
    scores = out.groupBy("__u").agg(F.sum((F.col("__y") - F.col("__d") * float(b)) * F.col("__d")).alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("m"), F.count(F.lit(1)).alias("g")).first()
    n = g[2, 2]
    se = math.sqrt(scores.m / g[0, 0] ** 2 * scores.g / max(scores.g - 1, 1) * (n - 1) / max(n - 1, 1))
    return {"effect": float(b), "se": se, "n": int(n)}


def interrupted(series: Sequence[tuple[int, float, float]], event: int, lag: int = 6) -> dict:
    """Trend, step and change of slope of a monthly series at a month, with month dummies and the log of a size.

    series: (month ordinal, value, size), one row a month. Errors are Newey-West with `lag`.
    """
    rows = sorted(r for r in series if r[1] is not None and r[2])
    t = np.array([r[0] for r in rows], float)
    since = t - event
    post = (since >= 0).astype(float)
    months = sorted({r[0] % 12 for r in rows})[1:]
    cols = [np.ones(len(rows)), t - t.min(), post, since * post, *[(t % 12 == m).astype(float) for m in months], np.log([r[2] for r in rows])]
    x, y = np.stack(cols, 1), np.array([r[1] for r in rows], float)
    b, se = newey_west(x, y, lag)
    rss, tss = ((y - x @ b) ** 2).sum(), ((y - y.mean()) ** 2).sum()
    named = {"pre_trend": 1, "step": 2, "slope_change": 3}
    return {"event": event, "n": len(rows), "r2": float(1 - rss / tss) if tss > 0 else None} | {k: float(b[i]) for k, i in named.items()} | {f"se_{k}": float(se[i]) for k, i in named.items()}


def break_sweep(series: Sequence[tuple[int, float, float]], events: Sequence[int], lag: int = 6) -> list[dict]:
    """The same model at each candidate month; best_fit marks those with the largest r2."""
    out = [interrupted(series, e, lag) for e in events]
    best = max((r["r2"] for r in out if r["r2"] is not None), default=None)
    return [r | {"best_fit": r["r2"] == best} for r in out]


def principal(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Explained shares and loadings (one column a component) of standardised columns, from one aggregate."""
    ok = df.dropna(subset=list(cols))
    g = moments(ok, [F.lit(1.0), *[F.col(c).cast("double") for c in cols]])
    n, mean = g[0, 0], g[0, 1:] / g[0, 0]
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    corr = cov / np.outer(np.where(sd > 0, sd, 1), np.where(sd > 0, sd, 1))
    values, vectors = np.linalg.eigh(corr)
    order = np.argsort(-values)
    vectors = vectors[:, order] * np.sign(vectors[:, order][np.abs(vectors[:, order]).argmax(0), np.arange(len(cols))])
    return values[order] / values.sum(), vectors


def residual(df: DataFrame, y: str, x: str, name: str) -> DataFrame:
    """df with what a line of y on x leaves of y; null where either is null."""
    line = df.agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a")).first()
    return df.withColumn(name, F.col(y) - F.lit(line.a) - F.lit(line.b) * F.col(x))


def correlations(df: DataFrame, a: str, b: str, group: str, order: str) -> dict[str, dict]:
    """Pearson's r with n and two-sided p: over all rows, within groups (less group means), and of first differences."""
    ok = df.dropna(subset=[a, b, group, order])
    own, along = Window.partitionBy(group), Window.partitionBy(group).orderBy(order)
    x = ok.select(F.col(a).alias("a0"), F.col(b).alias("b0"), *[(F.col(c) - F.avg(c).over(own)).alias(f"{n}1") for c, n in ((a, "a"), (b, "b"))], *[(F.col(c) - F.lag(c).over(along)).alias(f"{n}2") for c, n in ((a, "a"), (b, "b"))])
    r = x.agg(*[f.alias(f"{n}{i}") for i in range(3) for n, f in (("r", F.corr(f"a{i}", f"b{i}")), ("n", F.count(F.when(F.col(f"a{i}").isNotNull() & F.col(f"b{i}").isNotNull(), 1))))]).first()
    groups = ok.select(group).distinct().count()
    out = {}
    for i, name in enumerate(("pooled", "within", "difference")):
        rho, n = r[f"r{i}"], r[f"n{i}"]
        free = n - 2 - (groups - 1 if name == "within" else 0)
        tail = None if rho is None or free < 1 else 0.0 if abs(rho) >= 1 else t_tail(rho * math.sqrt(free / (1 - rho * rho)), free)
        out[name] = {"r": rho, "n": n, "p": tail}
    return out


def variance_inflation(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """How much each regressor's variance is inflated by the others: the diagonal of the inverse correlation matrix."""
    ok = df.dropna(subset=list(cols))
    g = moments(ok, [F.lit(1.0), *[F.col(c).cast("double") for c in cols]])
    mean = g[0, 1:] / g[0, 0]
    cov = g[1:, 1:] / g[0, 0] - np.outer(mean, mean)
    sd = np.sqrt(np.diag(cov))
    return dict(zip(cols, np.diag(np.linalg.pinv(cov / np.outer(sd, sd))).tolist(), strict=True))


def restriction(model: Mapping, r: np.ndarray, q: np.ndarray | None = None) -> float:
    """F statistic of the linear restrictions r b = q."""
    gap = r @ model["coef"] - (0 if q is None else q)
    return float(gap @ np.linalg.pinv(r @ model["cov"] @ r.T) @ gap) / len(r)


def robustness(df: DataFrame, y: str, x: Sequence[str], samples: Mapping[str, Column], leave_out: str | None = None, most: int = 200, **how) -> list[dict]:  # noqa: ANN003
    """The same model on each named sample and, with leave_out, without each of that column's levels in turn (few; checked)."""
    runs = [(name, df.where(rule)) for name, rule in samples.items()]
    if leave_out is not None:
        levels = [r[0] for r in df.select(leave_out).where(F.col(leave_out).isNotNull()).distinct().orderBy(leave_out).limit(most + 1).collect()]
        if len(levels) > most:
            raise ValueError(f"{leave_out} has more than {most} levels")
        runs += [(f"without {v}", df.where(~F.col(leave_out).eqNullSafe(F.lit(v)))) for v in levels]
    out = []
    for name, part in runs:
        m = fit(part, y, x, **how)
        out += [{"sample": name, "term": t, "coef": float(b), "se": float(s), "n": m["n"]} for t, b, s in zip(m["terms"], m["coef"], m["se"], strict=True)]
    return out
