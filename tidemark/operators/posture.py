"""Static models applied to panels: nearest centres, and how well they hold out of the sample they come from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import rand_index


def frozen_projection(panel: DataFrame, features: Sequence[str], mean: Sequence[float], scale: Sequence[float], centres: Sequence[Sequence[float]], names: Mapping[int, str], active: Column, inactive: str = "none") -> DataFrame:
    """cluster (nearest centre of the standardised features, the first of equals; -1 where not active) and archetype.

    The model is a handful of numbers, so it is part of the expression; a null feature leaves cluster null.
    """
    z = [(F.col(f) - m) / s for f, m, s in zip(features, mean, scale, strict=True)]
    distances = []
    for centre in centres:
        total = F.lit(0.0)
        for v, c in zip(z, centre, strict=True):
            total = total + (v - c) * (v - c)
        distances.append(total)
    nearest = F.array_position(F.array(*distances), F.array_min(F.array(*distances))) - 1
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull()
    on = F.coalesce(active, F.lit(False))
    label = F.lit(None).cast("string")
    for i, name in names.items():
        label = F.when(F.col("cluster") == i, name).otherwise(label)
    out = panel.withColumn("cluster", F.when(~on, -1).when(whole, nearest.cast("int")))
    return out.withColumn("archetype", F.when(F.col("cluster") == -1, inactive).otherwise(label))


def kmeans(x: np.ndarray, k: int, seed: int = 42, starts: int = 10, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Centres and labels of the best of several starts; for matrices that fit a machine (one row a firm)."""
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for start in range(starts):
        centres = x[np.random.default_rng(seed + start).choice(len(x), k, replace=False)]
        for _ in range(rounds):
            labels = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
            new = np.stack([x[labels == j].mean(0) if (labels == j).any() else centres[j] for j in range(k)])
            if np.allclose(new, centres):
                break
            centres = new
        loss = float(((x - centres[labels]) ** 2).sum())
        if best is None or loss < best[0]:
            best = (loss, centres, labels)
    return best[1], best[2]


def out_of_sample(train: np.ndarray, test: np.ndarray, k: int = 3) -> dict:
    """Frozen centres of `train` against centres fitted on `test` anew: adjusted Rand index and each cluster's best Jaccard."""
    mean, sd = train.mean(0), train.std(0, ddof=1)
    a, b = (train - mean) / sd, (test - mean) / sd
    centres, _ = kmeans(a, k)
    frozen = ((b[:, None] - centres) ** 2).sum(2).argmin(1)
    refit = kmeans(b, k)[1]
    overlap = lambda i, j: ((frozen == i) & (refit == j)).sum() / max(((frozen == i) | (refit == j)).sum(), 1)
    return {"rand": rand_index(frozen, refit), "jaccard": [float(max(overlap(i, j) for j in range(k))) for i in range(k)], "n": len(test)}
