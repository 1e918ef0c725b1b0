"""Samples whose draws depend on keys and a seed only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import seeded


def stratified(df: DataFrame, strata: Sequence[str], key: str, quota: int, seed: str, order: Callable[[Column, str], Column] = seeded) -> DataFrame:
    """Up to `quota` rows of each stratum in hash order, with inclusion_weight = stratum rows / sampled rows."""
    w = Window.partitionBy(*strata)
    df = df.withColumn("__r", F.row_number().over(w.orderBy(order(F.col(key), seed)))).withColumn("__n", F.count(F.lit(1)).over(w))
    return df.where(F.col("__r") <= quota).withColumn("inclusion_weight", F.col("__n") / F.least("__n", F.lit(quota))).drop("__r", "__n")


def staged(df: DataFrame, strata: Sequence[str], cells: Sequence[str], key: str, quotas: tuple[int, int, int], seed: str) -> DataFrame:
    """Three stages without overlap: a quota per stratum, then a quota per rare cell, then a plain random rest."""
    first = stratified(df, strata, key, quotas[0], f"{seed}1").withColumn("stage", F.lit("oversample"))
    left = df.join(first.select(key), key, "left_anti")
    second = stratified(left, cells, key, quotas[1], f"{seed}2").withColumn("stage", F.lit("variation"))
    left = left.join(second.select(key), key, "left_anti")
    n = left.count()
    third = left.orderBy(seeded(F.col(key), f"{seed}3")).limit(quotas[2]).withColumn("inclusion_weight", F.lit(n / max(1, min(n, quotas[2])))).withColumn("stage", F.lit("random"))
    return first.unionByName(second).unionByName(third)


def split_half(df: DataFrame, unit: str, key: str, seed: str) -> DataFrame:
    """Half 0 or 1 for each row: the unit's rows in hash order, alternately."""
    w = Window.partitionBy(unit).orderBy(seeded(F.col(key), seed))
    return df.withColumn("half", (F.row_number().over(w) - 1) % 2)
