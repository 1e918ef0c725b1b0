"""Ordered-series operators. Every order is total: ties are broken by the columns the caller names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import earlier_midrank as earlier_midrank


def keep_last(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key in `order`; nulls stand where the order puts them."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__rn = __n").drop("__rn", "__n")


def keep_first(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__rn = 1").drop("__rn")


def keep_latest_group(df: DataFrame, by: Sequence[str], version: Sequence[str]) -> DataFrame:
    """All rows of the newest version (compared column by column, nulls last) per key."""
    w = Window.partitionBy(*by).orderBy(*[F.col(v).desc_nulls_last() for v in version])
    return df.withColumn("__r", F.rank().over(w)).where("__r = 1").drop("__r")


def latest_positive(df: DataFrame, by: Sequence[str], positive: Column, version: Sequence[str]) -> DataFrame:
    """The newest positive rows of a key if it has any, else its newest rows."""
    df = df.withColumn("__pos", F.coalesce(positive, F.lit(False))).withColumn("__some", F.max("__pos").over(Window.partitionBy(*by)))
    return keep_latest_group(df.where("__pos OR NOT __some").drop("__pos", "__some"), by, version)


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str], fresh: Column, name: str = "island") -> DataFrame:
    """Numbers runs: a row for which `fresh` holds starts one."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(w))


def rolling(value: Column, by: Sequence[str], order: Sequence[str], rows: int, floor: int = 1) -> Column:
    """Sum over the last `rows` rows, null under `floor` non-null values."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - rows, 0)
    return F.when(F.count(value).over(w) >= floor, F.sum(value).over(w))


def ytd_to_discrete(df: DataFrame, by: Sequence[str], days: str, value: str, gap: tuple[int, int] = (75, 100)) -> DataFrame:
    """Year-to-date figures of one start date as single periods; a step of another length gives no row."""
    w = Window.partitionBy(*by).orderBy(days)
    before, at = F.lag(value).over(w), F.lag(days).over(w)
    step = F.col(days) - F.coalesce(at, F.lit(0))
    return df.withColumn("step_days", step).withColumn("discrete", F.col(value) - F.coalesce(before, F.lit(0.0))).where(F.col("step_days").between(*gap))


def sequence_labels(df: DataFrame, by: Sequence[str], year: str, quarter: str, day: str) -> DataFrame:
    """first, next, gap or conflict: whether the label's advance agrees with the days that passed."""
    w = Window.partitionBy(*by).orderBy(day, year, quarter)
    ordinal = F.col(year) * 4 + F.col(quarter)
    k = ordinal - F.lag(ordinal).over(w)
    days = F.datediff(F.col(day), F.lag(day).over(w))
    fits = (days >= 30) & (k >= 1) & days.between(91 * k - 60, 91 * k + 70)
    label = F.when(k.isNull(), "first").when(~fits, "conflict").when(k == 1, "next").otherwise("gap")
    return df.withColumn("sequence", label)


def guarded_growth(df: DataFrame, by: Sequence[str], day: str, value: str, gap: tuple[int, int] = (340, 380)) -> DataFrame:
    """Growth on the row before, only where the days between lie within `gap` and the base is positive."""
    w = Window.partitionBy(*by).orderBy(day)
    base, days = F.lag(value).over(w), F.datediff(F.col(day), F.lag(day).over(w))
    return df.withColumn("growth", F.when(days.between(*gap) & (base > 0), F.col(value) / F.when(base > 0, base) - 1))


def ttm_consecutive(df: DataFrame, by: Sequence[str], quarter: str, value: str) -> DataFrame:
    """Sum of a row and the three before it where the four quarters (ordinals) are consecutive, else null."""
    w = Window.partitionBy(*by).orderBy(quarter)
    whole = F.col(quarter) - F.lag(quarter, 3).over(w) == 3
    return df.withColumn("ttm", F.when(whole, F.sum(value).over(w.rowsBetween(-3, 0))))
